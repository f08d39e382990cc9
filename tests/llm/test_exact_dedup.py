import hashlib
import re

import duckdb
import pytest

from graphloom.llm import exact_dedup as op
from graphloom.llm.queries import op2_exact_dedup, oracle_sql

TEXTS = ["a  b", "a b", "a\tb\n", "", None, " ", "a b", "A b", "x" * 100_000, "x" * 100_000, "unique", "a b"]


def naive(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return {(i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids}


@pytest.mark.parametrize("bits", [None, op.FILTER_BITS, 64])  # a full filter changes no result
def test_against_brute_force(docs_of, bits):
    got = {tuple(r) for r in op.exact_dedup(docs_of(TEXTS), bits=bits).collect()}
    assert got == naive(enumerate(TEXTS))


def test_empty_table_extra_columns_and_repeated_rows(docs_of):
    assert op.exact_dedup(docs_of([])).count() == 0
    frame = docs_of([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b")], ", keep_id string")
    rows = op.exact_dedup(frame).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size) for r in rows if r.doc_id) == [(False, 1, 1, 4), (False, 1, 1, 4), (False, 2, 1, 4)]
    assert sum(r.kept for r in rows if r.keep_id == 1) == 1
    assert [r.kept for r in rows if r.keep_id is None] == [True]


def test_drop_exact_copies(docs_of):
    docs = docs_of(TEXTS)
    left = op.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, _, _, kept, _ in naive(enumerate(TEXTS)) if kept)
    doubled = op.drop_exact_copies(docs_of([(1, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "c")]))
    assert sorted((r.doc_id, r.text) for r in doubled.collect()) == [(1, "a"), (1, "b"), (3, "c")]


def test_query_matches_sql(spark, tmp_path, docs_of):
    docs_of(TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    result = con.execute(oracle_sql()["op2_exact_dedup"])
    names = [c[0] for c in result.description]
    want = {tuple(dict(zip(names, r)).values()) for r in result.fetchall()}
    assert {tuple(r[n] for n in names) for r in op2_exact_dedup(spark, str(tmp_path)).collect()} == want
