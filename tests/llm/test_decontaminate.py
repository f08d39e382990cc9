import hashlib
import re

import duckdb
import pytest

from graphloom.llm import decontaminate as op
from graphloom.llm.queries import op8_decontamination, oracle_sql

ITEM = "Zero one two three four five six seven eight nine ten eleven twelve thirteen"
ITEMS = [(1, ITEM), (2, "Short item!"), (10, "short item"), (3, ""), (4, None), (5, "É word"), (None, "null id item here"), (6, "one")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def naive(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        n = min(len(v), 13)
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i : i + n]) in windows:
                hit.update(range(i, i + n))
                found.add(item)
    found = sorted(str(x) for x in found if x is not None)
    return len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


TEXTS = ["", None, "x", ITEM, f"a b c {ITEM.upper()}, {ITEM}", ITEM.replace("six", "6"), "zero one two three four five six seven eight nine ten eleven twelve", "short, ITEM short item", "one",
         "pad " * 400 + ITEM, "é word É WORD", "null id item here", "pad " * 50_000, "zero one two three", "--zero one", "one " * 30]


@pytest.mark.parametrize("items", [ITEMS, ITEMS[:1], ITEMS[3:5], []])
def test_against_brute_force(spark, docs_of, items):
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    got = {r.doc_id: tuple(r)[1:] for r in op.digest(op.contamination(docs_of(TEXTS, ", n_hit string"), bench)).collect()}
    assert got == {i: naive(t, items) for i, t in enumerate(TEXTS)}
    left = op.drop_contaminated(docs_of(TEXTS), bench)
    assert sorted(r.doc_id for r in left.collect()) == [i for i, t in enumerate(TEXTS) if not naive(t, items)[-1]]
    assert op.contamination(docs_of([]), bench).count() == 0


def test_repeated_rows(spark, docs_of):
    bench = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    rows = op.digest(op.contamination(docs_of([(1, ITEM), (1, ITEM), (1, "clean"), (None, ITEM)]), bench)).collect()
    assert sorted((r.doc_id is None, r.n_words, r.n_hit) for r in rows) == [(False, 1, 0), (False, 14, 14), (False, 14, 14), (True, 14, 14)]


def test_query_matches_sql(spark, docs_of, tmp_path):
    docs_of([t for t in TEXTS if len(t or "") < 10_000]).write.parquet(f"{tmp_path}/documents.parquet")  # the SQL lists all windows of a text
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    result = con.execute(oracle_sql()["op8_decontamination"])
    names = [c[0] for c in result.description]
    assert {tuple(r[n] for n in names) for r in op8_decontamination(spark, str(tmp_path)).collect()} == set(result.fetchall())


@pytest.mark.parametrize("limit", ["MAX_SLOTS", "MAX_BROADCAST"])  # full tables, or a set that isn't broadcast, change no result
def test_limits_change_no_result(spark, docs_of, monkeypatch, limit):
    monkeypatch.setattr(op, limit, 1)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in op.digest(op.contamination(docs_of(TEXTS), bench)).collect()}
    assert got == {i: naive(t, ITEMS) for i, t in enumerate(TEXTS)}
