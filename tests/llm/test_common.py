import random

import pytest
from pyspark.sql import functions as F

from graphloom.llm import common


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("kept", [range(20_000, 50_000), range(3)])
def test_cascade_is_exact_and_moves_no_text(spark, docs_of, monkeypatch, kept):
    removed = set(random.Random(1).sample(range(20_000), 15_000))
    rows = spark.range(50_000).where(F.col("id").isin(*kept) if len(kept) == 3 else F.col("id") >= 0).selectExpr("id AS doc_id", "'text' AS text").unionByName(spark.createDataFrame([(None, "null"), (1, "again")], "doc_id long, text string"))
    monkeypatch.setattr(common, "SLOTS", 2)
    gone = common.written(spark.createDataFrame([(i,) for i in removed], "doc_id long"), "gone")
    got = common.without(rows, gone, max_keys=0)
    assert "Exchange hashpartitioning" not in plan(got).split("Physical Plan")[1] and "SortMergeJoin" not in plan(got)
    want = sorted(r.doc_id if r.doc_id is not None else -1 for r in rows.collect() if r.doc_id not in removed)
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in got.collect()) == want


def test_a_full_filter_gives_way_to_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_BITS", 1 << 15)
    gone = common.written(spark.range(100_000).selectExpr("id AS doc_id"), "gone")
    rows = spark.range(90_000, 190_000).selectExpr("id AS doc_id", "'text' AS text")
    assert common.without(rows, gone, max_keys=0).agg(F.min("doc_id"), F.count("*")).first() == (100_000, 90_000)
    assert common.without(rows, gone.limit(0), max_keys=0).count() == 100_000
