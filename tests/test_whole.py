"""Queries that run an operator over whole tables, against their SQL or brute force."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"


def both(spark, name, d=D):
    """The rows of a query and of its SQL, sorted."""
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")
    result = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in result.description]
    return sorted(map(tuple, entry.queries()[name](spark, d).select(*names).collect()), key=repr), sorted(result.fetchall(), key=repr)


def test_search_from_every_order(spark):
    got, want = both(spark, "bfs_confidence_stop")
    assert got == want and len(got) == spark.read.parquet(f"{D}/orders.parquet").count()


def test_reasoning_from_every_order(spark):
    got, want = both(spark, "pipeline_confidence")
    assert got == want and len({r[0] for r in got}) == spark.read.parquet(f"{D}/orders.parquet").count()


def test_recursion_over_all_events(spark, tmp_path):
    for f in os.listdir(D):
        if f != "events.parquet":
            os.symlink(f"{D}/{f}", tmp_path / f)
    events = spark.read.parquet(f"{D}/events.parquet")
    few = events.where("event_id < 12").selectExpr("event_id + 60 AS event_id", "ts", "event_id % 2 AS user_id", "event_type", "value", "props")
    few.coalesce(1).write.parquet(f"{tmp_path}/made")
    part = next(f for f in os.listdir(tmp_path / "made") if f.endswith(".parquet"))
    os.rename(tmp_path / "made" / part, tmp_path / "events.parquet")
    chains = {}
    for r in sorted(few.collect(), key=lambda r: (r.ts, r.event_id)):
        chains.setdefault(r.user_id, []).append(f"event:{r.event_id}")
    want = {(c[i], c[j], 1 + (j - i - 1).bit_length()) for c in chains.values() for i in range(len(c)) for j in range(i + 1, len(c))}
    got = [tuple(r) for r in entry.queries()["rule_fixpoint_events"](spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and max(d for *_, d in got) == 4


@pytest.mark.parametrize("name", ["behavior_order", "behavior_composed"])
def test_behaviours_of_every_part(spark, name):
    got, want = both(spark, name)
    assert got == want and len(got) >= spark.read.parquet(f"{D}/part.parquet").count()
    if name == "behavior_order":
        assert sorted(r[-1] for r in got) == list(range(1, len(got) + 1))
