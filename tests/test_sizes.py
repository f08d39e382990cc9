"""Joins with large stored tables are not broadcast for the small size of their files."""

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import __spark_entry__ as entry
from graphloom.operators import shapes
from graphloom.operators.shapes import Constraint as C
from graphloom.operators.shapes import Path, PropertyShape, Shape, predicate
from graphloom.sources.graph import from_rows
from graphloom.sources.work import IN_MEMORY, sized
from tests.test_whole import both

FACTOR, LIMIT = "spark.sql.sources.fileCompressionFactor", "spark.sql.autoBroadcastJoinThreshold"
D = "/root/testdata/sf0.01"


@pytest.fixture
def plans(spark, monkeypatch):
    """The first plan of each table that is written or collected, where tables over 100 KB are too large to broadcast; node keys take 700 KB there, and 20 KB of a file."""
    seen = []

    def kept(name, own):
        def call(self, *a, **b):
            seen.append(self._jdf.queryExecution().sparkPlan().toString())
            return own(self, *a, **b)

        return call

    kind = type(spark.range(1))
    assert issubclass(kind, DataFrame)
    monkeypatch.setattr(kind, "collect", kept("collect", kind.collect))
    monkeypatch.setattr(kind, "write", property(kept("write", kind.write.fget)))
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "100k")
    yield seen
    spark.conf.set(LIMIT, before)


def built(plan):
    """The subtrees of a plan that its joins broadcast."""
    lines = plan.split("\n")
    depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
    for k, x in enumerate(lines):
        if "Broadcast" in x and "Join" in x:
            end = next((i for i in range(k + 1, len(lines)) if depth[i] <= depth[k]), len(lines))
            sides = [i for i in range(k + 1, end) if depth[i] == depth[k] + 3]
            yield "\n".join(lines[k + 1 : sides[1]] if "BuildLeft" in x else lines[sides[1] : end])


QUERIES = [
    "incoming_edges",
    "inference_by_prefix",
    "inference_closure",
    "dl_min",
    "plan_variants",
    "shacl_min_count",
    "shacl_node_class",
    "shacl_node_logic",
    "discover_downstream",
    "pattern_incoming",
    "dl_exact",
    "dl_max",
    "rule_dl_query",
    "shacl_has_value",
    "shacl_summary",
    "explore_counts",
    "shacl_path_seq",
    "bfs_confidence_stop",
    "pipeline_inherited",
    "pipeline_version",
    "reasoner_facade",
]


@pytest.mark.parametrize("name", QUERIES)
def test_large_tables_are_not_broadcast_by_their_files(spark, plans, name):
    got, want = both(spark, name, D)
    assert got == want and plans
    assert any("Join" in p for p in plans) and not [x for p in plans for x in built(p) if "/graph-" in x]


def test_a_factor_of_the_sessions_owner_stays(spark):
    before = spark.conf.get(FACTOR)
    try:
        spark.conf.set(FACTOR, "3.0")
        sized(spark)
        assert spark.conf.get(FACTOR) == "3.0"
        spark.conf.unset(FACTOR)
        sized(spark)
        assert float(spark.conf.get(FACTOR)) == IN_MEMORY
    finally:
        spark.conf.set(FACTOR, before)


def made(node):
    """The rows that each operator of an executed plan made: (name, rows)."""
    name = node.nodeName()
    inner = [node.executedPlan()] if name.startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in name else []
    below = node.children()
    rows = node.metrics().get("numOutputRows")
    if rows.isDefined():
        yield name, rows.get().value()
    for x in [*inner, *(below.apply(i) for i in range(below.size()))]:
        yield from made(x)


def test_paths_that_are_only_counted_are_not_multiplied_out(spark):
    nodes = [{"labels": ["Entity"], "id": f"part{i}", "size": i} for i in range(600)] + [{"labels": ["Type"], "id": f"hub{i}"} for i in range(2)]
    edges = [{"src": f"part{i}", "rel_type": "by", "dst": f"hub{h}"} for i in range(600) for h in range(2) if h == 0 or i < 7]
    g = from_rows(spark, nodes, edges + edges[-1:])
    there = Path("sequence", (predicate("by"), Path("inverse", (predicate("by"),))))
    df = shapes.validate(g, [Shape("S", (("class", "Entity"),), (PropertyShape(there, (C("max_count", 601),)),))]).select("focus", "value")
    # 600 ways over the first hub; over the second 7, one of them by a doubled edge
    assert sorted(df.collect()) == sorted((f"part{i}", "608") for i in range(7))
    joins = [n for name, n in made(df._jdf.queryExecution().executedPlan()) if "Join" in name]
    assert joins and max(joins) < 10_000
    sizes = Path("sequence", (*there.parts, predicate("size")))
    hits = shapes.validate(g, [Shape("S", (("class", "Entity"),), (PropertyShape(sizes, (C("qualified_min", (301, C("min_inclusive", 300))), C("has_value", 3), C("min_count", 600))),))])
    assert sorted(r[0] for r in hits.groupBy("component").count().select("count").collect()) == [600]
    assert {r.component for r in hits.collect()} == {"qualified_min"}


def test_pairs_of_a_small_file_are_made_in_many_tasks(spark):
    got, want = both(spark, "haversine_pairs")
    assert got == want and got
    pairs = entry.queries()["haversine_pairs"](spark, D)
    assert pairs.select(F.spark_partition_id().alias("at")).distinct().count() >= 4
