from pyspark.sql import functions as F

from graphloom.plans.rules import Parser
from graphloom.sources.graph import from_rows
from graphloom.streaming.incremental import RuleStream, event_edges, relation_counts

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_rules_over_micro_batches(spark, tmp_path):
    schema = "src string, rel_type string, dst string"
    for k, pair in enumerate([("a", "b"), ("b", "c"), ("c", "d")]):
        spark.createDataFrame([(pair[0], "p", pair[1])], schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    found = []
    handler = RuleStream(from_rows(spark, [], []), Parser().parse_all("[a: p(?x,?y) -> q(?x,?y)]\n[b: q(?x,?y) ^ p(?y,?z) -> q(?x,?z)]"), lambda facts, n: found.append((n, {(r.subject, r.object) for r in facts.collect()})))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q = stream.writeStream.foreachBatch(handler).option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert set().union(*(f for _, f in found)) == {(x, y) for x in "abcd" for y in "abcd" if x < y}
    before = len(found)
    handler(spark.createDataFrame([("a", "p", "b")], schema), 0)
    assert len(found) == before


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    events.repartition(3).write.parquet(f"{tmp_path}/ev")
    stream = relation_counts(event_edges(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/ev")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == events.count()
    assert {tuple(r) for r in spark.table("counts").collect()} == {tuple(r) for r in relation_counts(event_edges(events)).collect()}


def test_a_stream_goes_on_behind_its_state(spark, tmp_path):
    schema = "src string, rel_type string, dst string"
    rules = Parser().parse_all("[a: p(?x,?y) -> q(?x,?y)]\n[b: q(?x,?y) ^ q(?y,?z) -> q(?x,?z)]")
    base, found = from_rows(spark, [], [{"src": "a", "rel_type": "p", "dst": "b"}, {"src": "a", "rel_type": "q", "dst": "b"}]), {}
    sink = lambda facts, n: found.setdefault(n, []).append({(r.subject, r.object) for r in facts.collect()})
    one = lambda a, b: spark.createDataFrame([(a, "p", b)], schema)
    RuleStream(base, rules, sink, state=f"{tmp_path}/s")(one("b", "c"), 4)
    again = RuleStream(base, rules, sink, state=f"{tmp_path}/s")
    assert again.last == 4
    again(one("b", "c"), 4)
    again(one("d", "e"), 5)
    again(one("c", "d"), 6)
    assert found == {4: [{("b", "c"), ("a", "c")}], 5: [{("d", "e")}], 6: [{("c", "d"), ("b", "d"), ("a", "d"), ("c", "e"), ("b", "e"), ("a", "e")}]}
    assert again.graph.edges.where("rel_type = 'q'").count() == 10
