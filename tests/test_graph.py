import math

import pytest
from pyspark.sql import functions as F

from graphloom import vocab
from graphloom.errors import MappingError, StoreError
from graphloom.functions import iri, language, text, tools
from graphloom.operators import detect, pattern, search, timeline, traverse, versions
from graphloom.operators.pattern import Check, EdgePattern, NodePattern
from graphloom.plans import ir, reason
from graphloom.plans.rules import Parser
from graphloom.sources import graph as G
from graphloom.sources import io, ontology
from tests.graphs import demo, entity


@pytest.fixture(scope="module")
def world(spark):
    nodes = [{"labels": ["Type"], "id": "t:thing", "name": "thing", "color": "grey", "mass": 1.5}, {"labels": ["Type"], "id": "t:ship", "name": "ship", "color": "blue"},
             {"labels": ["Entity"], "id": "a", "code": "A", "name": "Alpha", "type": "ship", "confidence": 0.9, "speed": 3}, {"labels": ["Entity"], "id": "b", "code": "B", "name": "Beta", "confidence": 0.4},
             {"labels": ["Entity"], "id": "c", "code": "C", "description": "an alpha copy"}, {"labels": ["Event"], "id": "d", "code": "D", "hasPrecondition": "False"}, {"labels": ["Entity"], "id": "x", "code": "X"}]
    link = lambda s, r, d, **k: {"src": s, "rel_type": r, "dst": d, **k}
    edges = [link("t:ship", "subClassOf", "t:thing"), link("b", "INSTANCE_OF", "t:thing"), link("a", "swrl:go", "b", action_type="inference"), link("b", "swrl:go", "c", action_type="inference"), link("a", "sees", "d", action_type="inference"),
             link("d", "sees", "x", action_type="inference"), link("c", "near", "a"), link("a", "asks", "b", action_type="chat"), link("a", "calls", "c", func="f", target_id="c"), link("x", "x:self", "x")]
    return G.from_rows(spark, nodes, edges)


def ids(df, c="node_id"):
    return sorted(r[c] for r in df.collect())


def test_lookups(world, spark):
    assert ids(pattern.get_nodes(world, ["A", "b", "nobody"])) == ["a", "b"]
    assert ids(world.labelled("Type")) == ["t:ship", "t:thing"]
    assert ids(pattern.relationships(world, "a", "swrl:go"), "dst") == ["b"] and pattern.relationships(world, "a", direction="both").count() == 5
    assert ids(pattern.incoming_relationships(world, "a"), "src") == ["c"] and pattern.incoming_relationships(world, "x").count() == 1
    assert ids(pattern.find_by_id_code(world, "a", "A")) == ["a"] and ids(pattern.find_by_id_code(world, "a", "B")) == [] and ids(pattern.find_by_id_code(world, code="C")) == ["c"]
    tier = lambda n: [(r.node_id, r.tier) for r in pattern.find_any(world, n).collect()]
    assert tier("a") == [("a", 0)] and tier("Beta") == [("b", 1)] and tier("lph") == [("a", 2)] and tier("copy") == [("c", 2)] and tier("zzz") == []
    specs = spark.createDataFrame([("A", None), ("ship", None), ("ship", "Entity"), ("who", None)], "to_name string, to_label string")
    assert [r.to_node for r in pattern.resolve_ids(world, specs, "to").orderBy("to_name", F.col("to_label").asc_nulls_first()).collect()] == ["a", "t:ship", "ship", "who"]
    with pytest.raises(StoreError):
        pattern.resolve_ids(world, specs.select("to_label"), "to")
    assert ids(pattern.parent_types(world, "t:ship")) == ["t:thing"] and ids(pattern.discover_downstream(world, "a", ["swrl:go", "sees"]), "code") == ["B", "D"]
    assert pattern.exists_code(world, "A") and not pattern.exists_code(world, "Q") and pattern.exists_type(world, "ship")


def test_patterns_and_checks(world, spark):
    hits = lambda s, e, t: sorted((r.start, r.end) for r in pattern.match(world, s, e, t).collect())
    assert hits(NodePattern("Entity"), EdgePattern("swrl:go"), NodePattern()) == [("a", "b"), ("b", "c")]
    assert hits(NodePattern().with_property("speed", 3), EdgePattern().with_type("swrl:go"), NodePattern()) == [("a", "b")]
    assert hits(NodePattern(props={"speed": 3.0}), EdgePattern(), NodePattern()) == [] and hits(NodePattern(props={"speed": "3"}), EdgePattern(), NodePattern()) == []
    assert hits(NodePattern("Type").with_variable("t"), EdgePattern("subClassOf").incoming(), NodePattern("Type")) == [("t:thing", "t:ship")]
    assert hits(NodePattern(), EdgePattern("x:self", "both"), NodePattern()) == [("x", "x")]
    checks = [Check("required", "empty"), Check("exists", "gone"), Check("equals", "speed", 30), Check("equals", "speed", 30.0), Check("not_equals", "absent", 1), Check("min", "power", 75), Check("above", "power", 75), Check("pattern", "status", "^act"), Check("in", "status", ("active", "x")), Check("max", "status", 3), Check("below", "speed", 31)]
    e = entity(spark)
    row = pattern.check_nodes(e, e.nodes, checks).first()
    assert not row.passed and row.failed == ["required(empty)", "equals(speed, 30.0)", "above(power, 75)", "max(status, 3)"]
    targets = {(r.rel_type, r.target) for r in language.route(world.edges).collect()}
    assert {("asks", "llm_only"), ("calls", "custom_func"), ("swrl:go", "rules"), ("subClassOf", "facts"), ("near", "non_inference"), ("sees", "non_inference")} <= targets


def test_plans(world):
    go = lambda name, **a: ir.execute(world, ir.Plan(name, a))
    assert ids(go("get_by_code", code="A")) == ["a"] and ids(go("get_by_label", label="Event")) == ["d"] and go("relationships", node="a").count() == 4
    assert go("pattern", edge=EdgePattern("sees")).count() == 2 and ids(go("downstream", node="a", rel_types=["near"]), "code") == [] and ids(go("parent_types", child="b")) == ["t:thing"]
    assert go("validate", code="A", checks=[Check("exists", "speed")]).first().passed and go("json_path", code="A", path="$.speed").first().value == "3"
    assert go("rule", rule=Parser().parse("[r: near(?x,?y) -> far(?y,?x)]")).first().subject == "a"
    ir.FUNCTIONS["twice"] = lambda g, a: g.nodes.limit(a["n"])
    assert go("call", function="twice", args={"n": 2}).count() == 2
    for bad in (ir.Plan("call", {"function": "none"}), ir.Plan("nothing", {})):
        with pytest.raises(StoreError):
            ir.execute(world, bad)


def test_traversal(world, spark):
    start = spark.createDataFrame([("a",)], "node_id string")
    hops = lambda **k: {(r.node, r.hop, round(r.confidence, 3), r.blocked) for r in traverse.explore(world, start, **k).collect()}
    assert hops(max_depth=2, relation="swrl:go") == {("b", 1, 0.4, False), ("c", 2, 0.4, False)}
    assert hops(max_depth=5, relation="swrl:go", threshold=0.5) == {("b", 1, 0.4, True)}
    assert {h[0] for h in hops(max_depth=99, direction="in")} == {"c", "b"} and {h[0] for h in hops(max_depth=0, direction="both")} == {"b", "c", "d"}
    assert {(r.node, r.ancestor, r.depth) for r in traverse.ancestors(world).collect()} == {("t:ship", "t:thing", 1)}
    own = {(r.node_id, r.key): (r.raw, r.depth) for r in traverse.inherited_props(world).collect()}
    assert own["a", "color"] == ("blue", 1) and own["a", "mass"] == ("1.5", 2) and own["b", "color"] == ("grey", 1) and own["a", "name"] == ("Alpha", 0) and ("c", "color") not in own
    assert ids(traverse.inference_closure(world, start)) == ["a", "b", "c", "d", "x"] and ids(traverse.inference_closure(world, start, by_prefix=True)) == ["a", "b", "c"]
    assert ids(traverse.ontology_closure(world, spark.createDataFrame([("b",)], "node_id string"))) == ["b", "t:thing"]
    assert [(r.rel_type, r.n) for r in traverse.summarize_relations(world.edges, 2).collect()] == [("sees", 2), ("swrl:go", 2)]
    assert {(r.node_id, r.rel_type) for r in traverse.next_steps(world, 1, inference_only=True).collect()} == {("a", "sees"), ("b", "swrl:go"), ("d", "sees")}
    loop = G.from_rows(spark, [], [{"src": a, "rel_type": "subClassOf", "dst": b} for a, b in ("pq", "qp")])
    assert {(r.node, r.ancestor) for r in traverse.ancestors(loop).collect()} == {("p", "q"), ("q", "p")}


def test_versions(world, spark):
    v = versions.clone_all(world, "1")
    copy = v.nodes.where("version = '1'")
    assert ids(copy) == [f"{x}_v1" for x in "abcdx"] and ids(copy, "code") == [f"{x}_v1" for x in "ABCDX"]
    assert v.edges.where("version = '1'").count() == 8 and v.edges.count() == 18
    assert {r.raw for r in v.props.where("key = 'graph_id'").collect()} == set("abcdx")
    again, mapping = versions.copy_nodes(v, "1")
    assert again.nodes.count() == v.nodes.count() and mapping.count() == 5
    some = versions.clone_selected(world, spark.createDataFrame([("a",)], "node_id string"), "2")
    assert ids(some.nodes.where("version = '2'")) == ["a_v2", "b_v2", "c_v2"]
    assert versions.delete_version(v, "1").edges.count() == 10 and versions.delete_version(v, "1").nodes.count() == 7
    up = versions.update_entity(world, "a", {"speed": 4.0, "new": True}, "3")
    value = lambda g, n, k: [(r.kind, r.raw) for r in g.props.where((F.col("node_id") == n) & (F.col("key") == k)).collect()]
    assert value(up, "a_v3", "speed") == [("float", "4.0")] and value(up, "a", "speed") == [("integer", "3")] and value(up, "a_v3", "new") == [("boolean", "true")]
    assert value(versions.update_entity(world, "a", {"speed": 5}), "a", "speed") == [("integer", "5")]
    gone = versions.delete_nodes(world, spark.createDataFrame([("a",)], "node_id string"))
    assert gone.edges.count() == 5 and gone.props.where("node_id = 'a'").count() == 0
    assert versions.delete_edges(world, world.edges.where("rel_type = 'sees'")).edges.count() == 8
    assert ids(versions.VersionControl.resolve_code(v, "A", "1")) == ["a_v1"] and ids(versions.VersionControl.resolve_code(v, "A", "9")) == ["a"]
    vc = versions.VersionControl()
    vc.snapshot("s", world)
    assert vc.rollback("s") is world
    with pytest.raises(StoreError):
        vc.rollback("t")


def test_writes(world, spark):
    g = versions.create_entity(world, {"code": "N", "speed": 3, "leven": "no", "extra": [1]})
    props = {r.key: (r.kind, r.raw) for r in g.props.where("node_id = 'urn:entity:N'").collect()}
    assert props["speed"] == ("float", "3.0") and "leven" not in props and props["extra"] == ("list", "[1]")
    for bad in (lambda: versions.create_entity(g, {"code": "N"}), lambda: versions.create_entity(g, {}), lambda: versions.create_type(g, "ship")):
        with pytest.raises(StoreError):
            bad()
    g = versions.create_patrol(versions.create_type(g, "boat", "ship"), "P1", "round", [[1, 2]])
    assert g.labelled("Patrol").count() == 1 and g.edges.where("src = 'type:boat'").count() == 1
    specs = pattern.resolve_ids(g, pattern.resolve_ids(g, spark.createDataFrame([("A", "B", "knows")], "start string, end string, rel_type string"), "start"), "end")
    linked = versions.create_relationships(g, specs)
    assert linked.edges.where("rel_type = 'knows' AND src = 'a' AND dst = 'b'").count() == 1
    audit = versions.audited(linked.edges.limit(1)).first()
    assert audit.delete_flag == 0 and audit.is_system == "0" and len(audit.create_time) == 19
    replaced = versions.insert(world, [{"labels": ["Entity"], "id": "a", "code": "A2"}])
    assert ids(pattern.get_nodes(replaced, ["A2"])) == ["a"] and replaced.props.where("node_id = 'a'").count() == 2


def test_reason_on_nodes(world, spark):
    out = reason.reason_on_nodes(world, spark.createDataFrame([("a",)], "node_id string"), "7", confidence=1.0, threshold=0.35)
    steps = {(r.node_id, r.hop, round(r.confidence, 2), r.state) for r in out.steps.collect()}
    assert steps == {("a", 0, 0.9, "ok"), ("b", 1, 0.36, "ok"), ("d", 1, 0.9, "precondition"), ("c", 2, 0.36, "ok")}
    assert ids(out.graph.nodes.where("version = '7'")) == [f"{x}_v7" for x in "abcdx"] and {(r.node_id, r.n) for r in out.inherited.collect()} == {("a", 2), ("b", 2)}
    assert "confidence" in reason.narrated(out.steps).first().line
    r = reason.Reasoner(versions.insert(demo(spark), [{"labels": ["Entity"], "code": "act", "hasEffect": "swrl:hasBrother(?x,?y) -> hasBrother(?y,?x)"}]))
    ready, outcome = r.execute_behaviors(write=True)
    assert ready.count() == 1 and outcome.derived == 2 and r.graph.edges.where("rel_type = 'hasBrother'").count() == 4
    assert reason.Reasoner(world).on_nodes(["a"]).steps.count() >= 3


def test_changes_io_and_views(world, spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", "r")], "source string, target string, relation string")
    got = {(r.key, r.old, r.new, r.change) for r in detect.attribute_changes(world, pairs).collect()}
    assert got == {("id", "a", "b", "changed"), ("code", "A", "B", "changed"), ("name", "Alpha", "Beta", "changed"), ("confidence", "0.9", "0.4", "changed")}
    assert "Alpha to Beta" in " ".join(r.line for r in detect.narrated(detect.detect(world, pairs, [])).collect())
    world.save(f"{tmp_path}/g")
    back = G.open_graph(spark, f"{tmp_path}/g")
    assert sorted(map(str, back.edges.collect())) == sorted(map(str, world.edges.collect())) and back.props.count() == world.props.count()
    plan = back.edges.where("rel_type = 'sees'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(rel_type" in plan
    assert G.open_graph(spark, f"{tmp_path}/none", world) is world and G.open_graph(spark, None).nodes.count() == 0
    (tmp_path / "r.swrl").write_text("# rules\n[one: sees(?x,?y) -> seen(?y,?x)]\n")
    assert [r.name for r in io.read_rules(spark, f"{tmp_path}/r.swrl")] == ["one"]
    hit = io.find_rules(spark, f"{tmp_path}/r.swrl", world.edges.where("rel_type IN ('sees', 'near')").select("src", "rel_type", "dst"))
    assert {(r.rel_type, r.source_file) for r in hit.collect()} >= {("sees", "r")}
    io.write_events(pairs, f"{tmp_path}/events")
    io.write_log(pairs.withColumn("line", F.lit("x")), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/events").count() == spark.read.text(f"{tmp_path}/log").count() == 1
    assert spark.read.json(spark.sparkContext.parallelize([r.json for r in io.value_to_json(entity(spark).props).collect()])).first().power == 75.0
    assert "## Edges" in io.render(world) and {r.label: r.n for r in world.health().collect()}["Entity"] == 4
    for name, frame in (("nodes", world.nodes), ("edges", world.edges), ("props", world.props)):
        frame.createOrReplaceTempView(f"v_{name}")
    assert G.from_views(spark, "v_nodes", "v_edges", "v_props").nodes.count() == 7
    rules = versions.insert(world, [{"labels": ["Rule"], "id": "r1", "rule": "[a: b(?x) -> c(?x)]"}])
    assert io.rule_nodes(rules).first().text.startswith("[a")


def test_spatial(spark):
    def meters(*p):
        return spark.range(1).select(timeline.haversine_m(*map(F.lit, p)).alias("m")).first().m

    assert 1_000_000 < meters(39.9042, 116.4074, 31.2304, 121.4737) < 1_200_000 and meters(1.0, 2.0, 1.0, 2.0) < 0.01
    assert abs(meters(0.0, 0.0, 0.0, 180.0) - math.pi * timeline.EARTH_RADIUS_M) < 1
    points = [(i, lat, lon) for i, (lat, lon) in enumerate((lat, lon) for lat in (-89.9, -60.0, -0.5, 0.0, 45.0, 89.5, 89.99) for lon in (-180.0, -179.9, -90.0, 0.0, 0.7, 120.0, 179.95, 180.0))]
    p = spark.createDataFrame(points, "id int, lat double, lon double")
    c = spark.createDataFrame(points, "center int, c_lat double, c_lon double")

    def h(a, b):
        (x, y), (u, v) = [tuple(map(math.radians, q[1:])) for q in (a, b)]
        s = math.sin((u - x) / 2) ** 2 + math.cos(x) * math.cos(u) * math.sin((v - y) / 2) ** 2
        return 2 * timeline.EARTH_RADIUS_M * math.atan2(math.sqrt(s), math.sqrt(max(0, 1 - s)))

    for radius in (20_000, 90_000, 400_000, 3_000_000):
        got = [(r.id, r.center) for r in timeline.within(p, c, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == {(a[0], b[0]) for a in points for b in points if h(a, b) <= radius}, radius


def test_routes_and_strikes(spark):
    w = spark.createDataFrame([("r", 2, 32.1, 118.1, "SCAN"), ("r", 1, 32.0, 118.0, "HOVER")], "route string, seq int, lat double, lon double, action string")
    legs = timeline.route_legs(w.withColumns({"start_lat": F.lit(31.0), "start_lon": F.lit(117.0), "speed": F.lit(200.0)}))
    rows = sorted(legs.collect(), key=lambda r: r.seq)
    assert len(rows) == 2 and rows[0].from_lat == 31.0 and rows[1].from_lat == 32.0 and rows[1].remaining_s == 0 and rows[0].remaining_s > 0
    total = timeline.route_totals(legs).first()
    assert total.legs == 2 and total.duration == int(total.total_time_s) and total.composed_of.startswith("HOVER(1,")
    still = timeline.route_totals(timeline.route_legs(w.withColumns({"start_lat": F.lit(31.0), "start_lon": F.lit(117.0), "speed": F.lit(0.0)}))).first()
    assert still.total_time_s == 0 and still.duration == 1
    s = spark.createDataFrame([("s", "a", "b", 0.0, 0.0, 0.0, 0.1, 100.0, "supersonic missile", 20_000.0, 0.9), ("t", "a", "b", 0.0, 0.0, 5.0, 0.0, 0.0, "gun", 1000.0, 0.9)],
                              "code string, attacker string, target string, attacker_lat double, attacker_lon double, target_lat double, target_lon double, target_depth double, weapon string, weapon_range_m double, confidence double")
    near, far = timeline.strikes(s).orderBy("code").collect()
    assert near.in_range and abs(near.hit_probability - 0.9 * (1 - near.distance_m / 20_000) * 0.9) < 1e-9 and near.duration == int(near.distance_m / 300)
    told = timeline.strike_rules(timeline.strikes(s)).orderBy("code").first()
    assert told.precondition.startswith(":Entity(a) ^ :Entity(b) ^ strikes(a, b, s)") and "hasDamage(s, 'heavy')" not in told.effect and told.composed_of.startswith("lock(a,b,")
    ruled = timeline.route_rules(timeline.route_totals(legs).withColumns({"entity": F.lit("e"), "speed": F.lit(200.0)})).first()
    assert "hasSpeed(e, 200)" in ruled.precondition and f"hasDuration(r, {total.duration})" in ruled.effect
    assert not far.in_range and far.hit_probability == 0 and far.damage_level == "none" and far.cost.endswith("2 rounds")


def test_texts(spark):
    assert language.parse("swrl:a(?x)") == ("swrl", "a(?x)") and language.parse("sh:") == ("sh", "")
    for bad in ("rdf:x", "xml:x", "action:x", "", "SWRL:x"):
        with pytest.raises(MappingError):
            language.parse(bad)
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    p, lit = iri.Prefixes({"ex": "http://ex#"}), F.lit
    rdfs = "http://www.w3.org/2000/01/rdf-schema#label"
    assert one(p.compress(lit(rdfs))) == "rdfs:label" and one(p.expand(lit("rdfs:label"))) == rdfs and one(p.expand(lit("owl:Thing"))).endswith("owl#Thing") and one(p.compress(lit("http://ex#a"))) == "ex:a"
    assert [one(iri.name_of(lit(x))) for x in ("http://www.w3.org/2002/07/owl#Thing", "http://a/b/c", "http://a/b#c", "owl:Thing")] == ["Thing", "c", "c", "Thing"]
    assert text.path_parts("$.position.lat") == ["position", "lat"] and one(text.at_path(lit('{"a":{"b":7}}'), "$.a.b")) == "7"
    assert one(text.is_iso_time(lit("2024-01-01T00:00:00Z"))) and not one(text.is_iso_time(lit("2024-01-01 00:00:00"))) and not one(text.is_iso_time(lit("T"), strict=True))
    assert one(text.shortened(lit("abcdef"), 3)) == "abc..." and one(text.listed(lit(" a;;b ; "))) == ["a", "b"]
    assert [one(text.clamped_priority(lit(v))) for v in ("", "5", "10", "15", "-3", "high")] == [0, 5, 10, 10, 0, 0] and [one(text.duration(lit(v))) for v in ("", "60", "invalid")] == [0, 60, 0]
    assert one(text.stable_id("urn:", lit("a"), lit("b"))) == one(text.stable_id("urn:", lit("a"), lit("b"))) != one(text.stable_id("urn:", lit("ab"), lit("")))
    answers = ['{"a": 1}', 'text ```json\n{"a": 1}\n``` more', '{"choices": [{"message": {"tool_calls": [{"function": {"name": "f", "arguments": "{\\"a\\": 1}"}}]}}]}', 'so {"a": "}{", "b": {"c": 1}} end', "plain", "{broken", None]
    got = [r.json for r in text.extracted_json(spark.createDataFrame([(k, a) for k, a in enumerate(answers)], "k int, t string"), "t").orderBy("k").collect()]
    assert got == ['{"a": 1}', '{"a": 1}', '{"a": 1}', '{"a": "}{", "b": {"c": 1}}', None, None, None]
    doc = '{"s": "42", "i": 42, "f": 3.14, "b": true, "l": [1], "n": null, "m": {"x": 1}}'
    kinds = {r.name: r.kind for r in text.json_rows(spark.createDataFrame([(1, doc), (2, "bad")], "id int, j string"), "j", "id").collect()}
    assert kinds == {"s": "string", "i": "integer", "f": "float", "b": "boolean", "l": "list", "n": "null", "m": "map"}
    shown = {r.key: r.v for r in entity(spark).props.select("key", text.rendered(F.col("kind"), F.col("raw"), F.col("num")).alias("v")).collect()}
    assert shown["power"] == "75.000000" and shown["status"] == '"active"' and shown["gone"] == "null"
    groups = language.grouped(spark.createDataFrame([("swrl:b",), ("swrl:a",), ("x",), ("x",)], "e string"), "e").collect()
    assert {(r.prefix, r.expression, r.n) for r in groups} == {("swrl", "swrl:a", 1), ("swrl", "swrl:b", 1), (None, "x", 2)}


def test_search_and_context(world, spark):
    got = lambda **k: ids(search.search(world, **k))
    assert got(code="A") == ["a"] and got(type_="ship") == ["a"] and got(subclass_of="thing") == ["a", "b"] and got(subclass_of="ship") == ["a"] and got(keyword="ALPHA") == ["a", "c"]
    assert got(keyword="a", props={"speed": 3}) == ["a"] and got(keyword="alpha", subclass_of="thing") == ["a"] and got() == ["a", "b", "c", "x"]
    places = versions.insert(world, [{"labels": ["Entity"], "id": "p", "code": "P", "lat": 10.0, "lon": 20.0}, {"labels": ["Entity"], "id": "q", "code": "Q", "lat": 11.0, "lon": 20.0}])
    assert ids(search.search(places, near=(10.1, 20.0, 50_000))) == ["p"]
    about = search.context(world, "a")
    assert {r.key for r in about["properties"].collect()} >= {"color", "mass", "speed"} and {(r.ancestor, r.depth) for r in about["types"].collect()} == {("t:ship", 0), ("t:thing", 1)}
    assert {r.rel_type: r.samples for r in about["incoming"].collect()} == {"near": ["c"]} and about["outgoing"].count() == 4


def test_ontology_and_tools(spark):
    o = ontology.Ontology([ontology.ClassDecl("P", "Person"), ontology.ClassDecl("S", super_classes=("P",))], [ontology.PropertyDecl("knows", "P", "P", aspects=("symmetric",))], [ontology.IndividualDecl("a", types=("S",), values=(("age", 3),), links=(("knows", "b"),))])
    g = o.graph(spark)
    assert {(r.src, r.rel_type, r.dst, r.value) for r in g.edges.collect()} == {("S", "subClassOf", "P", None), ("P", "HAS_PROPERTY", "knows", None), ("knows", "HAS_RANGE", "P", None), ("a", "INSTANCE_OF", "S", None), ("a", "HAS_VALUE", "age", "3"), ("a", "knows", "b", None)}
    assert g.props.where("key = 'symmetric' AND raw = 'true'").count() == 1
    assert len(tools.ENGINE_TOOLS) == 13 and tools.ENGINE_TOOLS.find("create_type").as_dict()["function"]["parameters"]["required"] == ["name"] and tools.ENGINE_TOOLS.find("none") is None
    assert tools.schema_of({"a": [1], "b": 2.5, "c": True, "d": None})["properties"] == {"a": {"type": "array", "items": {"type": "integer"}}, "b": {"type": "number"}, "c": {"type": "boolean"}, "d": {"type": "null"}}
    assert tools.Call("f", '{"a": 1}').parsed() == {"a": 1}
    with pytest.raises(ValueError, match="object"):
        tools.Call("f", "[1]").parsed()
    assert tools.describe(NodePattern("Entity", {"k": 1}), EdgePattern("r", "in"), NodePattern()) == "Entity where k is 1 with r from any node"
    items = spark.range(1).select(text.string_items(F.lit('["a", 1, "b", null, {"c": 1}]')).alias("x"), text.string_items(F.lit("bad")).alias("y")).first()
    assert items.x == ["a", "b"] and items.y is None


def test_vocabulary():
    assert len(vocab.RELATIONS) == 15 and len(vocab.OWL_LABELS) == 6 and vocab.DOMAIN_LABELS[0] == "Entity" and len(vocab.AUDIT_KEYS) == 10 and len(vocab.EDGE_ACTION_KEYS) == 9
    assert vocab.ENTITY_OF_LABEL["Property"] == "ObjectProperty" and vocab.LABEL_OF_ENTITY["DatatypeProperty"] == "Property" and vocab.AXIOM_OF_RELATION["INSTANCE_OF"] == "ClassAssertion"
    assert vocab.is_annotation("label") and vocab.is_aspect("transitive") and not vocab.is_aspect("iri") and vocab.is_known_label("Rule") and not vocab.is_known_label("Nope")
    assert vocab.is_individual_label("Event") and vocab.is_class_label("Type") and not vocab.is_class_label("Entity") and vocab.is_known_relation("subClassOf") and not vocab.is_known_relation("oneOf")
    assert vocab.rdf_type("Class") == "owl:Class" and vocab.RDF_PREDICATES["SubClassOf"] == "rdfs:subClassOf"


def test_a_database_as_store(world, spark, tmp_path):
    spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", f"{tmp_path}/derby.log")
    store = G.JdbcStore("jdbc:derby:memory:graphs;create=true", (("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver"),))
    store.save(world)
    again = G.build(store, spark)
    for name in ("nodes", "edges", "props"):
        rows = lambda g: sorted(map(repr, getattr(g, name).collect()))  # noqa: B023, E731
        assert rows(again) == rows(world), name
