import pytest

from graphloom.errors import ShapeError
from graphloom.operators import behavior, shapes
from graphloom.operators.shapes import Constraint as C
from graphloom.operators.shapes import Path, PropertyShape, Shape, predicate
from graphloom.sources.graph import from_rows
from tests.graphs import entity


@pytest.fixture(scope="module")
def things(spark):
    nodes = [{"labels": ["Entity"], "id": "n1", "code": "E001", "tag": "ABC123", "size": 42, "note": "é", "list": [1, 2], "none": None},
             {"labels": ["Entity"], "id": "n2", "code": "E002", "tag": "abc", "size": "7", "note": ""}, {"labels": ["Event"], "id": "n3", "code": "EV001"}]
    edges = [{"src": "n1", "rel_type": "part", "dst": "n2"}, {"src": "n2", "rel_type": "part", "dst": "n3"}, {"src": "n3", "rel_type": "part", "dst": "n1"}]
    return from_rows(spark, nodes, edges)


def broken(g, path, *constraints, target=("class", "Entity"), **more):
    path = predicate(path) if isinstance(path, str) else path
    report = shapes.validate(g, [Shape("S", (target,), (PropertyShape(path, constraints, **more),))])
    return sorted(r.focus for r in report.collect())


@pytest.mark.parametrize(
    ("path", "constraint", "want"),
    [
        ("code", C("required"), []), ("missing", C("required"), ["n1", "n2"]), ("size", C("min_inclusive", 0), []), ("size", C("min_inclusive", 10), ["n2"]), ("size", C("min_inclusive", 100), ["n1", "n2"]),
        ("size", C("max_exclusive", 42), ["n1"]), ("size", C("min_exclusive", 7), ["n2"]), ("tag", C("min_inclusive", 5), []), ("tag", C("pattern", r"^[A-Z]+\d+$"), ["n2"]), ("size", C("pattern", "^x"), ["n2"]),
        ("size", C("datatype", "Int"), ["n2"]), ("size", C("datatype", "String"), ["n1"]), ("size", C("datatype", "Other"), []), ("note", C("min_length", 1), ["n2"]), ("note", C("max_bytes", 1), ["n1"]), ("list", C("max_length", 1), ["n1"]),
        ("note", C("non_empty"), ["n2"]), ("none", C("non_empty"), ["n1"]), ("none", C("required"), ["n2"]), ("size", C("in", (42, "8")), ["n2"]), ("size", C("has_value", 42), ["n2"]), ("tag", C("language_in", ("en",)), []),
        ("size", C("not", (C("min_inclusive", 10),)), ["n1"]), ("size", C("or", (C("datatype", "String"), C("min_inclusive", 50))), ["n1"]), ("size", C("and", (C("datatype", "Int"), C("max_inclusive", 50))), ["n2"]),
        ("size", C("custom", lambda kind, raw, num: raw == "7"), ["n1"]), ("part", C("class", "Entity"), ["n2"]), ("part", C("node_kind", "iri"), []), ("part", C("max_count", 0), ["n1", "n2"]), ("tag", C("min_count", 2), ["n1", "n2"]),
        (Path("sequence", (predicate("part"), predicate("code"))), C("in", ("E002",)), ["n2"]), (Path("inverse", (predicate("part"),)), C("class", "Event"), ["n2"]),
        (Path("alternative", (predicate("tag"), predicate("note"))), C("min_count", 3), ["n1", "n2"]), (Path("one_or_more", (predicate("part"),)), C("max_count", 1), ["n1", "n2"]), (Path("zero_or_more", (predicate("part"),)), C("min_count", 4), ["n1", "n2"]),
        (Path("sequence", (predicate("part"), predicate("part"), predicate("part"))), C("class", "Event"), ["n1", "n2"]),
        ("size", C("qualified_min", (1, C("datatype", "Int"))), ["n2"]), ("size", C("qualified_max", (0, C("datatype", "Int"))), ["n1"]),
    ],
)
def test_constraints(things, path, constraint, want):
    assert broken(things, path, constraint) == want


def test_report_severity_and_targets(things, spark):
    a = Shape("A", (("all", ""),), (PropertyShape(predicate("missing"), (C("required"),), message="needs it", suggestion="add it"),))
    b = Shape("B", (("node", "E001"), ("node", "n1")), (PropertyShape(predicate("size"), (C("min_inclusive", 50),)),), severity=shapes.WARNING)
    off = Shape("C", (("all", ""),), (PropertyShape(predicate("x"), (C("required"),)),), deactivated=True)
    all_ = shapes.Shapes()
    for s in (a, b, off):
        all_.add(s)
    report = shapes.validate(things, all_)
    assert {(r.shape, r.n) for r in shapes.grouped(report).collect()} == {("A", 3), ("B", 1)}
    assert tuple(shapes.summary(report).first()) == (3, 1, 0, False)
    first = report.where("shape = 'A'").first()
    assert (first.message, first.suggestion, first.severity) == ("needs it", "add it", "Violation")
    assert shapes.summary(shapes.validate(things, [b])).first().conforms
    focus = lambda *t: sorted(r.focus for r in shapes.focus_nodes(things, Shape("T", t)).collect())
    assert focus(("subjects_of", "tag")) == ["n1", "n2"] and focus(("subjects_of", "part")) == ["n1", "n2", "n3"] and focus(("objects_of", "part")) == ["n1", "n2", "n3"]
    all_.remove("A")
    assert [s.name for s in all_.active()] == ["B"] and shapes.validate(things, []).count() == 0
    node = lambda *c: sorted(r.focus for r in shapes.validate(things, [Shape("N", (("all", ""),), (), c)]).collect())
    assert node(C("class", "Entity")) == ["n3"] and node(C("not", (C("class", "Entity"),))) == ["n1", "n2"] and node(C("xone", (C("class", "Entity"), C("class", "Event")))) == []
    twins = from_rows(spark, [{"labels": ["Entity"], "id": i, "key": "same"} for i in "ab"], [])
    assert broken(twins, "key", C("unique")) == ["a", "b"] and broken(twins, "key", C("unique_per_node")) == []
    with pytest.raises(ShapeError):
        broken(things, "tag", C("pattern", "("))
    with pytest.raises(ShapeError):
        broken(things, "tag", C("nonsense"))


TRUE = ["", "True", "true", None, "status = active", "status != inactive", "power > 50", "power < 100", "power >= 75", "required(status)", "exists(code)", "exists(gone)", 'status matches "^act"', "any words", "status == active", "speed <= 30"]
FALSE = ["False", "false", "status = inactive", "status != active", "power > 100", "power < 50", "power >= 100", "required(nonexistent)", "exists(missing_field)", 'status matches "^xxx"', "required(gone)", "required(empty)", "status > 5", "missing >= 1", 'status matches "a=b"']


def test_preconditions(spark):
    g = entity(spark)
    rows = spark.createDataFrame([("n1", t, k) for k, t in enumerate(TRUE + FALSE)], "node_id string, precondition string, k int")
    got = {r.k: r.passes for r in behavior.passes(g, rows).collect()}
    assert [got[k] for k in range(len(TRUE))] == [True] * len(TRUE)
    assert [got[k + len(TRUE)] for k in range(len(FALSE))] == [False] * len(FALSE)


def test_batch_effects_and_parts(spark):
    make = lambda code, **k: {"labels": ["Entity"], "code": code, **k}
    g = from_rows(spark, [make("a", hasEffect="swrl:x", hasPriority="3", hasDuration="9", composedOf="b; c ;"), make("b", hasEffect="sh:y", hasPriority="15"), make("c", hasPrecondition="False", composedOf="a"), make("d", hasPriority="5"), make("e")], [])
    rows = behavior.effects(behavior.batch(g)).orderBy("order_key").collect()
    assert [(r.code, r.priority, r.passes, r.action) for r in rows] == [("b", 10, True, "log"), ("a", 3, True, "run_rule"), ("c", 0, False, "none")]
    parts = {(r.root, r.node_id, r.depth) for r in behavior.composed(g, 5).where("root = 'a'").collect()}
    assert parts == {("a", "a", 0), ("a", "b", 1), ("a", "c", 1)}
    assert {r.depth for r in behavior.composed(g, 0).collect()} == {0}
