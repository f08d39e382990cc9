import random

import pytest

from graphloom.errors import FixpointError, RuleError
from graphloom.functions import builtins
from graphloom.operators import classes
from graphloom.plans import confidence, fixpoint
from graphloom.plans.reason import Reasoner
from graphloom.plans.rules import Parser
from graphloom.sources.graph import from_rows
from tests.graphs import NS, demo, family

PARSER = Parser(default=NS)


def triples(df):
    return {(r.subject, r.predicate, r.object) for r in df.collect()}


@pytest.mark.parametrize(
    ("text", "name", "atoms"),
    [
        ("[moored: :Boat(?b) -> :Vessel(?b)]", "moored", (1, 1)),
        ("[relay-2: feeds(?a, ?b) ^ feeds(?b, ?c) -> reaches(?a, ?c) ^ :Source(?a)]", "relay-2", (2, 2)),
        ("[deep: :Lake(?l) ^ depth(?l, ?d) ^ swrlb:lessThanOrEqual(200, ?d) -> :DeepLake(?l)]", "deep", (3, 1)),
        ("[twin: :Star(?s) ^ :Star(?t) ^ sameAs(?s, ?t) -> :Twin(?s)]", "twin", (3, 1)),
        ("[:Leaf(?l) -> :Part(?l)]", "", (1, 1)),
        ("[geo:City(?c) -> geo:Place(?c)]", "", (1, 1)),
    ],
)
def test_parse(text, name, atoms):
    rule = PARSER.parse(text)
    assert (rule.name, (len(rule.body), len(rule.head)), rule.safe) == (name, atoms, True)


def test_parse_prefixes_and_errors():
    assert Parser({"geo": "http://maps.test/"}).parse("[geo:City(?c) -> geo:Place(?c)]").head[0].name == "http://maps.test/Place"
    for bad in ("[loose: :Boat(?b) -> owns(?o, ?b)]", ":Boat(?b) -> :Vessel(?b)", "[no arrow: :Boat(?b)]", "[x: :Boat(?b) -> ]", "[x: words -> :Boat(?b)]"):
        with pytest.raises(RuleError):
            PARSER.parse(bad)
    text = "# boats\n\n[a: :Boat(?b) -> :Vessel(?b)]\nwords\n"
    assert [r.name for r in PARSER.parse_all(text)] == ["a"]
    with pytest.raises(RuleError):
        PARSER.parse_all("words\nmore words")


def test_products_are_asked_for(spark):
    g = from_rows(spark, [], [{"src": a, "rel_type": r, "dst": "k"} for a, r in (("a", "p"), ("b", "p"), ("b", "q"))])
    rule = Parser().parse("[x: p(?a,?k) ^ q(?b,?l) -> r(?a,?b)]")
    with pytest.raises(FixpointError, match="products"):
        fixpoint.derive_once(g, rule)
    assert triples(fixpoint.derive_once(g, rule, products=True)) == {("a", "r", "b"), ("b", "r", "b")} == triples(fixpoint.run(g, [rule], products=True).facts)
    same = Parser().parse("[x: p(?a,?k) ^ q(?b,?l) ^ sameAs(?b,?a) -> r(?a,?b)]")
    assert triples(fixpoint.derive_once(g, same)) == {("b", "r", "b")}


def test_uncle_and_termination(spark):
    g = family(spark)
    rule = Parser(prefixes={"e": NS}).parse("[uncle: e:hasParent(?x,?y) ^ e:hasBrother(?y,?z) -> e:hasUncle(?x,?z)]")
    out = fixpoint.run(g, [rule])
    assert triples(out.facts) == {(NS + "Alice", NS + "hasUncle", NS + "Charlie")} and out.state is fixpoint.State.CONVERGED
    same = fixpoint.run(g, [PARSER.parse("[same: :Person(?x) -> :Person(?x)]")], max_iterations=5)
    assert same.derived == 0 and same.rounds == 1  # what is known is not derived


def test_demo_and_facade(spark):
    r = Reasoner(demo(spark), max_iterations=10, parser=Parser())
    r.load_rules("[uncle: hasParent(?x,?y) ^ hasBrother(?y,?z) -> hasUncle(?x,?z)]\n[inverse: hasBrother(?x,?y) -> hasBrother(?y,?x)]")
    out = r.reason()
    assert out.stats["total_derived"] >= 4 and r.list_rules()[0] == {"name": "uncle", "body_atoms": 2, "head_atoms": 1}
    assert {"Alice", "Eve"} <= {x.iri for x in r.query(classes.some("hasUncle", classes.named("Person"))).collect()}
    assert r.is_subclass("ClassName(Person)", "Top") and r.is_instance("Bob", "SomeValuesFrom(hasBrother,Top)")
    r.switch_mode("exercise")
    assert r.mode is confidence.Mode.BALANCED


def test_values_properties_and_deferred_calls(spark):
    g = demo(spark)
    got = lambda text: triples(fixpoint.derive_once(g, Parser().parse(text)))
    assert got("[a: hasAge(?x,?v) ^ swrlb:greaterThan(?v, 30) -> old(?x,?x)]") == {("Bob", "old", "Bob")}
    assert got("[a: hasAge(?x,25) -> young(?x,?x)]") == {("Alice", "young", "Alice")}
    assert got("[a: hasAge(?x,?v) ^ swrlb:greaterThan(?w, 30) -> any(?x,?x)]") == {(x, "any", x) for x in ("Alice", "Bob")}
    assert got("[a: hasAge(?x,?v) ^ swrlb:greaterThan(?v, word) -> any(?x,?x)]") == set()
    assert got("[a: hasAge(?x,?v) ^ swrlb:unknown(?v) -> any(?x,?x)]") == set()
    assert got("[a: hasBrother(?x,?x) -> self(?x,?x)]") == set()
    n = from_rows(spark, [{"labels": ["Individual"], "iri": "a", "speed": 50}, {"labels": ["Individual"], "iri": "b", "speed": 5}, {"labels": ["Individual"], "iri": "c"}],
                  [{"src": i, "rel_type": "INSTANCE_OF", "dst": "T"} for i in "abc"])
    fast = fixpoint.derive_once(n, Parser().parse("[f: T(?x) ^ swrlb:greaterThan(?x.speed, 40) -> fast(?x,?x)]"))
    assert triples(fast) == {("a", "fast", "a")}


def test_closure_against_naive_evaluation(spark):
    rng = random.Random(3)
    for seed in range(3):
        pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(16)}
        g = from_rows(spark, [], [{"src": a, "rel_type": "p", "dst": b} for a, b in pairs])
        rules = Parser().parse_all("[a: p(?x,?y) -> q(?x,?y)]\n[b: q(?x,?y) ^ q(?y,?z) -> q(?x,?z)]\n[c: q(?x,?y) ^ p(?y,?x) -> loop(?x,?y)]")
        q = set(pairs)
        while more := {(a, d) for a, b in q for c, d in q if b == c} - q:
            q |= more
        want = {(a, "q", b) for a, b in q} | {(a, "loop", b) for a, b in q if (b, a) in pairs}
        assert triples(fixpoint.run(g, rules).facts) == want, seed


def test_limits_gate_and_hooks(spark):
    g = from_rows(spark, [], [{"src": f"n{i}", "rel_type": "p", "dst": f"n{i + 1}"} for i in range(8)])
    rules = Parser().parse_all("[a: p(?x,?y) -> q(?x,?y)]\n[b: q(?x,?y) ^ p(?y,?z) -> q(?x,?z)]")
    seen = []
    out = fixpoint.run(g, rules, max_iterations=3, on_round=lambda new: seen.append(new.count()))
    assert out.state is fixpoint.State.MAX_ITERATIONS and seen == [8, 7, 6] and out.per_rule == {"a": 8, "b": 13}
    tripped = fixpoint.run(g, rules, threshold=0.99)
    assert tripped.state is fixpoint.State.FUSE_TRIPPED and tripped.derived == 0 and tripped.gate.trips

    def stop(new):
        raise ValueError("stop")

    with pytest.raises(ValueError, match="stop"):
        fixpoint.run(g, rules, on_round=stop)


def test_builtins(spark):
    from pyspark.sql import functions as F

    lit, b = F.lit, builtins.BUILTINS
    cases = {
        "gt": (b["greaterThan"](lit(10), lit(5)), True), "lt": (b["lessThan"](lit(3), lit(7)), True), "add": (b["add"](lit(3), lit(4)), "7"), "addf": (b["add"](lit("1.5"), lit(1)), "2.5"),
        "has": (b["contains"](lit("hello world"), lit("world")), True), "text": (b["lessThan"](lit("a"), lit("b")), True), "mixed": (b["lessThan"](lit("a"), lit(1)), None),
        "div": (b["divide"](lit(1), lit(4)), "0.25"), "div0": (b["divide"](lit(1), lit(0)), None), "neg": (b["booleanNot"](lit("true")), False), "len": (b["listLength"](lit("a, b,,c")), "3"),
        "in": (b["listContains"](lit("a, b,c"), lit("b")), True), "abs": (b["abs"](lit(-3)), "3"), "eq": (b["equal"](lit("5.0"), lit(5)), True), "ne": (b["notEqual"](lit("a"), lit("b")), True), "cat": (b["concat"](lit("a"), lit(1)), "a1"),
    }
    row = spark.range(1).select(*(c.alias(k) for k, (c, _) in cases.items())).first()
    assert row.asDict() == {k: v for k, (_, v) in cases.items()}
    builtins.register("isShort", lambda a: F.length(builtins.text(a)) < 3)
    assert spark.range(1).select(builtins.holds("swrlb:isShort", [lit("ab")]).alias("x")).first().x is True
    del builtins.BUILTINS["isShort"]


def test_confidence():
    w = confidence.weighted
    assert w(1, 1, 1, 1) == 1 and w(0, 0, 0, 0) == 0 and abs(w(0.8, 0.5, 0.9, 0.7) - 0.745) < 1e-9 and w(0.2, 0.3, 0.1, 0.2) < 0.3
    gate = confidence.Gate(0.3)
    assert gate.check(0.45, "r") and not gate.tripped and not gate.check(0.25, "r") and gate.trips == [(0.25, 0.3, "r")]
    gate.reset()
    assert not gate.tripped
    assert [m.value for m in confidence.Mode] == [0.15, 0.30, 0.50] and confidence.Mode.of("training") is confidence.Mode.PERMISSIVE
