"""Transitive rules: the rounds of a plain evaluation, without joining each way between two nodes."""

import random

import pytest

from graphloom.plans import closure, fixpoint
from graphloom.plans.confidence import rule_score
from graphloom.plans.rules import Parser
from graphloom.sources.graph import from_rows

BASE, STEP = "[base: p(?x,?y) -> q(?x,?y)]", "[step: q(?x,?y) ^ q(?y,?z) -> q(?x,?z)]"
CHAIN = [(f"n{i}", f"n{i + 1}") for i in range(21)]
RNG = random.Random(7)


def joined(spark, since):
    """The rows that joins made in queries after the first ``since``."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, rows = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList()
    for k in range(since, runs.size()):
        number = runs.apply(k).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    rows += int(values.apply(m.accumulatorId()).replace(",", ""))
    return rows


def plain(pairs, own=()):
    """Facts by round of the rules, all bindings joined: {(subject, object): (rule, confidence, iter)}, as base has one variable an atom more."""
    known, facts, new = set(own), {}, None
    while True:
        n = len(facts)
        ways = [(a, d) for a, b in known for c, d in known if b == c and (new is None or (a, b) in new) or (b == c and new is not None and (c, d) in new)]
        ways += [(a, d) for a, b in new or () for c, d in new or () if b == c]
        found = {x: ("step", rule_score(3, 2, len(ways))) for x in ways}
        found |= {x: ("base", rule_score(2, 1, len(set(pairs)))) for x in pairs if new is None}
        found = {x: v for x, v in found.items() if x not in known}
        facts |= {x: (*v, (max((f[2] for f in facts.values()), default=0) + 1)) for x, v in found.items()}
        new = set(found)
        known |= new
        if len(facts) == n:
            return facts


def run(spark, pairs, own=()):
    edges = [{"src": a, "rel_type": r, "dst": b} for r, ab in (("p", pairs), ("q", own)) for a, b in ab]
    return fixpoint.run(from_rows(spark, [], edges), Parser().parse_all(f"{BASE}\n{STEP}" if pairs else STEP))


def same(out, want):
    rows = out.facts.collect()
    got = {(r.subject, r.object): (r.rule, round(r.confidence, 9), r.iter) for r in rows}
    assert len(rows) == len(got) == out.derived and got == {x: (r, round(c, 9), i) for x, (r, c, i) in want.items()}
    assert out.state is fixpoint.State.CONVERGED and {(r.kind, r.predicate) for r in rows} <= {("relation", "q")}


GRAPHS = {
    "chain": CHAIN,
    "short": CHAIN[:2],
    "tree up": [(f"n{i}", f"n{(i - 1) // 2}") for i in range(1, 40)],
    "tree down": [(f"n{(i - 1) // 3}", f"n{i}") for i in range(1, 40)] + [("m0", "m1")],
    "ring": [*CHAIN[:9], ("n9", "n0")],
    "into a ring": [*CHAIN, ("n21", "n14"), ("m0", "m1")],
    "out of a ring": [(b, a) for a, b in [*CHAIN, ("n21", "n14")]],
    "two ways": [*CHAIN[:9], ("n1", "m1"), ("m1", "m2"), ("m2", "n7")],
    "itself": [*CHAIN[:5], ("n5", "n5")],
    "any": list({(f"n{RNG.randrange(11)}", f"n{RNG.randrange(11)}") for _ in range(15)}),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_rounds_are_those_of_all_bindings(spark, name):
    same(run(spark, GRAPHS[name]), plain(GRAPHS[name]))


def test_facts_of_the_graph_itself(spark):
    same(run(spark, (), [*CHAIN, ("n3", "n9")]), plain((), [*CHAIN, ("n3", "n9")]))
    same(run(spark, CHAIN[:6], [("n6", "n7"), ("n2", "n1")]), plain(CHAIN[:6], [("n6", "n7"), ("n2", "n1")]))


@pytest.mark.parametrize(("longest", "few"), [(1, 0), (4, 0), (1024, 0)])
def test_long_ways_and_many_ends(spark, monkeypatch, longest, few):
    monkeypatch.setattr(closure, "LONGEST", longest)
    monkeypatch.setattr(closure, "FEW", few)
    for name in ("chain", "tree down", "into a ring"):
        same(run(spark, GRAPHS[name]), plain(GRAPHS[name]))


def test_joins_make_no_more_than_facts(spark):
    """All bindings of a chain of 60 are some 60 000, and its facts 1 770."""
    chain = [(f"n{i}", f"n{i + 1}") for i in range(59)]
    for pairs in (chain, [*chain, ("m1", "n1"), ("n1", "m3")]):
        since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
        out = run(spark, pairs)
        made = joined(spark, since)
        assert out.derived >= 1770 and 0 < made < 3 * out.derived
