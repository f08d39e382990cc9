import random

import pytest

from graphloom.errors import ExpressionError
from graphloom.operators import classes as c
from graphloom.sources.graph import from_rows


def naive(e, individuals, edges):
    a = e.args
    go = lambda x: naive(x, individuals, edges)
    out = lambda i, r: [d for s, t, d in edges if s == i and t == r]
    match e.op:
        case "Top":
            return set(individuals)
        case "Bottom":
            return set()
        case "ClassName":
            return {i for i in individuals if a[0] in out(i, "INSTANCE_OF")}
        case "Intersection":
            return go(a[0]) & go(a[1])
        case "Union":
            return go(a[0]) | go(a[1])
        case "Complement":
            return set(individuals) - go(a[0])
        case "SomeValuesFrom":
            return {i for i in individuals if set(out(i, a[0])) & go(a[1])}
        case "AllValuesFrom":
            return {i for i in individuals if set(out(i, a[0])) <= go(a[1])}
        case "OneOf":
            return set(a)
        case "SelfRestriction":
            return {i for i in individuals if i in out(i, a[0])}
    n = {i: sum(d in go(a[2]) for d in out(i, a[1])) for i in individuals}
    return {i for i, k in n.items() if {"MinCardinality": k >= a[0], "MaxCardinality": k <= a[0], "ExactCardinality": k == a[0]}[e.op]}


def random_expression(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([c.TOP, c.BOTTOM, c.named("A"), c.named("B"), c.one_of("i1", "i2"), c.has_self("r")])
    sub = lambda: random_expression(rng, depth - 1)
    n, r = rng.randint(0, 2), rng.choice("rs")
    return rng.choice([lambda: sub() & sub(), lambda: sub() | sub(), lambda: ~sub(), lambda: c.some(r, sub()), lambda: c.only(r, sub()), lambda: c.at_least(n, r, sub()), lambda: c.at_most(n, r, sub()), lambda: c.exactly(n, r, sub())])()


def test_random_expressions_against_naive_evaluation(spark):
    rng = random.Random(11)
    individuals = [f"i{k}" for k in range(9)]
    edges = {(rng.choice(individuals), "INSTANCE_OF", rng.choice("AB")) for _ in range(9)} | {(rng.choice(individuals), rng.choice("rs"), rng.choice(individuals)) for _ in range(16)}
    g = from_rows(spark, [{"labels": ["Individual"], "iri": i} for i in individuals] + [{"labels": ["Class"], "iri": x} for x in "AB"], [dict(zip(("src", "rel_type", "dst"), e)) for e in sorted(edges)])
    for _ in range(25):
        e = random_expression(rng, 2)
        rows = [r.iri for r in c.instances(g, e).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == naive(e, individuals, edges), str(e)
        assert c.parse(str(e)) == e


def test_keys_and_errors(spark):
    e = c.parse("Intersection(ClassName(a),MinCardinality(2,r,Union(Top,OneOf(x;y))))")
    assert str(e) == "Intersection(ClassName(a),MinCardinality(2,r,Union(Top,OneOf(x;y))))"
    for bad in ("", "Nothing(a)", "Union(Top)", "MinCardinality(x,r,Top)", "ClassName(a"):
        with pytest.raises(ExpressionError):
            c.parse(bad)


def test_fixture_and_forms(spark):
    g = from_rows(spark, [{"labels": ["Individual"], "iri": "Alice"}, {"labels": ["Individual"], "iri": "Bob"}], [{"src": "Alice", "rel_type": "INSTANCE_OF", "dst": "Person"}, {"src": "Bob", "rel_type": "INSTANCE_OF", "dst": "Animal"}])
    got = lambda e: sorted(r.iri for r in c.instances(g, e).collect())
    assert got(c.named("Person")) == ["Alice"] and got(c.named("Person") | c.named("Animal")) == ["Alice", "Bob"]
    assert c.subsumes(g, "ClassName(Person)", "ClassName(Person)").first().holds and c.subsumes(g, c.named("Person"), c.BOTTOM).first().holds
    assert not c.subsumes(g, c.named("Person"), c.TOP).first().holds
    assert c.is_instance(g, "Bob", ~c.named("Person")).first().holds and not c.is_instance(g, "Bob", "ClassName(Person)").first().holds
