"""Description-logic class expressions: an algebra over sets of individuals, compiled into one DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ExpressionError
from ..sources.graph import Graph
from ..vocab import INSTANCE_OF


@dataclass(frozen=True)
class Expr:
    """A node of a class expression. ``op`` names the constructor, ``args`` are texts, numbers and expressions in the order of the key syntax."""

    op: str
    args: tuple = ()

    def __str__(self) -> str:
        if self.op in ("Top", "Bottom"):
            return self.op
        sep = ";" if self.op == "OneOf" else ","
        return f"{self.op}({sep.join(map(str, self.args))})"

    def __and__(self, other: Expr) -> Expr:
        return Expr("Intersection", (self, other))

    def __or__(self, other: Expr) -> Expr:
        return Expr("Union", (self, other))

    def __invert__(self) -> Expr:
        return Expr("Complement", (self,))


TOP, BOTTOM = Expr("Top"), Expr("Bottom")


def named(iri: str) -> Expr:
    return Expr("ClassName", (iri,))


def some(relation: str, filler: Expr = TOP) -> Expr:
    return Expr("SomeValuesFrom", (relation, filler))


def only(relation: str, filler: Expr) -> Expr:
    return Expr("AllValuesFrom", (relation, filler))


def at_least(n: int, relation: str, filler: Expr = TOP) -> Expr:
    return Expr("MinCardinality", (n, relation, filler))


def at_most(n: int, relation: str, filler: Expr = TOP) -> Expr:
    return Expr("MaxCardinality", (n, relation, filler))


def exactly(n: int, relation: str, filler: Expr = TOP) -> Expr:
    return Expr("ExactCardinality", (n, relation, filler))


def one_of(*iris: str) -> Expr:
    return Expr("OneOf", iris)


def has_self(relation: str) -> Expr:
    return Expr("SelfRestriction", (relation,))


#: What the arguments of each constructor are: t(ext), n(umber), e(xpression).
SHAPES = {"ClassName": "t", "Intersection": "ee", "Union": "ee", "Complement": "e", "SomeValuesFrom": "te", "AllValuesFrom": "te", "MinCardinality": "nte", "MaxCardinality": "nte", "ExactCardinality": "nte", "SelfRestriction": "t"}


def _split(text: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:k])
            at = k + 1
    return [*out, text[at:]]


def parse(key: str) -> Expr:
    """The expression of a key such as ``SomeValuesFrom(R,Union(ClassName(a),Top))``."""
    key = key.strip()
    if key in ("Top", "Bottom"):
        return Expr(key)
    op, opened, rest = key.partition("(")
    if not opened or not rest.endswith(")") or op not in {*SHAPES, "OneOf"}:
        raise ExpressionError(f"not a class expression: {key!r}")
    inner = rest[:-1]
    if op == "OneOf":
        return Expr(op, tuple(x.strip() for x in inner.split(";") if x.strip()))
    args = [inner] if SHAPES[op] == "t" else _split(inner)
    if len(args) != len(SHAPES[op]):
        raise ExpressionError(f"{op} takes {len(SHAPES[op])} arguments: {key!r}")
    try:
        return Expr(op, tuple(parse(a) if s == "e" else int(a) if s == "n" else a.strip() for s, a in zip(SHAPES[op], args)))
    except ValueError as e:
        raise ExpressionError(f"not a number in {key!r}") from e


def instances(graph: Graph, expression: Expr | str, version: str | None = None) -> DataFrame:
    """The set of individuals (column iri) of a class expression; equal parts of it are built once."""
    if isinstance(expression, str):
        expression = parse(expression)
    graph = graph.of_version(version)
    known: dict[str, DataFrame] = {}

    def edges(relation: str) -> DataFrame:
        return graph.edges.where(F.col("rel_type") == relation).select(F.col("src").alias("iri"), F.col("dst"))

    def into(relation: str, filler: Expr) -> DataFrame:
        """Edges of a relation whose end is in the filler; the filler Top restricts ends to individuals."""
        return edges(relation).join(build(filler).withColumnRenamed("iri", "dst"), "dst", "left_semi")

    def make(e: Expr) -> DataFrame:
        a = e.args
        match e.op:
            case "Top":
                return graph.individuals().distinct()
            case "Bottom":
                return graph.individuals().where(F.lit(False))
            case "ClassName":
                own = graph.edges.where((F.col("rel_type") == INSTANCE_OF) & (F.col("dst") == a[0])).select(F.col("src").alias("iri"))
                return graph.individuals().distinct().join(own, "iri", "left_semi")
            case "Intersection":
                return build(a[0]).join(build(a[1]), "iri", "left_semi")
            case "Union":
                return build(a[0]).union(build(a[1])).distinct()
            case "Complement":
                return build(TOP).join(build(a[0]), "iri", "left_anti")
            case "SomeValuesFrom":
                return build(TOP).join(into(*a), "iri", "left_semi")
            case "AllValuesFrom":
                # no edge of the relation may leave the filler: two anti-joins
                outside = edges(a[0]).join(build(a[1]).withColumnRenamed("iri", "dst"), "dst", "left_anti")
                return build(TOP).join(outside, "iri", "left_anti")
            case "MinCardinality" | "MaxCardinality" | "ExactCardinality":
                n, relation, filler = a
                counts = into(relation, filler).groupBy("iri").agg(F.count(F.lit(1)).alias("n"))
                if e.op == "MinCardinality" and n > 0:
                    return build(TOP).join(counts.where(F.col("n") >= n), "iri", "left_semi")
                if e.op == "MaxCardinality":
                    return build(TOP).join(counts.where(F.col("n") > n), "iri", "left_anti")
                if e.op == "ExactCardinality" and n > 0:
                    return build(TOP).join(counts.where(F.col("n") == n), "iri", "left_semi")
                return build(TOP).join(counts, "iri", "left_anti") if e.op == "ExactCardinality" else build(TOP)
            case "OneOf":
                return graph.spark.createDataFrame([(x,) for x in dict.fromkeys(a)], "iri string")
            case "SelfRestriction":
                return build(TOP).join(edges(a[0]).where(F.col("iri") == F.col("dst")), "iri", "left_semi")
        raise ExpressionError(f"unknown constructor {e.op}")

    def build(e: Expr) -> DataFrame:
        key = str(e)
        if key not in known:
            known[key] = make(e)
        return known[key]

    return build(expression)


@dataclass(frozen=True)
class Result:
    """What a class expression came to: its key, how many individuals it has, and the first few of them."""

    expression: str
    count: int
    sample: tuple[str, ...]


def result(graph: Graph, expression: Expr | str, version: str | None = None, sample: int = 10) -> Result:
    found = instances(graph, expression, version)
    return Result(str(expression), found.count(), tuple(r.iri for r in found.orderBy("iri").limit(sample).collect()))


def subsumes(graph: Graph, upper: Expr | str, lower: Expr | str, version: str | None = None) -> DataFrame:
    """One row (holds): whether every instance of ``lower`` is one of ``upper``; true if there are none."""
    outside = instances(graph, lower, version).join(instances(graph, upper, version), "iri", "left_anti")
    return outside.limit(1).agg((F.count(F.lit(1)) == 0).alias("holds"))


def is_instance(graph: Graph, iri: str, expression: Expr | str, version: str | None = None) -> DataFrame:
    """One row (holds): whether an individual is in the expression."""
    return instances(graph, expression, version).where(F.col("iri") == iri).limit(1).agg((F.count(F.lit(1)) > 0).alias("holds"))
