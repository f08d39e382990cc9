"""Shape constraints over the graph: targets, property paths and constraints become one report DataFrame.

Every (shape, path) is one plan over a relation of values (focus, kind, raw, num, node); a constraint is a predicate on values or on their count per focus.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError
from ..sources.graph import Graph
from ..values import loose_number, same
from .pattern import is_domain
from .traverse import closure

VIOLATION, WARNING, INFO = "Violation", "Warning", "Info"

REPORT = "shape string, focus string, path string, component string, value string, severity string, message string, suggestion string"


@dataclass(frozen=True)
class Path:
    """A property path: predicate, sequence, inverse, alternative, zero_or_more or one_or_more."""

    kind: str
    parts: tuple = ()

    def __str__(self) -> str:
        p = [str(x) for x in self.parts]
        return {"predicate": lambda: p[0], "sequence": lambda: "/".join(p), "inverse": lambda: f"^{p[0]}", "alternative": lambda: "|".join(p), "zero_or_more": lambda: f"{p[0]}*", "one_or_more": lambda: f"{p[0]}+"}[self.kind]()


def predicate(name: str) -> Path:
    return Path("predicate", (name,))


@dataclass(frozen=True)
class Constraint:
    """A constraint by name, with its value; see ``VALUE_TESTS``, ``COUNT_TESTS`` and the logical ones (not, and, or, xone)."""

    name: str
    value: object = None

    def __str__(self) -> str:
        if isinstance(self.value, tuple) and self.value and isinstance(self.value[0], Constraint):
            return f"{self.name}({', '.join(map(str, self.value))})"
        return self.name if self.value is None else f"{self.name}({self.value})"


@dataclass(frozen=True)
class PropertyShape:
    path: Path
    constraints: tuple[Constraint, ...]
    severity: str | None = None
    deactivated: bool = False
    message: str | None = None
    suggestion: str | None = None


@dataclass(frozen=True)
class Shape:
    """A node shape. ``targets``: pairs of class, node, subjects_of, objects_of or all with a name."""

    name: str
    targets: tuple[tuple[str, str], ...]
    properties: tuple[PropertyShape, ...] = ()
    constraints: tuple[Constraint, ...] = ()
    severity: str = VIOLATION
    deactivated: bool = False

    def with_(self, **changes) -> Shape:
        return replace(self, **changes)


@dataclass
class Shapes:
    """Shapes by name; adding one of the same name replaces it."""

    by_name: dict[str, Shape] = field(default_factory=dict)

    def add(self, shape: Shape) -> None:
        self.by_name[shape.name] = shape

    def remove(self, name: str) -> None:
        self.by_name.pop(name, None)

    def active(self) -> list[Shape]:
        return [s for s in self.by_name.values() if not s.deactivated]


def focus_nodes(graph: Graph, shape: Shape) -> DataFrame:
    """The distinct focus nodes of a shape (column focus)."""
    out = None
    for kind, name in shape.targets:
        if kind == "class":
            found = graph.labelled(name).select("node_id")
        elif kind == "node":
            found = graph.named([name]).select("node_id")
        elif kind == "subjects_of":
            found = graph.props.where(F.col("key") == name).select("node_id").unionByName(graph.edges.where(F.col("rel_type") == name).select(F.col("src").alias("node_id")))
        elif kind == "objects_of":
            found = graph.edges.where(F.col("rel_type") == name).select(F.col("dst").alias("node_id"))
        elif kind == "all":
            found = graph.nodes.where(is_domain(F.col("labels"))).select("node_id")
        else:
            raise ShapeError(f"unknown target {kind!r}")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ShapeError(f"shape {shape.name!r} has no target")
    return out.select(F.col("node_id").alias("focus")).distinct()


VALUES = ("focus", "kind", "raw", "num", "node")


def values(graph: Graph, focus: DataFrame, path: Path) -> DataFrame:
    """Values (focus, kind, raw, num, node) of a path from each focus node.

    A predicate gives a node's own property of that name, else the nodes that its edges of that name lead to: each as an iri value with ``node`` set.
    """

    def own(names: DataFrame, name: str) -> DataFrame:
        return graph.props.where(F.col("key") == name).select(F.col("node_id").alias("at"), "kind", "raw", "num").join(names, "at")

    def nodes_by(name: str, backwards: bool = False) -> DataFrame:
        e = graph.edges.where(F.col("rel_type") == name)
        return e.select(F.col("dst" if backwards else "src").alias("at"), F.col("src" if backwards else "dst").alias("node"))

    def as_values(rows: DataFrame) -> DataFrame:
        return rows.select("focus", F.lit("iri").alias("kind"), F.col("node").alias("raw"), F.lit(None).cast("double").alias("num"), "node")

    none = F.lit(None).cast("string").alias("node")
    start = focus.select("focus", F.col("focus").alias("at"))
    if path.kind == "predicate":
        name = path.parts[0]
        props = own(start, name).select("focus", "kind", "raw", "num", none)
        linked = start.join(nodes_by(name), "at")
        has = graph.props.where(F.col("key") == name).select(F.col("node_id").alias("focus"))
        return props.unionByName(as_values(linked.join(has, "focus", "left_anti")))
    if path.kind == "sequence":
        rows = values(graph, focus, path.parts[0])
        for step in path.parts[1:]:
            ends = rows.where("node IS NOT NULL").select("focus", "node").distinct()
            more = values(graph, ends.select(F.col("node").alias("focus")).distinct(), step).withColumnsRenamed({"focus": "mid"})
            rows = ends.join(more.withColumnRenamed("node", "next"), F.col("node") == F.col("mid")).select("focus", "kind", "raw", "num", F.col("next").alias("node"))
        return rows
    if path.kind == "inverse":
        inner = path.parts[0]
        if inner.kind != "predicate":
            raise ShapeError("an inverse path inverts a predicate")
        return as_values(start.join(nodes_by(inner.parts[0], True), "at"))
    if path.kind == "alternative":
        rows = values(graph, focus, path.parts[0])
        for other in path.parts[1:]:
            rows = rows.unionByName(values(graph, focus, other))
        return rows
    if path.kind in ("zero_or_more", "one_or_more"):
        inner = path.parts[0]
        if inner.kind != "predicate":
            raise ShapeError("a repeated path repeats a predicate")
        up = closure(graph.edges.where(F.col("rel_type") == inner.parts[0]).select(F.col("src").alias("node"), F.col("dst").alias("above")))
        rows = as_values(start.join(up.select(F.col("node").alias("at"), F.col("ancestor").alias("node")), "at"))
        return rows.unionByName(as_values(start.select("focus", F.col("at").alias("node")))) if path.kind == "zero_or_more" else rows
    raise ShapeError(f"unknown path {path.kind!r}")


def _number() -> Column:
    return loose_number(F.col("kind"), F.col("raw"), F.col("num"))


def _length(octets: bool = False) -> Column:
    size = F.octet_length("raw") if octets else F.length("raw")
    return F.when(F.col("kind") == "string", size).when(F.col("kind") == "list", F.size(F.from_json("raw", "array<string>")))


def _pattern(value) -> Column:
    try:
        re.compile(value)
    except re.error as e:
        raise ShapeError(f"invalid pattern {value!r}: {e}") from e
    return (F.col("kind") != "string") | F.col("raw").rlike(value)


def _datatype(value) -> Column:
    kinds = {"String": ["string"], "Int": ["integer"], "Float": ["float", "integer"], "Bool": ["boolean"], "List": ["list"], "Object": ["map"], "Iri": ["iri"]}.get(value)
    return F.col("kind").isin(*kinds) if kinds else F.lit(True)


def _members(choices) -> Column:
    hit = F.lit(False)
    for v in choices:
        hit = hit | same(F.col("kind"), F.col("raw"), v) | ((F.col("kind") == "iri") & (F.col("raw") == str(v)))
    return hit


#: Tests of single values: Columns that hold, or are null, for values that conform.
VALUE_TESTS = {
    "datatype": _datatype,
    "min_inclusive": lambda v: _number() >= v,
    "max_inclusive": lambda v: _number() <= v,
    "min_exclusive": lambda v: _number() > v,
    "max_exclusive": lambda v: _number() < v,
    "min_length": lambda v: _length() >= v,
    "max_length": lambda v: _length() <= v,
    "min_bytes": lambda v: _length(True) >= v,
    "max_bytes": lambda v: _length(True) <= v,
    "pattern": _pattern,
    "language_in": lambda v: F.lit(True),
    "in": _members,
    "non_empty": lambda v: ~((F.col("kind") == "null") | ((F.col("kind") == "string") & (F.col("raw") == "")) | ((F.col("kind") == "list") & (F.col("raw") == "[]"))),
    "node_kind": lambda v: (F.col("kind") == "iri") if v == "iri" else (F.col("kind") != "iri") if v == "literal" else F.lit(True),
}

#: Tests of the number of a focus node's values (count), of those that equal a value (hits), or of a nested shape's.
COUNT_TESTS = {"min_count", "max_count", "required", "has_value", "qualified_min", "qualified_max"}


def conforms(c: Constraint) -> Column:
    """Whether a value conforms; what a constraint doesn't apply to does."""
    if c.name == "not":
        return ~conforms(c.value[0])
    if c.name in ("and", "or"):
        out = conforms(c.value[0])
        for other in c.value[1:]:
            out = out & conforms(other) if c.name == "and" else out | conforms(other)
        return out
    if c.name == "xone":
        total = F.lit(0)
        for part in c.value:
            total = total + conforms(part).cast("int")
        return total == 1
    if c.name == "custom":
        return F.coalesce(c.value(F.col("kind"), F.col("raw"), F.col("num")), F.lit(True))
    if c.name not in VALUE_TESTS:
        raise ShapeError(f"unknown constraint {c.name!r}")
    return F.coalesce(VALUE_TESTS[c.name](c.value), F.lit(True))


def _results(rows: DataFrame, shape: Shape, path: str, c: Constraint, severity: str, value: Column, prop: PropertyShape | None = None) -> DataFrame:
    message = prop.message if prop and prop.message else f"{c} does not hold"
    return rows.select(F.lit(shape.name).alias("shape"), "focus", F.lit(path).alias("path"), F.lit(c.name).alias("component"), value.cast("string").alias("value"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), F.lit(prop.suggestion if prop else None).cast("string").alias("suggestion"))


def value_counts(graph: Graph, focus: DataFrame, path: Path, tests: dict[str, Column]) -> DataFrame:
    """How many values of a path each focus node has (column all), and how many of them pass each test; nodes without values may be left out.

    The end of a sequence counts its values once per node where they start, and focus nodes add these counts up, so that paths that meet in a node are not multiplied out.
    """
    if path.kind != "sequence" or len(path.parts) < 2:
        return values(graph, focus, path).groupBy("focus").agg(F.count(F.lit(1)).alias("all"), *(F.count_if(F.coalesce(test, F.lit(False))).alias(k) for k, test in tests.items()))
    ends = values(graph, focus, replace(path, parts=path.parts[:-1])).where("node IS NOT NULL").select("focus", "node").distinct()
    each = value_counts(graph, ends.select(F.col("node").alias("focus")).distinct(), path.parts[-1], tests).withColumnRenamed("focus", "node")
    return ends.join(each, "node").groupBy("focus").agg(*(F.sum(k).alias(k) for k in ("all", *tests)))


def _property_results(graph: Graph, shape: Shape, focus: DataFrame, prop: PropertyShape) -> list[DataFrame]:
    rows, severity, path, out = values(graph, focus, prop.path), prop.severity or shape.severity, str(prop.path), []
    one_by_one = [c for c in prop.constraints if c.name not in COUNT_TESTS and c.name not in ("unique", "unique_per_node", "class")]
    if one_by_one:
        # one scan of the values for all constraints on single values
        failed = F.array_compact(F.array(*(F.when(~conforms(c), F.lit(k)) for k, c in enumerate(one_by_one))))
        bad = rows.select("focus", "raw", F.explode(failed).alias("k"))
        for k, c in enumerate(one_by_one):
            out.append(_results(bad.where(F.col("k") == k), shape, path, c, severity, F.col("raw"), prop))
    counting = [c for c in prop.constraints if c.name in COUNT_TESTS]
    if counting:
        def hit(c: Constraint) -> Column:
            return _members([c.value]) if c.name == "has_value" else conforms(c.value[1]) if c.name.startswith("qualified") else F.lit(True)

        counts = focus.join(value_counts(graph, focus, prop.path, {f"hits_{k}": hit(c) for k, c in enumerate(counting)}), "focus", "left")
        for k, c in enumerate(counting):
            n, h = F.coalesce("all", F.lit(0)), F.coalesce(f"hits_{k}", F.lit(0))
            broken = {"min_count": lambda: n < c.value, "max_count": lambda: n > c.value, "required": lambda: n == 0, "has_value": lambda: h == 0, "qualified_min": lambda: h < c.value[0], "qualified_max": lambda: h > c.value[0]}[c.name]()
            out.append(_results(counts.where(broken), shape, path, c, severity, h if c.name in ("has_value", "qualified_min", "qualified_max") else n, prop))
    for c in prop.constraints:
        if c.name == "class":
            members = graph.labelled(c.value).select(F.col("node_id").alias("node"))
            out.append(_results(rows.where("node IS NOT NULL").join(members, "node", "left_anti"), shape, path, c, severity, F.col("raw"), prop))
        elif c.name in ("unique", "unique_per_node"):
            keys = ["kind", "raw"] + ["focus"] * (c.name == "unique_per_node")
            doubled = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            cond = [rows["kind"] == doubled["kind"], rows["raw"].eqNullSafe(doubled["raw"])] + ([rows["focus"] == doubled["focus"]] if c.name == "unique_per_node" else [])
            joined = rows.join(doubled, cond, "left_semi")
            out.append(_results(joined, shape, path, c, severity, F.col("raw"), prop))
    return out


def _node_results(graph: Graph, shape: Shape, focus: DataFrame) -> list[DataFrame]:
    def test(c: Constraint) -> Column:
        if c.name == "class":
            return F.array_contains("labels", c.value)
        if c.name in ("not", "and", "or", "xone"):
            parts = [test(x) for x in c.value]
            if c.name == "not":
                return ~parts[0]
            if c.name == "xone":
                return sum((p.cast("int") for p in parts), F.lit(0)) == 1
            out = parts[0]
            for p in parts[1:]:
                out = out & p if c.name == "and" else out | p
            return out
        return F.lit(True)

    rows = focus.join(graph.nodes.select(F.col("node_id").alias("focus"), "labels"), "focus") if shape.constraints else focus
    return [_results(rows.where(~F.coalesce(test(c), F.lit(False))), shape, "", c, shape.severity, F.lit(None).cast("string")) for c in shape.constraints]


def validate(graph: Graph, shapes: Shapes | list[Shape], version: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """The results (REPORT) of all active shapes over their focus nodes, or over those also in ``only`` (column focus)."""
    graph = graph.of_version(version)
    shapes = shapes.active() if isinstance(shapes, Shapes) else [s for s in shapes if not s.deactivated]
    parts = []
    for shape in shapes:
        focus = focus_nodes(graph, shape)
        focus = focus.join(only, "focus", "left_semi") if only is not None else focus
        for prop in shape.properties:
            if not prop.deactivated:
                parts += _property_results(graph, shape, focus, prop)
        parts += _node_results(graph, shape, focus)
    if not parts:
        return graph.spark.createDataFrame([], REPORT)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(report: DataFrame) -> DataFrame:
    """One row: violations, warnings, infos, conforms (no violation)."""
    of = lambda s: F.count_if(F.col("severity") == s)
    return report.agg(of(VIOLATION).alias("violations"), of(WARNING).alias("warnings"), of(INFO).alias("infos"), (of(VIOLATION) == 0).alias("conforms"))


def grouped(report: DataFrame, by: str = "shape") -> DataFrame:
    """Results per shape, or per focus node."""
    return report.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
