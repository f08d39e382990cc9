"""One-hop graph patterns and lookups, as filters and equi-joins."""

from __future__ import annotations

from dataclasses import dataclass, field
from dataclasses import replace as _replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StoreError
from ..sources.graph import Graph
from ..values import kind_of, same
from ..vocab import DOMAIN_LABELS, INFERENCE_PREFIXES, RELATIONS


@dataclass(frozen=True)
class NodePattern:
    """A node by label and strict property equalities; an empty one fits every node."""

    label: str | None = None
    props: dict = field(default_factory=dict)
    variable: str | None = None

    def with_label(self, label: str) -> NodePattern:
        return _replace(self, label=label)

    def with_variable(self, variable: str) -> NodePattern:
        return _replace(self, variable=variable)

    def with_property(self, key: str, value) -> NodePattern:
        return _replace(self, props={**self.props, key: value})


@dataclass(frozen=True)
class EdgePattern:
    """An edge by relation type and direction (out, in or both, seen from the start node)."""

    rel_type: str | None = None
    direction: str = "out"

    def with_type(self, rel_type: str) -> EdgePattern:
        return _replace(self, rel_type=rel_type)

    def incoming(self) -> EdgePattern:
        return _replace(self, direction="in")


def nodes_like(graph: Graph, pattern: NodePattern) -> DataFrame:
    """Ids of the nodes that a pattern fits (column node_id)."""
    found = graph.labelled(pattern.label) if pattern.label else graph.nodes
    found = found.select("node_id")
    for key, value in sorted(pattern.props.items()):
        own = graph.props.where((F.col("key") == key) & same(F.col("kind"), F.col("raw"), value)).select("node_id")
        found = found.join(own, "node_id", "left_semi")
    return found


def edges_like(graph: Graph, pattern: EdgePattern) -> DataFrame:
    """Edges (start, rel_type, end) in the pattern's direction."""
    edges = graph.edges.where(F.col("rel_type") == pattern.rel_type) if pattern.rel_type else graph.edges
    out = edges.select(F.col("src").alias("start"), "rel_type", F.col("dst").alias("end"))
    back = edges.select(F.col("dst").alias("start"), "rel_type", F.col("src").alias("end"))
    return {"out": out, "in": back}.get(pattern.direction) if pattern.direction != "both" else out.unionByName(back.where("start <> end"))


def match(graph: Graph, start: NodePattern, edge: EdgePattern, end: NodePattern) -> DataFrame:
    """Rows (start, rel_type, end), one per edge, without a limit. Joins only the ends that the pattern restricts."""
    rows = edges_like(graph, edge)
    for name, pattern in (("start", start), ("end", end)):
        if pattern.label or pattern.props:
            rows = rows.join(nodes_like(graph, pattern).withColumnRenamed("node_id", name), name, "left_semi")
    return rows.select("start", "rel_type", "end")


def get_nodes(graph: Graph, names: DataFrame | list[str]) -> DataFrame:
    """For each name (column alias, or a list), the node that has it as id, iri, code or key; of several the smallest key: (alias, nodes' columns)."""
    if isinstance(names, list):
        # literal names reach the scan as equalities of columns
        few = graph.with_(nodes=graph.named(names))
        keyed = few.aliases().where(F.col("alias").isin(*names)).groupBy("alias").agg(F.min("node_id").alias("node_id"))
        return keyed.join(few.nodes, "node_id").select("alias", *graph.nodes.columns)
    keyed = graph.aliases().join(names, "alias", "left_semi").groupBy("alias").agg(F.min("node_id").alias("node_id"))
    return keyed.join(graph.nodes, "node_id").select("alias", *graph.nodes.columns)


def relationships(graph: Graph, node_id: str, rel_type: str | None = None, direction: str = "out") -> DataFrame:
    """Edges of a node with their true direction: ``direction`` out, in or both."""
    side = {"out": F.col("src") == node_id, "in": F.col("dst") == node_id, "both": (F.col("src") == node_id) | (F.col("dst") == node_id)}[direction]
    found = graph.edges.where(side)
    return found.where(F.col("rel_type") == rel_type) if rel_type else found


def is_domain(labels: Column) -> Column:
    return F.arrays_overlap(labels, F.array(*map(F.lit, DOMAIN_LABELS)))


def incoming_relationships(graph: Graph, node_id: str, rel_type: str | None = None) -> DataFrame:
    """In-edges of a node from other nodes with a domain label."""
    domain = graph.nodes.where(is_domain(F.col("labels"))).select(F.col("node_id").alias("src"))
    return relationships(graph, node_id, rel_type, "in").where("src <> dst").join(domain, "src", "left_semi")


def label_rank(labels: Column) -> Column:
    """The place of the first domain label that a node has; null without one."""
    return F.coalesce(*(F.when(F.array_contains(labels, label), F.lit(k)) for k, label in enumerate(DOMAIN_LABELS)))


def find_by_id_code(graph: Graph, id_: str = "", code: str | None = None) -> DataFrame:
    """At most one node that has the id (where given) and the code (where given); the first domain label wins, then the smallest key."""
    found = graph.nodes.where(is_domain(F.col("labels")))
    if id_:
        found = found.where((F.col("node_id") == id_) | (F.col("id") == id_) | (F.col("iri") == id_))
    if code is not None:
        found = found.where(F.col("code") == code)
    return found.orderBy(label_rank(F.col("labels")), "node_id").limit(1)


def find_any(graph: Graph, name: str) -> DataFrame:
    """At most one node (with ``tier``) found by key, else by exact id, iri, code or name, else by a part of its name or description."""
    text = graph.props.where((F.col("key") == "description") & F.col("raw").contains(name)).select("node_id").withColumn("described", F.lit(True))
    exact = F.coalesce(*((F.col(c) == name) & F.lit(True) for c in ("id",)), F.lit(False))
    for c in ("iri", "code", "name"):
        exact = exact | F.coalesce(F.col(c) == name, F.lit(False))
    tier = F.when(F.col("node_id") == name, 0).when(exact, 1).when(F.coalesce(F.col("name").contains(name), F.lit(False)) | F.col("described").isNotNull(), 2)
    return graph.nodes.join(text, "node_id", "left").withColumn("tier", tier).where("tier IS NOT NULL").orderBy("tier", F.coalesce(label_rank(F.col("labels")), F.lit(99)), "node_id").limit(1).select(*graph.nodes.columns, "tier")


def resolve_ids(graph: Graph, specs: DataFrame, prefix: str) -> DataFrame:
    """``specs`` with column ``{prefix}_node``: the node named by {prefix}_id, _code, _name or {prefix} itself, else that text.

    A column {prefix}_label restricts the search to that label; otherwise entities come before types and patrols. Matches by code come
    before matches by name.
    """
    given = [c for c in (f"{prefix}_id", f"{prefix}_code", f"{prefix}_name", prefix) if c in specs.columns]
    if not given:
        raise StoreError(f"one of {prefix}_id, {prefix}_code, {prefix}_name is required", "invalid_data")
    wanted = F.coalesce(*given)
    label = F.col(f"{prefix}_label") if f"{prefix}_label" in specs.columns else F.lit(None).cast("string")
    ranked = graph.nodes.select("node_id", "labels", F.explode(F.array(F.struct(F.lit(0).alias("by"), F.col("code").alias("text")), F.struct(F.lit(1).alias("by"), F.col("name").alias("text")), F.struct(F.lit(2).alias("by"), F.col("node_id").alias("text")))).alias("n"))
    names = ranked.select("node_id", "labels", "n.by", "n.text").where("text IS NOT NULL")
    order = F.coalesce(*(F.when(F.array_contains("labels", x), F.lit(k)) for k, x in enumerate(("Entity", "Type", "Patrol"))), F.lit(3))
    left = specs.withColumn("__row", F.monotonically_increasing_id()).withColumn("__text", wanted).withColumn("__label", label)
    # of all names only those that are asked for go on
    names = names.join(left.select(F.col("__text").alias("text")).distinct(), "text", "left_semi")
    joined = left.join(names, (F.col("__text") == F.col("text")) & (F.col("__label").isNull() | F.array_contains(F.col("labels"), F.col("__label"))), "left")
    best = joined.groupBy("__row", *specs.columns, "__text").agg(F.min(F.when(F.col("node_id").isNotNull(), F.struct(order.alias("o"), F.col("by"), F.col("node_id")))).alias("best"))
    return best.select(*specs.columns, F.coalesce("best.node_id", "__text").alias(f"{prefix}_node"))


def exists_code(graph: Graph, code: str) -> bool:
    return not graph.labelled("Entity").where(F.col("code") == code).limit(1).isEmpty()


def exists_type(graph: Graph, name: str) -> bool:
    return not graph.labelled("Type").where(F.col("name") == name).limit(1).isEmpty()


def parent_types(graph: Graph, child: str) -> DataFrame:
    """Types one hop above a node over INSTANCE_OF or subClassOf."""
    up = graph.edges.where((F.col("src") == child) & F.col("rel_type").isin("INSTANCE_OF", "subClassOf"))
    return up.select(F.col("dst").alias("node_id")).distinct().join(graph.labelled("Type"), "node_id", "left_semi")


def discover_downstream(graph: Graph, node_id: str, rel_types: list[str] | None = None) -> DataFrame:
    """Distinct codes of targets that belong to no version."""
    out = relationships(graph, node_id)
    out = out.where(F.col("rel_type").isin(*rel_types)) if rel_types else out
    return out.select(F.col("dst").alias("node_id")).join(graph.originals(), "node_id").select("code").where("code IS NOT NULL").distinct()


def has_inference_prefix(rel_type: Column) -> Column:
    hit = F.lit(False)
    for p in INFERENCE_PREFIXES:
        hit = hit | rel_type.startswith(p)
    return hit


def is_ontology_relation(rel_type: Column) -> Column:
    return rel_type.startswith("rdfs:") | rel_type.startswith("owl2:") | rel_type.isin(*RELATIONS)


@dataclass(frozen=True)
class Check:
    """One predicate on a node's property. ``op``: required, exists, equals, not_equals, min, max, above, below, pattern or in."""

    op: str
    key: str
    value: object = None

    def __str__(self) -> str:
        return f"{self.op}({self.key}{'' if self.value is None else f', {self.value}'})"


def check_nodes(graph: Graph, nodes: DataFrame, checks: list[Check]) -> DataFrame:
    """For each node (column node_id): passed, and the failed checks as texts. Missing properties fail all but not_equals."""
    keys = sorted({c.key for c in checks})
    own = graph.props.where(F.col("key").isin(*keys)).join(nodes.select("node_id"), "node_id", "left_semi")
    wide = own.groupBy("node_id").agg(*(F.first(F.when(F.col("key") == k, F.struct("kind", "raw", "num")), ignorenulls=True).alias(f"__{i}") for i, k in enumerate(keys)))
    rows = nodes.select("node_id").join(wide, "node_id", "left")

    def holds(c: Check) -> Column:
        at = F.col(f"__{keys.index(c.key)}")
        kind, raw, num = at["kind"], at["raw"], at["num"]
        return {
            "required": lambda: at.isNotNull() & (kind != "null") & ~((kind == "string") & (raw == "")),
            "exists": lambda: at.isNotNull(),
            "equals": lambda: same(kind, raw, c.value),
            "not_equals": lambda: ~F.coalesce(same(kind, raw, c.value), F.lit(False)),
            "min": lambda: num >= c.value, "max": lambda: num <= c.value, "above": lambda: num > c.value, "below": lambda: num < c.value,
            "pattern": lambda: (kind == "string") & raw.rlike(c.value),
            "in": lambda: _any(same(kind, raw, v) for v in c.value),
        }[c.op]()

    failed = F.array_compact(F.array(*(F.when(~F.coalesce(holds(c), F.lit(False)), F.lit(str(c))) for c in checks)))
    return rows.select("node_id", (F.size(failed) == 0).alias("passed"), failed.alias("failed"))


def _any(columns) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def value_kind(value) -> str:
    return kind_of(value)
