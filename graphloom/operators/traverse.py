"""Traversals: bounded breadth-first search, ancestors, inheritance, closures, and summaries of relations.

A frontier is a DataFrame; a hop is a join with the edges, and visited nodes are dropped by an anti-join. Hops are few and bounded, or written tables.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from ..sources.work import written, written_any
from ..vocab import META_KEYS, SUB_CLASS_OF
from .pattern import has_inference_prefix, is_domain, is_ontology_relation


def hops(first: int, max_hops: int | None) -> Iterable[int]:
    """Depths from ``first`` on: one beyond ``max_hops``, to see what it leaves, or without an end; a search ends as its frontier is empty."""
    return count(first) if max_hops is None else range(first, max_hops + 2)


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """Edges (here, rel_type, there) in the direction of travel: out, in or both."""
    out = edges.select(F.col("src").alias("here"), "rel_type", F.col("dst").alias("there"))
    back = edges.select(F.col("dst").alias("here"), "rel_type", F.col("src").alias("there"))
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def explore(graph: Graph, starts: DataFrame, max_depth: int = 3, direction: str = "out", relation: str | None = None, threshold: float = 0.0, inference_only: bool = False, version: str | None = None) -> DataFrame:
    """Breadth-first search from each start (column node_id): rows (start, node, hop, confidence, blocked), the starts left out.

    Depth is clamped to 1 to 5. A node comes once per start, at its least hop and there with its greatest confidence: the product of the confidences of the
    nodes on the way, of those that have one. Below ``threshold`` a node is reported as blocked and not passed through.
    """
    graph = graph.of_version(version)
    edges = graph.edges
    if relation:
        edges = edges.where(F.col("rel_type") == relation)
    if inference_only:
        edges = edges.where(has_inference_prefix(F.col("rel_type")) | F.coalesce(F.col("action_type") == "inference", F.lit(False)))
    steps = directed(edges, direction).select("here", "there")  # doubled edges meet in the aggregate below
    own = graph.nodes.where("confidence IS NOT NULL").select(F.col("node_id").alias("there"), F.col("confidence").alias("own"))
    frontier = starts.select(F.col("node_id").alias("start"), F.col("node_id").alias("node"), F.lit(1.0).alias("confidence")).distinct()
    visited, out = frontier.select("start", "node"), []
    for hop in range(1, max(1, min(5, max_depth)) + 1):
        reached = frontier.select("start", F.col("node").alias("here"), "confidence").join(steps, "here").join(own, "there", "left")
        best = reached.groupBy("start", F.col("there").alias("node")).agg(F.max(F.col("confidence") * F.coalesce("own", F.lit(1.0))).alias("confidence"))
        new = best.join(visited, ["start", "node"], "left_anti")
        new, more = written_any(new.select("start", "node", F.lit(hop).alias("hop"), "confidence", (F.col("confidence") < threshold).alias("blocked")), "hops")
        out.append(new)
        if not more:
            break
        visited = visited.unionByName(new.select("start", "node"))
        frontier = new.where("NOT blocked")
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def closure(edges: DataFrame, max_hops: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """Rows (node, ancestor, depth) of paths over edges (node, above), of at most ``max_hops`` where given, with the least depth of each pair; cycles end.

    With ``starts`` (column node), only paths from these nodes are followed.
    """
    step = written(edges.select("node", "above").distinct().where("node <> above"), "steps")
    first = step if starts is None else step.join(starts.select("node").distinct(), "node", "left_semi")
    frontier = first.select("node", F.col("above").alias("ancestor"), F.lit(1).alias("depth"))
    frontier = frontier if starts is None else written(frontier, "closure")
    out, seen = [frontier], frontier.select("node", "ancestor")
    for depth in count(2) if max_hops is None else range(2, max_hops + 1):
        reached = frontier.select("node", F.col("ancestor").alias("at")).join(step.select(F.col("node").alias("at"), "above"), "at")
        new = reached.select("node", F.col("above").alias("ancestor")).where("node <> ancestor").distinct().join(seen, ["node", "ancestor"], "left_anti")
        frontier, more = written_any(new.withColumn("depth", F.lit(depth)), "closure")
        if not more:
            break
        out.append(frontier)
        seen = seen.unionByName(frontier.select("node", "ancestor"))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def ancestors(graph: Graph, max_hops: int = 10, of: DataFrame | None = None) -> DataFrame:
    """Rows (node, ancestor, depth) over subClassOf, all parents of a type included; ``of`` (column node) names the types to start from."""
    up = graph.edges.where(F.col("rel_type") == SUB_CLASS_OF).select(F.col("src").alias("node"), F.col("dst").alias("above"))
    return closure(up, max_hops, of)


def descendants(graph: Graph, of: DataFrame, max_hops: int = 10) -> DataFrame:
    """Rows (node, descendant, depth) below the types of ``of`` (column node), searched from these downwards."""
    down = graph.edges.where(F.col("rel_type") == SUB_CLASS_OF).select(F.col("dst").alias("node"), F.col("src").alias("above"))
    return closure(down, max_hops, of).withColumnRenamed("ancestor", "descendant")


def hop_counts(found: DataFrame) -> DataFrame:
    """What a search of :func:`explore` came to: (hop, nodes, blocked) per hop."""
    return found.groupBy("hop").agg(F.count(F.lit(1)).alias("nodes"), F.count_if("blocked").alias("blocked"))


def inherited_props(graph: Graph, max_hops: int = 20, of: DataFrame | None = None) -> DataFrame:
    """Properties of entities with those of their types: (node_id, key, kind, raw, num, from_node, depth); ``of`` (column node_id) names the entities.

    A type is linked by the property type (a key or name) or by INSTANCE_OF. The entity's own value comes first (depth 0), then the nearest type's,
    then that of the first name. Keys that identify a node are not inherited.
    """
    types = graph.labelled("Type")
    names = types.select("node_id", F.explode(F.array_distinct(F.array_compact(F.array("node_id", "name")))).alias("text"))
    entities = graph.labelled("Entity")
    entities = entities if of is None else entities.join(of.select("node_id").distinct(), "node_id", "left_semi")
    by_prop = entities.where("type IS NOT NULL").select(F.col("node_id").alias("entity"), F.col("type").alias("text")).join(names, "text").select("entity", "node_id")
    by_edge = graph.edges.where(F.col("rel_type") == "INSTANCE_OF").select(F.col("src").alias("entity"), F.col("dst").alias("node_id")).join(types.select("node_id"), "node_id", "left_semi").join(entities.select(F.col("node_id").alias("entity")), "entity", "left_semi")
    direct = by_prop.unionByName(by_edge.select("entity", "node_id")).distinct()
    direct = direct if of is None else written(direct, "types")
    up = ancestors(graph, max_hops, None if of is None else direct.select(F.col("node_id").alias("node")))
    chain = direct.select("entity", F.col("node_id").alias("from_node"), F.lit(1).alias("depth")).unionByName(
        direct.join(up, F.col("node_id") == F.col("node")).select("entity", F.col("ancestor").alias("from_node"), (F.col("depth") + 1).alias("depth"))
    )
    passed = graph.props.where(~F.col("key").isin(*META_KEYS)).withColumnRenamed("node_id", "from_node").join(chain, "from_node")
    own = graph.props.join(entities.select("node_id"), "node_id", "left_semi").select(F.col("node_id").alias("entity"), "key", "kind", "raw", "num", F.col("node_id").alias("from_node"), F.lit(0).alias("depth"))
    both = own.unionByName(passed.select("entity", "key", "kind", "raw", "num", "from_node", "depth"))
    best = both.groupBy("entity", "key").agg(F.min(F.struct("depth", "from_node", "kind", "raw", "num")).alias("b"))
    return best.select(F.col("entity").alias("node_id"), "key", "b.kind", "b.raw", "b.num", "b.from_node", "b.depth")


def ontology_closure(graph: Graph, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Seeds (column node_id) and all nodes above them over ontology relations: (node_id, depth)."""
    steps = graph.edges.where(is_ontology_relation(F.col("rel_type"))).select("src", "dst")
    return reachable(steps, seeds, max_hops)


def inference_closure(graph: Graph, seeds: DataFrame, max_hops: int | None = None, by_prefix: bool = False) -> DataFrame:
    """Seeds and all original nodes downstream of them over inference edges (by action type or, if asked, by prefix and a domain label)."""
    edges = graph.edges.where(has_inference_prefix(F.col("rel_type"))) if by_prefix else graph.edges.where(F.col("action_type") == "inference")
    fit = graph.originals()
    fit = fit.where(is_domain(F.col("labels"))) if by_prefix else fit
    return reachable(edges.select("src", "dst"), seeds, max_hops, fit)


def reachable(steps: DataFrame, seeds: DataFrame, max_hops: int | None = None, fit: DataFrame | None = None) -> DataFrame:
    """Rows (node_id, depth) of what seeds reach over steps (src, dst), themselves at depth 0; a ``max_hops`` that leaves nodes unreached is an error.

    With ``fit`` (column node_id), only these nodes are reached and passed through; a hop joins them with the nodes that it is about to reach.
    """
    frontier = written(seeds.select("node_id").distinct().withColumn("depth", F.lit(0)), "reach")
    out = seen = frontier
    for depth in hops(1, max_hops):
        new = frontier.select(F.col("node_id").alias("src")).join(steps, "src").select(F.col("dst").alias("node_id")).distinct().join(seen, "node_id", "left_anti")
        new = new if fit is None else new.join(fit.select("node_id"), "node_id", "left_semi")
        frontier, more = written_any(new.withColumn("depth", F.lit(depth)), "reach")
        if not more:
            break
        if max_hops is not None and depth > max_hops:
            raise RuntimeError(f"more nodes lie beyond max_hops={max_hops}")
        out = seen = seen.unionByName(frontier)
    return out


def samples(df: DataFrame, group: str, value: str, n: int = 3) -> DataFrame:
    """The ``n`` least distinct values of each group, for logs and summaries."""
    # the filter on row_number reaches below the shuffle as a group limit, so a group of any size sends n rows per task
    return df.select(group, value).distinct().selectExpr(f"`{group}`", f"`{value}`", f"row_number() OVER (PARTITION BY `{group}` ORDER BY `{value}`) AS k").where(F.col("k") <= n).drop("k")


def summarize_relations(edges: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent relation types: (rel_type, n, samples), three target samples each; ties by name."""
    counts = edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel_type").limit(top)
    shown = samples(edges, "rel_type", "dst").groupBy("rel_type").agg(F.array_sort(F.collect_list("dst")).alias("samples"))
    return counts.join(shown, "rel_type").select("rel_type", "n", "samples").orderBy(F.desc("n"), "rel_type")


def top_parents(graph: Graph, top: int = 10) -> DataFrame:
    """The types with most types directly below them: (node_id, children); ties by key."""
    links = graph.edges.where(F.col("rel_type") == SUB_CLASS_OF)
    return links.groupBy(F.col("dst").alias("node_id")).agg(F.count(F.lit(1)).alias("children")).orderBy(F.desc("children"), "node_id").limit(top)


def next_steps(graph: Graph, top: int = 10, inference_only: bool = False) -> DataFrame:
    """For each node its most frequent outgoing relation types: (node_id, rel_type, n, place)."""
    edges = graph.edges
    if inference_only:
        edges = edges.where(has_inference_prefix(F.col("rel_type")) | F.coalesce(F.col("action_type") == "inference", F.lit(False)))
    counts = edges.groupBy(F.col("src").alias("node_id"), "rel_type").agg(F.count(F.lit(1)).alias("n"))
    placed = counts.selectExpr("*", "row_number() OVER (PARTITION BY node_id ORDER BY n DESC, rel_type) AS place")
    return placed.where(F.col("place") <= top)
