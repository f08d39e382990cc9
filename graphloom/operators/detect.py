"""Differences between the properties of linked nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph


def attribute_changes(graph: Graph, pairs: DataFrame) -> DataFrame:
    """For pairs (source, target, relation): (source, target, relation, key, old, new, change) with change ``changed`` or ``added``.

    A key is changed if both nodes have it with different kind or text, and added if only the target has it.
    """
    props = graph.props.select("node_id", "key", "kind", "raw")
    left = pairs.join(props.withColumnRenamed("node_id", "source"), "source").select("source", "target", "relation", "key", F.struct("kind", "raw").alias("a"))
    right = pairs.join(props.withColumnRenamed("node_id", "target"), "target").select("source", "target", "relation", "key", F.struct("kind", "raw").alias("b"))
    both = left.join(right, ["source", "target", "relation", "key"], "full_outer")
    same = (F.col("a.kind") == F.col("b.kind")) & F.col("a.raw").eqNullSafe(F.col("b.raw"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNotNull() & ~same, "changed")
    return both.select("source", "target", "relation", "key", F.col("a.raw").alias("old"), F.col("b.raw").alias("new"), change.alias("change")).where("change IS NOT NULL")


def narrated(changes: DataFrame) -> DataFrame:
    """Changes with a line of text each."""
    line = F.when(F.col("change") == "added", F.format_string("%s -[%s]-> %s: new property '%s'", "source", "relation", "target", "key")).otherwise(F.format_string("%s -[%s]-> %s: property '%s' from %s to %s", "source", "relation", "target", "key", F.coalesce("old", F.lit("null")), F.coalesce("new", F.lit("null"))))
    return changes.withColumn("line", line)


def detect(graph: Graph, pairs: DataFrame, detectors: list[Callable[[Graph, DataFrame], DataFrame]]) -> DataFrame:
    """The union of what detectors find; each takes the graph and pairs and returns the columns of :func:`attribute_changes`."""
    out = None
    for find in detectors or [attribute_changes]:
        rows = find(graph, pairs)
        out = rows if out is None else out.unionByName(rows)
    return out
