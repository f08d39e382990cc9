"""Entity search by any mix of criteria, and what surrounds an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from .pattern import relationships
from .timeline import within
from .traverse import ancestors, descendants, inherited_props, summarize_relations


def search(graph: Graph, code: str | None = None, type_: str | None = None, subclass_of: str | None = None, keyword: str | None = None, props: dict | None = None, near: tuple[float, float, float] | None = None) -> DataFrame:
    """Entities (node_id, code, name, type) that meet all given criteria.

    ``code`` and ``type_`` are exact; ``subclass_of`` takes entities whose type, by property or INSTANCE_OF, is the given type or below it; ``keyword`` is part of
    the name, code or description in any case; ``props`` are equal texts; ``near`` is (lat, lon, metres) over the numeric properties lat and lon.
    """
    found = graph.labelled("Entity").select("node_id", "code", "name", "type")
    if code is not None:
        found = found.where(F.col("code") == code)
    if type_ is not None:
        found = found.where(F.col("type") == type_)
    if subclass_of is not None:
        types = graph.labelled("Type").where((F.col("node_id") == subclass_of) | (F.col("name") == subclass_of)).select("node_id")
        below = descendants(graph, types.withColumnRenamed("node_id", "node")).select(F.col("descendant").alias("node_id"))
        scope = types.unionByName(below).distinct()
        names = scope.join(graph.nodes.select("node_id", "name"), "node_id").select(F.explode(F.array_compact(F.array("node_id", "name"))).alias("text")).distinct()
        linked = graph.edges.where("rel_type = 'INSTANCE_OF'").join(scope.withColumnRenamed("node_id", "dst"), "dst", "left_semi").select(F.col("src").alias("node_id"))
        typed = found.join(names, F.col("type") == F.col("text"), "left_semi").select("node_id").unionByName(linked).distinct()
        found = found.join(typed, "node_id", "left_semi")
    for key, value in sorted((props or {}).items()):
        own = graph.props.where((F.col("key") == key) & (F.col("raw") == str(value))).select("node_id")
        found = found.join(own, "node_id", "left_semi")
    if keyword is not None:
        word = keyword.lower()
        told = graph.props.where((F.col("key") == "description") & F.lower("raw").contains(word)).select("node_id").distinct().withColumn("told", F.lit(True))
        hit = F.coalesce(F.lower("name").contains(word), F.lit(False)) | F.coalesce(F.lower("code").contains(word), F.lit(False)) | F.col("told").isNotNull()
        found = found.join(told, "node_id", "left").where(hit).drop("told")
    if near is not None:
        places = graph.props.where(F.col("key").isin("lat", "lon")).groupBy("node_id").agg(F.max(F.when(F.col("key") == "lat", F.col("num"))).alias("lat"), F.max(F.when(F.col("key") == "lon", F.col("num"))).alias("lon"))
        center = graph.spark.createDataFrame([("c", float(near[0]), float(near[1]))], "center string, c_lat double, c_lon double")
        found = found.join(within(places.where("lat IS NOT NULL AND lon IS NOT NULL"), center, float(near[2])).select("node_id"), "node_id", "left_semi")
    return found


def context(graph: Graph, node_id: str) -> dict[str, DataFrame]:
    """What is known around an entity: its own and inherited properties, type chain, and summaries of its edges in both directions."""
    one = F.col("node_id") == node_id
    chain = [r.type for r in graph.nodes.where(one).select("type").where("type IS NOT NULL").collect()]  # of one node
    start = graph.labelled("Type").where(F.col("node_id").isin(*chain) | F.col("name").isin(*chain) if chain else F.lit(False)).select(F.col("node_id").alias("ancestor"), F.lit(0).alias("depth"))
    above = ancestors(graph, of=start.select(F.col("ancestor").alias("node"))).select("ancestor", "depth")
    return {
        "properties": inherited_props(graph, of=graph.nodes.where(one).select("node_id")),
        "types": start.unionByName(above),
        "outgoing": summarize_relations(relationships(graph, node_id)),
        "incoming": summarize_relations(relationships(graph, node_id, direction="in").select("rel_type", F.col("src").alias("dst"))),
    }
