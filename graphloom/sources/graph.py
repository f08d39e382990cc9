"""The labelled property graph as three DataFrames, and where it comes from."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..values import kind_of, raw_column, raw_of
from .work import sized, work_dir

NODE_COLUMNS = ("node_id", "iri", "id", "code", "name", "type", "labels", "version", "confidence")
PROP_COLUMNS = ("node_id", "key", "kind", "raw", "num")
EDGE_COLUMNS = ("src", "rel_type", "dst", "action_type", "version", "value", "value_kind", "func", "target_id")

NODES = "node_id string, iri string, id string, code string, name string, type string, labels array<string>, version string, confidence double"
PROPS = "node_id string, key string, kind string, raw string, num double"
EDGES = "src string, rel_type string, dst string, action_type string, version string, value string, value_kind string, func string, target_id string"


@dataclass(frozen=True)
class Graph:
    """``nodes`` has a row per node, ``props`` a row per node and key (typed values, see values.py), ``edges`` a row per edge; ``source`` names where they come from.

    All operators read these lazily, so filters on labels and relation types reach the scans. A graph is never changed: writes return another one.
    """

    nodes: DataFrame
    props: DataFrame
    edges: DataFrame
    source: str | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def with_(self, **frames: DataFrame) -> Graph:
        return replace(self, **frames)

    def of_version(self, version: str | None) -> Graph:
        """Nodes and edges of one version; None keeps all."""
        if version is None:
            return self
        return self.with_(nodes=self.nodes.where(F.col("version") == version), edges=self.edges.where(F.col("version") == version))

    def originals(self) -> DataFrame:
        """Nodes that belong to no version."""
        return self.nodes.where(F.coalesce("version", F.lit("")) == "")

    def labelled(self, label: str) -> DataFrame:
        return self.nodes.where(F.array_contains("labels", label))

    def individuals(self) -> DataFrame:
        return self.labelled("Individual").select(F.col("node_id").alias("iri"))

    def aliases(self) -> DataFrame:
        """Rows (alias, node_id): every text by which a node can be named, so that a match by any of them is an equi-join."""
        names = F.array_distinct(F.array_compact(F.array("node_id", "iri", "id", "code")))
        return self.nodes.select(F.explode(names).alias("alias"), "node_id")

    def named(self, names: list[str]) -> DataFrame:
        """The nodes that have any of the names as key, iri, id or code."""
        if not names:
            return self.nodes.where(F.lit(False))
        hit = F.col("node_id").isin(*names)
        for c in ("iri", "id", "code"):
            hit = hit | F.col(c).isin(*names)
        return self.nodes.where(hit)

    def health(self) -> DataFrame:
        """Nodes per label."""
        return self.nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))

    def save(self, path: str, spread: int = 64) -> None:
        """Three Parquet tables: edges by relation type and properties by key, so that a pattern reads its own partitions only.

        Before the write rows are spread over ``spread`` tasks per partition at most; with 0 each task writes what it has.
        """
        for frame, name, by, key in ((self.nodes, "nodes", None, None), (self.props, "props", "key", "node_id"), (self.edges, "edges", "rel_type", "src")):
            if by and spread:
                frame = frame.repartition(by, F.pmod(F.xxhash64(key), F.lit(spread)))
            writer = frame.write.option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}")


def full(df: DataFrame, schema: str) -> DataFrame:
    """``df`` with all columns of a schema, nulls where it has none."""
    wanted = [part.strip().split(" ", 1) for part in schema.split(", ")]
    return df.select(*(F.col(c).cast(t).alias(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in wanted))


def from_frames(nodes: DataFrame, edges: DataFrame, props: DataFrame | None = None) -> Graph:
    """A graph over frames that may lack columns."""
    sized(nodes.sparkSession)
    return Graph(full(nodes, NODES), full(props, PROPS) if props is not None else nodes.sparkSession.createDataFrame([], PROPS), full(edges, EDGES))


def from_parquet(spark: SparkSession, path: str) -> Graph:
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
    return from_frames(read("nodes", NODES), read("edges", EDGES), read("props", PROPS))


def from_views(spark: SparkSession, nodes: str = "nodes", edges: str = "edges", props: str = "props") -> Graph:
    return from_frames(spark.table(nodes), spark.table(edges), spark.table(props))


def from_jdbc(spark: SparkSession, url: str, options: dict[str, str] | None = None, **tables: str) -> Graph:
    """The three tables over JDBC (names by keyword: nodes, edges, props)."""
    read = lambda t: spark.read.format("jdbc").options(url=url, dbtable=tables.get(t, t), **(options or {})).load()
    lower = lambda t: read(t).transform(lambda df: df.toDF(*(c.lower() for c in df.columns)))
    nodes = lower("nodes")
    nodes = nodes.withColumn("labels", F.split("labels", ",")) if dict(nodes.dtypes).get("labels") == "string" else nodes
    return from_frames(nodes, lower("edges").withColumnRenamed("prop_value", "value"), lower("props").withColumnRenamed("prop_key", "key"))


def from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict]) -> Graph:
    """A small graph from dicts. Nodes: labels and properties; edges: src, rel_type, dst and edge columns."""
    sized(spark)
    rows, props = [], []
    for n in nodes:
        own = {k: v for k, v in n.items() if k != "labels"}
        node_id = own.get("iri") or own.get("id") or own.get("code")
        text = lambda k: own[k] if isinstance(own.get(k), str) else None  # noqa: B023, E731
        confidence = own.get("confidence")
        rows.append((node_id, text("iri"), text("id"), text("code"), text("name"), text("type"), list(n.get("labels", [])), text("version") or text("cope_version"), float(confidence) if isinstance(confidence, (int, float)) else None))
        for k, v in own.items():
            kind = kind_of(v)
            props.append((node_id, k, kind, raw_of(v), float(v) if kind in ("integer", "float") else None))
    frame = spark.createDataFrame(props, PROPS)
    frame = frame.withColumn("raw", raw_column(F.col("kind"), F.col("raw"), F.col("num")))
    links = [tuple(e.get(c) for c in EDGE_COLUMNS) for e in edges]
    return Graph(spark.createDataFrame(rows, NODES), frame, spark.createDataFrame(links, EDGES))


class Store(Protocol):
    """Where a graph lives. Anything with these two methods is one; operators see only the graph."""

    def graph(self, spark: SparkSession) -> Graph: ...

    def save(self, graph: Graph) -> None: ...


@dataclass(frozen=True)
class ParquetStore:
    path: str

    def graph(self, spark: SparkSession) -> Graph:
        return from_parquet(spark, self.path)

    def save(self, graph: Graph) -> None:
        graph.save(self.path)


@dataclass(frozen=True)
class JdbcStore:
    url: str
    options: tuple[tuple[str, str], ...] = ()

    def graph(self, spark: SparkSession) -> Graph:
        return from_jdbc(spark, self.url, dict(self.options))

    def save(self, graph: Graph) -> None:
        """Labels, which not every database has lists for, are written as one text and read back as a list."""
        for name, frame in (("nodes", graph.nodes.withColumn("labels", F.array_join("labels", ","))), ("props", graph.props.withColumnRenamed("key", "prop_key")), ("edges", graph.edges.withColumnRenamed("value", "prop_value"))):
            frame.write.format("jdbc").options(url=self.url, dbtable=name, **dict(self.options)).mode("append").save()


def build(store: Store, spark: SparkSession) -> Graph:
    """The graph of a store."""
    return store.graph(spark)


def open_graph(spark: SparkSession, path: str | None, fallback: Graph | None = None) -> Graph:
    """The graph at ``path`` or, if it can't be read, the fallback; an empty graph without one."""
    if path:
        try:
            return from_parquet(spark, path)
        except Exception:
            if fallback is None:
                raise
    return fallback if fallback is not None else from_rows(spark, [], [])


def prefixed(prefix: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.col(key).cast("string"))


_loaded: dict[tuple[str, str], str] = {}


def from_sales(spark: SparkSession, sf_dir: str) -> Graph:
    """The sales tables as a stored graph, projected and written once per application: see :func:`project_sales`.

    Queries then read single tables with partition filters. Over the lazy projection every semi-join would be pushed into each of its many branches.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        path = f"{work_dir(spark)}/graph-{uuid.uuid4().hex}"
        project_sales(spark, sf_dir).save(path, spread=4)
        _loaded[key] = path
    return from_parquet(spark, _loaded[key]).with_(source=sf_dir)


def project_sales(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph projection of the sales tables, lazily.

    Customers, suppliers and parts are entities, orders are events; nations, regions and part types are types in two hierarchies. Confidence and
    type are set where the tables say something about them; line items give distinct links only.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    none = F.lit(None).cast("string")

    def node(df, id_, labels, code=none, name=none, type_=none, confidence=None):
        conf = F.lit(None).cast("double") if confidence is None else confidence
        return df.select(id_.alias("node_id"), id_.alias("iri"), none.alias("id"), code.alias("code"), name.alias("name"), type_.alias("type"), F.array(*map(F.lit, labels)).alias("labels"), none.alias("version"), conf.alias("confidence"))

    part_types = t("part").select("p_type").distinct()
    top = spark.createDataFrame([("type:World",), ("type:Part",), ("type:Thing",)], "node_id string")
    tables = ("region", "nation", "customer", "supplier", "part", "order")
    classes = spark.createDataFrame([(f"class:{c}",) for c in tables], "node_id string")
    segments = t("customer").select(F.concat(F.lit("class:segment:"), "c_mktsegment").alias("node_id")).distinct()
    statuses = t("orders").select(F.concat(F.lit("class:status:"), "o_orderstatus").alias("node_id")).distinct()
    nodes = [
        node(t("region"), prefixed("region", "r_regionkey"), ("Individual", "Type"), name=F.col("r_name"), type_=F.lit("type:World")),
        node(t("nation"), prefixed("nation", "n_nationkey"), ("Individual", "Type"), name=F.col("n_name"), type_=prefixed("region", "n_regionkey")),
        node(t("customer"), prefixed("customer", "c_custkey"), ("Individual", "Entity"), F.col("c_name"), F.col("c_name"), prefixed("nation", "c_nationkey"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 10000))),
        node(t("supplier"), prefixed("supplier", "s_suppkey"), ("Individual", "Entity"), F.col("s_name"), F.col("s_name"), prefixed("nation", "s_nationkey")),
        node(t("part"), prefixed("part", "p_partkey"), ("Individual", "Entity"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.col("p_name"), F.concat(F.lit("ptype:"), "p_type")),
        node(t("orders"), prefixed("order", "o_orderkey"), ("Individual", "Event"), F.concat(F.lit("O"), F.col("o_orderkey").cast("string"))),
        node(part_types, F.concat(F.lit("ptype:"), "p_type"), ("Type",), name=F.col("p_type"), type_=F.lit("type:Part")),
        node(top, F.col("node_id"), ("Type",), name=F.col("node_id")),
        node(classes.unionByName(segments).unionByName(statuses), F.col("node_id"), ("Class",)),
    ]

    def prop(df, id_, key, column, kind):
        value = F.col(column)
        num = value.cast("double") if kind in ("integer", "float") else F.lit(None).cast("double")
        return df.select(id_.alias("node_id"), F.lit(key).alias("key"), F.lit(kind).alias("kind"), value.cast("double" if kind == "float" else "string").cast("string").alias("raw"), num.alias("num")).where(value.isNotNull())

    props = []
    for name, id_, columns in (
        ("region", prefixed("region", "r_regionkey"), {"r_name": "string"}),
        ("nation", prefixed("nation", "n_nationkey"), {"n_name": "string"}),
        ("customer", prefixed("customer", "c_custkey"), {"c_name": "string", "c_acctbal": "float", "c_mktsegment": "string"}),
        ("supplier", prefixed("supplier", "s_suppkey"), {"s_name": "string", "s_acctbal": "float"}),
        ("part", prefixed("part", "p_partkey"), {"p_name": "string", "p_brand": "string", "p_size": "integer", "p_retailprice": "float"}),
        ("orders", prefixed("order", "o_orderkey"), {"o_orderstatus": "string", "o_totalprice": "float", "o_orderpriority": "string"}),
    ):
        props += [prop(t(name), id_, k, k, kind) for k, kind in columns.items()]
    props.append(spark.createDataFrame([("type:World", "planet", "string", "Earth", None), ("type:Thing", "r_name", "string", "anything", None)], PROPS))

    def edge(df, src, rel, dst, value=None, action=None):
        return df.select(src.alias("src"), F.lit(rel).alias("rel_type"), dst.alias("dst"), F.lit(action).cast("string").alias("action_type"), none.alias("version"),
                         (none if value is None else F.col(value).cast("string")).alias("value"), F.lit(None if value is None else "float").cast("string").alias("value_kind"), none.alias("func"), none.alias("target_id"))

    cust, sup, part, order, nation = prefixed("customer", "c_custkey"), prefixed("supplier", "s_suppkey"), prefixed("part", "p_partkey"), prefixed("order", "o_orderkey"), prefixed("nation", "n_nationkey")
    items = t("lineitem")
    steps = t("events").selectExpr("event_id", "lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after").where("after IS NOT NULL")
    chain = spark.createDataFrame([("type:Part", "type:Thing")], "a string, b string")
    edges = [
        edge(t("customer"), cust, "locatedIn", prefixed("nation", "c_nationkey")),
        edge(t("supplier"), sup, "locatedIn", prefixed("nation", "s_nationkey")),
        edge(t("nation"), nation, "locatedIn", prefixed("region", "n_regionkey")),
        edge(t("orders"), order, "placedBy", prefixed("customer", "o_custkey"), action="inference"),
        edge(items.select("l_orderkey", "l_partkey").distinct(), prefixed("order", "l_orderkey"), "contains", prefixed("part", "l_partkey")),
        edge(items.select("l_partkey", "l_suppkey").distinct(), prefixed("part", "l_partkey"), "suppliedBy", prefixed("supplier", "l_suppkey"), action="inference"),
        edge(steps, prefixed("event", "event_id"), "next", prefixed("event", "after")),
        edge(t("nation"), nation, "subClassOf", prefixed("region", "n_regionkey")),
        edge(t("region"), prefixed("region", "r_regionkey"), "subClassOf", F.lit("type:World")),
        edge(part_types, F.concat(F.lit("ptype:"), "p_type"), "subClassOf", F.lit("type:Part")),
        edge(chain, F.col("a"), "subClassOf", F.col("b")),
        edge(t("customer"), cust, "HAS_VALUE", F.lit("prop:balance"), "c_acctbal"),
        edge(t("orders"), order, "HAS_VALUE", F.lit("prop:total"), "o_totalprice"),
        edge(t("customer"), cust, "INSTANCE_OF", F.lit("class:customer")),
        edge(t("supplier"), sup, "INSTANCE_OF", F.lit("class:supplier")),
        edge(t("part"), part, "INSTANCE_OF", F.lit("class:part")),
        edge(t("orders"), order, "INSTANCE_OF", F.lit("class:order")),
        edge(t("nation"), nation, "INSTANCE_OF", F.lit("class:nation")),
        edge(t("region"), prefixed("region", "r_regionkey"), "INSTANCE_OF", F.lit("class:region")),
        edge(t("customer"), cust, "INSTANCE_OF", F.concat(F.lit("class:segment:"), "c_mktsegment")),
        edge(t("orders"), order, "INSTANCE_OF", F.concat(F.lit("class:status:"), "o_orderstatus")),
    ]

    def union(frames):
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    return Graph(union(nodes), union(props), union(edges))
