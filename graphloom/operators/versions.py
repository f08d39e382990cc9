"""Writes and versions: graphs are immutable, so a write is another graph, and a version is a copy of nodes under keys of their own."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import StoreError
from ..sources.graph import EDGES, NODES, PROPS, Graph, from_rows, full
from ..values import kind_of, raw_column, raw_of
from ..vocab import ENTITY_FLOATS, ENTITY_INTEGERS, ENTITY_LISTS, ENTITY_STRINGS
from .pattern import exists_code, exists_type
from .traverse import inference_closure


def insert(graph: Graph, nodes: list[dict] | None = None, edges: list[dict] | None = None) -> Graph:
    """Nodes are replaced by key, edges are added; edges with an end that isn't there are kept."""
    added = from_rows(graph.spark, nodes or [], edges or [])
    keys = added.nodes.select("node_id")
    return Graph(
        graph.nodes.join(keys, "node_id", "left_anti").unionByName(added.nodes),
        graph.props.join(keys, "node_id", "left_anti").unionByName(added.props),
        graph.edges.unionByName(added.edges),
    )


def delete_nodes(graph: Graph, nodes: DataFrame) -> Graph:
    """Without the given nodes (column node_id), their properties and all their edges."""
    keys = nodes.select("node_id")
    edges = graph.edges
    for end in ("src", "dst"):
        edges = edges.join(keys.withColumnRenamed("node_id", end), end, "left_anti")
    return Graph(graph.nodes.join(keys, "node_id", "left_anti"), graph.props.join(keys, "node_id", "left_anti"), edges.select(*graph.edges.columns))


def delete_edges(graph: Graph, edges: DataFrame) -> Graph:
    """Without the edges that equal given ones in src, rel_type and dst."""
    return graph.with_(edges=graph.edges.join(edges.select("src", "rel_type", "dst"), ["src", "rel_type", "dst"], "left_anti").select(*graph.edges.columns))


def entity_properties(params: dict) -> dict:
    """The properties of an entity: known keys only if they have their type, others as they come."""
    if not isinstance(params.get("code"), str):
        raise StoreError("'code' is required", "invalid_data")
    out = {}
    for key, value in params.items():
        if key in ENTITY_STRINGS:
            ok = isinstance(value, str)
        elif key in ENTITY_INTEGERS:
            ok = isinstance(value, int) and not isinstance(value, bool)
        elif key in ENTITY_FLOATS:
            ok = isinstance(value, (int, float)) and not isinstance(value, bool)
            value = float(value) if ok else value
        elif key in ENTITY_LISTS:
            ok = isinstance(value, list)
        else:
            ok = True
        if ok:
            out[key] = value
    return out


def create_entity(graph: Graph, params: dict) -> Graph:
    props = entity_properties(params)
    if exists_code(graph, props["code"]):
        raise StoreError(f"an entity has code {props['code']!r} already", "invalid_data")
    props.setdefault("id", f"urn:entity:{props['code']}")
    return insert(graph, [{"labels": ["Entity"], **props}])


def create_type(graph: Graph, name: str, parent: str | None = None, **props) -> Graph:
    if exists_type(graph, name):
        raise StoreError(f"a type has name {name!r} already", "invalid_data")
    edges = [{"src": f"type:{name}", "rel_type": "subClassOf", "dst": f"type:{parent}"}] if parent else []
    return insert(graph, [{"labels": ["Type"], "id": f"type:{name}", "name": name, **props}], edges)


def import_types(graph: Graph, pairs: DataFrame) -> Graph:
    """With types from a table of any size (name, parent): nodes for names that no type has, and subClassOf edges that aren't there."""
    key = lambda c: F.concat(F.lit("type:"), c)
    names = pairs.select("name").unionByName(pairs.select(F.col("parent").alias("name"))).where("name IS NOT NULL").distinct()
    names = names.join(graph.labelled("Type").select("name"), "name", "left_anti").withColumn("node_id", key(F.col("name")))
    nodes = names.select("node_id", F.col("node_id").alias("id"), "name", F.array(F.lit("Type")).alias("labels"))
    props = names.select("node_id", F.explode(F.create_map(F.lit("id"), F.col("node_id"), F.lit("name"), F.col("name"))).alias("key", "raw")).withColumn("kind", F.lit("string"))
    links = pairs.where("name IS NOT NULL AND parent IS NOT NULL").select(key(F.col("name")).alias("src"), F.lit("subClassOf").alias("rel_type"), key(F.col("parent")).alias("dst")).distinct()
    links = links.join(graph.edges.select("src", "rel_type", "dst"), ["src", "rel_type", "dst"], "left_anti")
    return graph.with_(nodes=graph.nodes.unionByName(full(nodes, NODES)), props=graph.props.unionByName(full(props, PROPS)), edges=graph.edges.unionByName(full(links, EDGES)))


#: Kinds of values by type of a table's column.
COLUMN_KINDS = {"string": "string", "boolean": "boolean", "double": "float", "float": "float", "bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer"}


def import_entities(graph: Graph, table: DataFrame) -> Graph:
    """With an entity per row of a table of any size, which has a column code; other columns become properties. Codes that an entity has already are left alone, nulls left out."""
    new = table.where("code IS NOT NULL").dropDuplicates(["code"]).join(graph.labelled("Entity").select("code"), "code", "left_anti")
    new = new.withColumn("node_id", F.concat(F.lit("urn:entity:"), "code"))
    new = new if "id" in new.columns else new.withColumn("id", F.col("node_id"))
    text = lambda c: F.col(c).cast("string") if c in new.columns else F.lit(None).cast("string")
    nodes = new.select("node_id", "id", "code", text("name").alias("name"), text("type").alias("type"), F.array(F.lit("Entity")).alias("labels"))
    values = []
    for column, kind in new.dtypes:
        if column != "node_id":
            own = COLUMN_KINDS.get(kind, "list" if kind.startswith("array") else "map" if kind.startswith(("map", "struct")) else "string")
            raw = F.to_json(column) if own in ("list", "map") else F.col(column).cast("double").cast("string") if own == "float" else F.col(column).cast("string")
            num = F.col(column).cast("double") if own in ("integer", "float") else F.lit(None).cast("double")
            values.append(F.struct(F.lit(column).alias("key"), F.lit(own).alias("kind"), raw.alias("raw"), num.alias("num")))
    props = new.select("node_id", F.explode(F.array(*values)).alias("p")).select("node_id", "p.*").where("raw IS NOT NULL")
    return graph.with_(nodes=graph.nodes.unionByName(full(nodes, NODES)), props=graph.props.unionByName(full(props, PROPS)))


def create_patrol(graph: Graph, code: str, name: str, path: list | None = None, entities: list | None = None, **props) -> Graph:
    return insert(graph, [{"labels": ["Patrol"], "id": f"patrol:{code}", "code": code, "name": name, "path": path or [], "entities": entities or [], **props}])


def create_relationships(graph: Graph, specs: DataFrame) -> Graph:
    """Edges from resolved specs (start_node, rel_type, end_node); other edge columns as given."""
    return graph.with_(edges=graph.edges.unionByName(full(specs.withColumnsRenamed({"start_node": "src", "end_node": "dst"}), ", ".join(f"{c} string" for c in graph.edges.columns))))


def audited(edges: DataFrame, now: Column | None = None) -> DataFrame:
    """Edges with the six audit columns at their defaults where they have none."""
    stamp = F.date_format(now if now is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    defaults = {"create_time": stamp, "update_time": stamp, "delete_flag": F.lit(0).cast("bigint"), "is_system": F.lit("0"), "create_user": F.lit(""), "update_user": F.lit("")}
    return edges.withColumns({c: F.coalesce(F.col(c), v) if c in edges.columns else v for c, v in defaults.items()})


def copy_key(version: str, key: Column) -> Column:
    return F.concat(key, F.lit(f"_v{version}"))


def copy_nodes(graph: Graph, version: str, chosen: DataFrame | None = None) -> tuple[Graph, DataFrame]:
    """(graph, map): copies of original nodes with a code (of those chosen by node_id, or all) in a version, and (node_id, copy_id) of all copies there.

    A copy has code ``{code}_v{version}``, no id, and graph_id of its origin. Copies that are there already are left alone.
    """
    source = graph.originals().where("code IS NOT NULL")
    if chosen is not None:
        source = source.join(chosen.select("node_id"), "node_id", "left_semi")
    copied = source.select(copy_key(version, F.col("node_id")).alias("copy_id"), "node_id", copy_key(version, F.col("code")).alias("code"), "name", "type", "labels", "confidence")
    new = copied.join(graph.nodes.select(F.col("node_id").alias("copy_id")), "copy_id", "left_anti")
    none = F.lit(None).cast("string")
    nodes = new.select(F.col("copy_id").alias("node_id"), none.alias("iri"), none.alias("id"), "code", "name", "type", "labels", F.lit(version).alias("version"), "confidence")
    links = new.select("node_id", "copy_id", "code")
    own = graph.props.where(~F.col("key").isin("id", "code", "cope_version", "graph_id")).join(links, "node_id").select(F.col("copy_id").alias("node_id"), "key", "kind", "raw", "num")
    marks = links.select(F.col("copy_id").alias("node_id"), F.explode(F.create_map(F.lit("code"), F.col("code"), F.lit("cope_version"), F.lit(version), F.lit("graph_id"), F.col("node_id"))).alias("key", "raw"))
    props = own.unionByName(full(marks.withColumn("kind", F.lit("string")), PROPS))
    grown = graph.with_(nodes=graph.nodes.unionByName(full(nodes, NODES)), props=graph.props.unionByName(props))
    return grown, copied.select("node_id", "copy_id")


def copy_edges(graph: Graph, mapping: DataFrame, version: str) -> DataFrame:
    """The edges between mapped nodes, moved to their copies; edges that leave the map are dropped, and each comes once."""
    ends = lambda end: mapping.select(F.col("node_id").alias(end), F.col("copy_id").alias(f"new_{end}"))
    moved = graph.edges.where(F.coalesce("version", F.lit("")) == "").join(ends("src"), "src").join(ends("dst"), "dst")
    return moved.select(*(F.col(f"new_{c}").alias(c) if c in ("src", "dst") else F.lit(version).alias(c) if c == "version" else F.col(c) for c in graph.edges.columns))


def clone_all(graph: Graph, version: str) -> Graph:
    """With every original node that has a code, and all edges between them, copied into a version."""
    grown, mapping = copy_nodes(graph, version)
    return grown.with_(edges=graph.edges.unionByName(copy_edges(graph, mapping, version)))


def clone_selected(graph: Graph, seeds: DataFrame, version: str, by_prefix: bool = True) -> Graph:
    """With the seeds and what lies downstream of them over inference edges copied into a version."""
    grown, mapping = copy_nodes(graph, version, inference_closure(graph, seeds, by_prefix=by_prefix))
    return grown.with_(edges=graph.edges.unionByName(copy_edges(graph, mapping, version)))


def delete_version(graph: Graph, version: str) -> Graph:
    return delete_nodes(graph, graph.nodes.where(F.col("version") == version))


def update_props(graph: Graph, updates: DataFrame) -> Graph:
    """With properties replaced or added by ``updates`` (node_id, key, kind, raw, num); edges stay."""
    kept = graph.props.join(updates.select("node_id", "key"), ["node_id", "key"], "left_anti").select(*graph.props.columns)
    return graph.with_(props=kept.unionByName(full(updates, PROPS)))


def update_entity(graph: Graph, node_id: str, values: dict, version: str | None = None) -> Graph:
    """With new values on one node; with a version, on its copy there, which is made first where an original is meant."""
    target = node_id
    if version is not None:
        one = graph.spark.createDataFrame([(node_id,)], "node_id string")
        graph, _ = copy_nodes(graph, version, one)
        target = f"{node_id}_v{version}"
    rows = [(target, k, kind_of(v), raw_of(v), float(v) if kind_of(v) in ("integer", "float") else None) for k, v in values.items()]
    frame = graph.spark.createDataFrame(rows, PROPS)
    return update_props(graph, frame.withColumn("raw", raw_column(F.col("kind"), F.col("raw"), F.col("num"))))


@dataclass
class VersionControl:
    """Snapshots of graphs by name. Graphs are immutable, so a snapshot is a reference and a rollback costs nothing."""

    snapshots: dict[str, Graph] = field(default_factory=dict)

    def snapshot(self, name: str, graph: Graph) -> None:
        self.snapshots[name] = graph

    def rollback(self, name: str) -> Graph:
        if name not in self.snapshots:
            raise StoreError(f"no snapshot {name!r}", "not_found")
        return self.snapshots[name]

    @staticmethod
    def resolve_code(graph: Graph, code: str, version: str) -> DataFrame:
        """The node with a code in a version, else the original one."""
        found = graph.nodes.where((F.col("code") == code) & (F.coalesce("version", F.lit("")) == "") | (F.col("code") == f"{code}_v{version}") & (F.col("version") == version))
        return found.orderBy(F.col("version").desc_nulls_last()).limit(1)
