"""Behaviours of entities: preconditions as text, priorities and durations, and the parts that a behaviour is composed of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.language import body_of, prefix_of
from ..functions.text import clamped_priority, duration, listed
from ..sources.graph import Graph
from ..sources.work import written, written_any
from ..values import loose_number
from ..vocab import BEHAVIOR_KEYS


def behaviors(graph: Graph) -> DataFrame:
    """A row per entity with any behaviour key: (node_id, code, precondition, effect, cost, duration, priority, parts)."""
    own = graph.props.where(F.col("key").isin(*BEHAVIOR_KEYS))
    wide = own.groupBy("node_id").agg(*(F.max(F.when(F.col("key") == k, F.col("raw"))).alias(k) for k in BEHAVIOR_KEYS))
    text = lambda k: F.coalesce(k, F.lit(""))
    return wide.join(graph.labelled("Entity").select("node_id", "code"), "node_id").select(
        "node_id", "code", text("hasPrecondition").alias("precondition"), text("hasEffect").alias("effect"), text("hasCost").alias("cost"),
        duration(text("hasDuration")).alias("duration"), clamped_priority(text("hasPriority")).alias("priority"), listed(text("composedOf")).alias("parts"),
    )


def parsed_precondition(text: Column) -> Column:
    """A struct (op, key, value) of a precondition's text.

    In the order of matching: required(p), matches, !=, ==, >=, <=, =, >, <, exists(p). Empty and True give pass, False gives block, and
    what fits no form gives pass as well.
    """
    t = F.trim(text)
    forms = [("required", r"^required\(([^()]*)\)$", None), ("matches", r"^(.+?) matches (.+)$", 2), ("!=", r"^([^!]*)!=(.*)$", 2), ("==", r"^([^=]*)==(.*)$", 2), (">=", r"^([^>]*)>=(.*)$", 2),
             ("<=", r"^([^<]*)<=(.*)$", 2), ("=", r"^([^=]*)=(.*)$", 2), (">", r"^([^>]*)>(.*)$", 2), ("<", r"^([^<]*)<(.*)$", 2), ("exists", r"^exists\(([^()]*)\)$", None)]
    make = lambda op, key, value: F.struct(F.lit(op).alias("op"), key.alias("key"), value.alias("value"))
    none = F.lit(None).cast("string")
    out = F.when(t.isNull() | (t == "") | (F.lower(t) == "true"), make("pass", none, none)).when(F.lower(t) == "false", make("block", none, none))
    for op, pattern, group in forms:
        value = F.regexp_replace(F.trim(F.regexp_extract(t, pattern, group)), "^[\"']|[\"']$", "") if group else none
        out = out.when(t.rlike(pattern), make(op, F.trim(F.regexp_extract(t, pattern, 1)), value))
    return out.otherwise(make("pass", none, none))


#: Most keys that are listed to the scan of the properties.
MAX_KEYS = 1000


def named_keys(rows: DataFrame, text: str = "precondition") -> list[str] | None:
    """The keys of properties that the preconditions of ``rows`` name, at most MAX_KEYS; None if there are more."""
    found = rows.select(parsed_precondition(F.col(text))["key"].alias("key")).where("key IS NOT NULL").distinct().limit(MAX_KEYS + 1).collect()
    return [r.key for r in found] if len(found) <= MAX_KEYS else None


def graph_keys(graph: Graph) -> list[str] | None:
    """The keys that any precondition in the graph names: one scan of that property's partition."""
    return named_keys(graph.props.where(F.col("key") == "hasPrecondition"), "raw")


def passes(graph: Graph, rows: DataFrame, text: str = "precondition", keys: list[str] | None = None) -> DataFrame:
    """``rows`` (node_id and a precondition's text) with column passes: one join with the properties that the preconditions name.

    Equality is by the text of a value, order by its number; a comparison with what isn't there or is no number is false, and a property that holds
    null exists. With ``keys``, all that preconditions may name, only these partitions of the properties are read.
    """
    parsed = rows.withColumn("__p", parsed_precondition(F.col(text)))
    props = graph.props if keys is None else graph.props.where(F.col("key").isin(*keys) if keys else F.lit(False))
    props = props.select(F.col("node_id").alias("__node"), F.col("key").alias("__key"), "kind", "raw", "num")
    joined = parsed.join(props, (F.col("node_id") == F.col("__node")) & (F.col("__p.key") == F.col("__key")), "left")
    number, given = loose_number(F.col("kind"), F.col("raw"), F.col("num")), F.col("__p.value").try_cast("double")
    there, actual = F.col("__key").isNotNull(), F.coalesce("raw", F.lit(""))
    op = F.col("__p.op")
    held = (
        F.when(op == "pass", F.lit(True)).when(op == "block", F.lit(False))
        .when(op == "required", there & (F.col("kind") != "null") & (actual != ""))
        .when(op == "exists", there).when(op == "!=", actual != F.col("__p.value")).when(op.isin("==", "="), actual == F.col("__p.value"))
        .when(op == ">=", number >= given).when(op == "<=", number <= given).when(op == ">", number > given).when(op == "<", number < given)
        .when(op == "matches", F.regexp(actual, F.col("__p.value")))
    )
    return joined.withColumn("passes", F.coalesce(held, F.lit(False))).select(*rows.columns, "passes")


def effects(rows: DataFrame) -> DataFrame:
    """``rows`` with what an effect is handed to (run_rule, log) and its body; an effect without a prefix is tried as a rule."""
    prefix = prefix_of(F.col("effect"))
    return rows.withColumn("action", F.when(F.col("effect") == "", "none").when(prefix.isNull() | (prefix == "swrl"), "run_rule").otherwise("log")).withColumn("effect_body", F.coalesce(body_of(F.col("effect")), F.col("effect")))


def batch(graph: Graph) -> DataFrame:
    """All behaviours with anything to do, whether they pass, and their place in the order of execution (priority down, duration up, key)."""
    rows = behaviors(graph).where("precondition <> '' OR effect <> '' OR size(parts) > 0")
    return passes(graph, rows, keys=graph_keys(graph)).withColumn("order_key", F.struct((-F.col("priority")).alias("p"), "duration", "node_id"))


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`batch` with their place from 1, by partitions of a range partitioning and an offset per partition."""
    ranged = rows.repartitionByRange("order_key").sortWithinPartitions("order_key").withColumn("__at", F.monotonically_increasing_id())
    ranged = written(ranged, "ordered").withColumn("__part", F.shiftright("__at", 33))
    parts = ranged.groupBy(F.col("__part").alias("__own")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    # one row per partition, so the window is small whatever the rows
    parts = parts.selectExpr("*", "coalesce(sum(__n) OVER (ORDER BY __own ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS __before")
    joined = ranged.join(written(parts, "offsets"), F.col("__part") == F.col("__own"))
    return joined.withColumn("place", F.col("__at") - F.col("__first") + F.col("__before") + 1).select(*rows.columns, "place")


def composed(graph: Graph, max_depth: int = 5) -> DataFrame:
    """Behaviours with their parts, down to a depth: (root, node_id, depth), the root at depth 0; a part is named by code or name.

    A behaviour that does not pass has no parts run, and depth 0 is the behaviour alone.
    """
    rows = written(passes(graph, behaviors(graph), keys=graph_keys(graph)).select("node_id", "passes", "parts"), "behaviors")
    names = graph.labelled("Entity").select(F.col("node_id").alias("part"), F.explode(F.array_distinct(F.array_compact(F.array("code", "name")))).alias("text"))
    links = written(rows.where("passes").select("node_id", F.explode("parts").alias("text")).join(names, "text").select(F.col("node_id").alias("at"), "part").distinct(), "parts")
    level = rows.select(F.col("node_id").alias("root"), "node_id", F.lit(0).alias("depth"))
    out = level
    for depth in range(1, max_depth + 1):
        level, more = written_any(level.select("root", F.col("node_id").alias("at")).join(links, "at").select("root", F.col("part").alias("node_id"), F.lit(depth).alias("depth")).distinct(), "level")
        if not more:
            break
        out = out.unionByName(level)
    return out
