"""Rule files, event and log sinks, and the rendering of a graph as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.rules import Parser, Rule
from .graph import Graph


#: What ends a word of a rule's text; names may have colons, slashes, hashes, dots and hyphens inside.
WORD_ENDS = r"[^\w:/#.-]+"


def read_rules(spark: SparkSession, path: str, parser: Parser | None = None) -> list[Rule]:
    """The rules of the text files at a path that Spark can read; rule sets are small and parsed on the driver."""
    texts = [r.value for r in spark.read.text(path, wholetext=True).orderBy(F.input_file_name()).collect()]
    return [rule for t in texts for rule in (parser or Parser()).parse_all(t)]


def find_rules(spark: SparkSession, path: str, edges: DataFrame) -> DataFrame:
    """Edges (src, rel_type, dst) with the rule files that have any of the three as a word: (src, rel_type, dst, rule_name, source_file).

    The name of a file's first rule in brackets is shown, else the file's. Names are joined with the distinct words of the files, by equality.
    """
    files = spark.read.text(path, wholetext=True).withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)\.\w+$", 1))
    first = F.regexp_extract("value", r"(?m)^.*?\[([^\]\n]*)\]", 1)
    named = files.select("source_file", "value", F.when(first != "", first).otherwise(F.col("source_file")).alias("rule_name"))
    said = named.select("source_file", "rule_name", F.explode(F.array_distinct(F.split("value", WORD_ENDS))).alias("word")).where("word <> ''")
    out = ["src", "rel_type", "dst"]
    hits = [edges.join(said, F.col(c) == F.col("word")).select(*out, "rule_name", "source_file") for c in out]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()


def rule_nodes(graph: Graph) -> DataFrame:
    """Rules kept as nodes: (node_id, text)."""
    text = graph.props.where(F.col("key").isin("rule", "text", "body")).groupBy("node_id").agg(F.min("raw").alias("text"))
    return graph.labelled("Rule").select("node_id").join(text, "node_id", "left")


def write_events(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines."""
    rows.write.mode(mode).json(path)


def write_log(rows: DataFrame, path: str, mode: str = "append", line: str = "line") -> None:
    """One column of lines as text files."""
    rows.select(F.col(line).alias("value")).write.mode(mode).text(path)


def value_to_json(props: DataFrame) -> DataFrame:
    """A JSON object of properties per node: (node_id, json); numbers that JSON has not become null."""
    own = F.when(F.col("kind").isin("string", "iri"), F.to_json(F.array("raw")).substr(F.lit(2), F.length(F.to_json(F.array("raw"))) - 2)).when(F.col("kind") == "null", F.lit("null"))
    own = own.when((F.col("kind") == "float") & (F.isnan("num") | (F.abs("num") == float("inf"))), F.lit("null")).otherwise(F.col("raw"))
    pair = F.concat(F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(":"), own)
    return props.groupBy("node_id").agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")).alias("json"))


def render(graph: Graph, limit: int = 50) -> str:
    """A short markdown view of a graph for prompts: counts, then nodes and edges up to a limit, which is what makes it short."""
    counts = {r.label: r.n for r in graph.health().collect()}
    lines = ["# Graph", *(f"- {k}: {n}" for k, n in sorted(counts.items())), "", "## Nodes"]
    lines += [f"- {r.node_id} ({', '.join(r.labels)})" for r in graph.nodes.orderBy("node_id").limit(limit).collect()]
    lines += ["", "## Edges", *(f"- {r.src} -[{r.rel_type}]-> {r.dst}" for r in graph.edges.orderBy("src", "rel_type", "dst").limit(limit).collect())]
    return "\n".join(lines)
