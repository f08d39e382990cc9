"""Language prefixes of expressions and relation types, and where an edge is routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import MappingError
from ..vocab import INFERENCE_PREFIXES, RELATIONS


def parse(expression: str) -> tuple[str, str]:
    """(prefix without colon, body); the body may be empty, and prefixes are case-sensitive."""
    for p in INFERENCE_PREFIXES:
        if expression.startswith(p):
            return p[:-1], expression[len(p) :]
    raise MappingError(f"no language prefix: {expression[:60]!r}", "conversion")


def prefix_of(expression: Column) -> Column:
    """The prefix without its colon, or null."""
    return F.nullif(F.regexp_extract(expression, "^(rdfs|owl2|swrl|sh|rule|func):", 1), F.lit(""))


def body_of(expression: Column) -> Column:
    return F.when(prefix_of(expression).isNotNull(), F.substr(expression, F.length(prefix_of(expression)) + 2))


def grouped(df: DataFrame, column: str) -> DataFrame:
    """Distinct expressions by prefix (null for none): (prefix, expression, n), n times each; no group is gathered in one row."""
    return df.groupBy(prefix_of(F.col(column)).alias("prefix"), F.col(column).alias("expression")).agg(F.count(F.lit(1)).alias("n"))


def route(edges: DataFrame) -> DataFrame:
    """``edges`` with column target: llm_only, custom_func, facts, rules, direction, extract or non_inference.

    An action type other than inference comes first, then a function on the edge, then the prefix of the relation type.
    """
    p, rel = prefix_of(F.col("rel_type")), F.col("rel_type")
    other = F.col("action_type").isNotNull() & (F.col("action_type") != "inference")
    target = (
        F.when(other, "llm_only")
        .when(F.col("func").isNotNull(), "custom_func")
        .when(p.isin("rdfs", "owl2"), "facts")
        .when(p.isin("swrl", "sh"), "rules")
        .when(p == "rule", "direction")
        .when(p == "func", "extract")
        .when(rel.isin(*RELATIONS), "facts")
        .otherwise("non_inference")
    )
    return edges.withColumn("target", target)
