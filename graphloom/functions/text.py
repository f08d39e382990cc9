"""Scalar helpers on text: JSON paths and values, dates, lists, and the search for JSON in model responses."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_parts(path: str) -> list[str]:
    """``$.a.b`` as [a, b]."""
    return [p for p in path.removeprefix("$").removeprefix(".").split(".") if p]


def at_path(document: Column, path: str) -> Column:
    """The text at a dotted path of a JSON text, null where there is none."""
    return F.get_json_object(document, "$" + "".join(f"['{p}']" for p in path_parts(path)))


def json_rows(df: DataFrame, column: str, key: str) -> DataFrame:
    """Long-form values (key, name, kind, raw, num) of the top level of JSON objects; an invalid text gives no rows.

    The text of each value comes from a map, its kind from the variant: so "7" in quotes stays a string.
    """
    names = F.map_entries(F.from_json(F.col(column), "map<string,string>"))
    shape = F.schema_of_variant(F.try_parse_json(F.col(column)))
    entries = df.select(F.col(key), shape.alias("shape"), F.explode(names).alias("e")).select(key, "shape", F.col("e.key").alias("name"), F.col("e.value").alias("raw"))
    of = F.call_function("regexp_extract", F.col("shape"), F.concat(F.lit(r"[<,] ?\Q"), F.col("name"), F.lit(r"\E: (\w+)")), F.lit(1))
    kind = F.when(of.isin("BIGINT"), "integer").when(of.isin("DOUBLE", "FLOAT", "DECIMAL"), "float").when(of == "BOOLEAN", "boolean").when(of == "ARRAY", "list").when(of == "OBJECT", "map").when(of == "VOID", "null").otherwise("string")
    return entries.select(key, "name", kind.alias("kind"), "raw", F.when(kind.isin("integer", "float"), F.col("raw").try_cast("double")).alias("num"))


def is_iso_time(text: Column, strict: bool = False) -> Column:
    """Whether a text looks like an ISO date and time: it has a T or, if strict, it parses."""
    return F.try_to_timestamp(text).isNotNull() & text.contains("T") if strict else text.contains("T")


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def clamped_priority(text: Column) -> Column:
    """An integer from 0 to 10; 0 for anything else than an integer."""
    return F.greatest(F.lit(0), F.least(F.lit(10), F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0))))


def duration(text: Column) -> Column:
    return F.coalesce(F.trim(text).try_cast("bigint"), F.lit(0))


def listed(text: Column, sign: str = ";") -> Column:
    """The non-empty trimmed items of a list in a text."""
    return F.filter(F.transform(F.split(text, sign), lambda x: F.trim(x)), lambda x: x != "")


def string_items(items: Column) -> Column:
    """The string items of a JSON list; others are left out."""
    parts = F.try_variant_get(F.try_parse_json(items), F.lit("$"), "array<variant>")
    return F.transform(F.filter(parts, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, F.lit("$"), "string"))


def stable_id(prefix: str, *parts: Column) -> Column:
    """An id made of its parts, the same in every run."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(32)))


def rendered(kind: Column, raw: Column, num: Column) -> Column:
    """A value as shown in prompts: strings in quotes, floats with six decimals."""
    return F.when(kind == "string", F.concat(F.lit('"'), raw, F.lit('"'))).when(kind == "float", F.format_string("%.6f", num)).when(kind == "null", F.lit("null")).otherwise(raw)


def balanced_object(text: str) -> str | None:
    """The first object in balanced braces, braces inside strings aside."""
    at = text.find("{")
    depth, quoted, escaped = 0, False, False
    for k in range(at, len(text)) if at >= 0 else ():
        c = text[k]
        if quoted:
            quoted, escaped = (c != '"' or escaped), c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[at : k + 1]
    return None


def find_json(text: str) -> str | None:
    """The JSON in a model's response: the whole text, a fenced block, a tool call's arguments, or the first balanced object."""
    fenced = re.search(r"```(?:json)?\s*\n(.*?)```", text, re.S)
    for candidate in (text, fenced and fenced[1], balanced_object(text)):
        try:
            found = json.loads(candidate) if candidate else None
        except ValueError:
            continue
        if isinstance(found, dict) and isinstance(found.get("choices"), list):
            calls = [c for choice in found["choices"] for c in (choice.get("message") or {}).get("tool_calls") or []]
            content = next((choice["message"].get("content") for choice in found["choices"] if choice.get("message")), None)
            return calls[0]["function"]["arguments"] if calls else find_json(content) if content else None
        if isinstance(found, (dict, list)):
            return json.dumps(found, ensure_ascii=False, sort_keys=True)
    return None


def extracted_json(df: DataFrame, column: str, out: str = "json") -> DataFrame:
    """``df`` with the JSON found in each text; balanced braces are beyond regular expressions, so this runs in Arrow batches."""
    @F.pandas_udf("string")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: find_json(t) if isinstance(t, str) else None)

    return df.withColumn(out, find(F.col(column)))
