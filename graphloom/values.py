"""Typed property values in long form: (kind, raw, num).

``kind`` is string, integer, float, boolean, list, map or null. ``raw`` is the canonical text, so values are equal exactly if kind and raw are. ``num`` is the
number of an integer or float, else null.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("string", "integer", "float", "boolean", "list", "map", "null")


def kind_of(value) -> str:
    if value is None:
        return "null"
    for kind, types in (("boolean", bool), ("integer", int), ("float", float), ("string", str), ("list", (list, tuple)), ("map", dict)):
        if isinstance(value, types):
            return kind
    raise TypeError(f"no kind for {type(value).__name__}")


def raw_of(value) -> str | None:
    """The canonical text of a Python value; that of a float is made by Spark (see :func:`raw_column`)."""
    kind = kind_of(value)
    if kind == "null":
        return None
    if kind in ("list", "map"):
        return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    return str(value).lower() if kind == "boolean" else str(value)


def raw_column(kind: Column, raw: Column, num: Column) -> Column:
    """Canonical text: floats by Spark's own rendering, so that equal numbers have equal texts."""
    return F.when(kind == "float", num.cast("string")).otherwise(raw)


def same(kind: Column, raw: Column, value) -> Column:
    """Strict equality with a literal: 1, 1.0 and "1" differ from each other."""
    k = kind_of(value)
    if k == "null":
        return kind == "null"
    text = F.lit(float(value)).cast("string") if k == "float" else F.lit(raw_of(value))
    return (kind == k) & (raw == text)


def loose_number(kind: Column, raw: Column, num: Column) -> Column:
    """The number of a numeric value or of a string that holds one, else null."""
    return F.when(kind == "string", raw.try_cast("double")).otherwise(num)


def literal(text: str):
    """A constant in rule text: integer, float, true or false, else a string."""
    for make in (int, float):
        try:
            return make(text)
        except ValueError:
            pass
    return {"true": True, "false": False}.get(text, text)
