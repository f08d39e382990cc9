"""A small plan language that is neutral to where a graph lives, and its execution as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import StoreError
from ..functions.text import path_parts
from ..operators import pattern
from ..sources.graph import Graph

#: Functions that a plan can call: name to (graph, arguments) -> DataFrame.
FUNCTIONS: dict[str, Callable[[Graph, dict], DataFrame]] = {}


@dataclass(frozen=True)
class Plan:
    """A plan by name with its arguments; see :func:`execute`."""

    name: str
    args: dict


def parse_call(text: str) -> Plan:
    """The call plan of ``func:name(key=value, key=value)``; values are texts."""
    found = re.fullmatch(r"(?:func:)?([\w.-]+)\s*(?:\((.*)\))?", text.strip(), re.S)
    if not found:
        raise StoreError(f"not a call: {text!r}", "invalid_data")
    pairs = [p.partition("=") for p in (found[2] or "").split(",") if p.strip()]
    return Plan("call", {"function": found[1], "args": {k.strip(): v.strip().strip("'\"") for k, _, v in pairs}})


def json_path(graph: Graph, code: str, path: str) -> DataFrame:
    """The value (column value) at a dotted path in a node's properties; maps and lists are kept as JSON text."""
    parts = path_parts(path)
    own = pattern.get_nodes(graph, [code]).select("node_id")
    rows = graph.props.where(F.col("key") == parts[0]).join(own, "node_id", "left_semi")
    if len(parts) == 1:
        return rows.select(F.col("raw").alias("value"))
    return rows.select(F.get_json_object("raw", "$" + "".join(f"['{p}']" for p in parts[1:])).alias("value"))


def execute(graph: Graph, plan: Plan) -> DataFrame:
    """Plans: get_by_code, get_by_label, relationships, pattern, parent_types, downstream, validate, json_path, call and rule."""
    a = plan.args
    match plan.name:
        case "get_by_code":
            return pattern.get_nodes(graph, [a["code"]])
        case "get_by_label":
            return graph.labelled(a["label"])
        case "relationships":
            return pattern.relationships(graph, a["node"], a.get("rel_type"), a.get("direction", "out"))
        case "pattern":
            return pattern.match(graph, a.get("start", pattern.NodePattern()), a.get("edge", pattern.EdgePattern()), a.get("end", pattern.NodePattern()))
        case "parent_types":
            return pattern.parent_types(graph, a["child"])
        case "downstream":
            return pattern.discover_downstream(graph, a["node"], a.get("rel_types"))
        case "validate":
            return pattern.check_nodes(graph, pattern.get_nodes(graph, [a["code"]]), a["checks"])
        case "json_path":
            return json_path(graph, a["code"], a["path"])
        case "rule":
            from .fixpoint import derive_once

            return derive_once(graph, a["rule"])
        case "call":
            if a["function"] not in FUNCTIONS:
                raise StoreError(f"no function {a['function']!r}", "not_found")
            return FUNCTIONS[a["function"]](graph, a.get("args", {}))
    raise StoreError(f"unknown plan {plan.name!r}")
