"""Descriptions of callable tools for language models, and their schemas from example values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from ..operators.pattern import EdgePattern, NodePattern
from .text import find_json


def schema_of(value) -> dict:
    """The JSON schema of a value; a list's items are like its first."""
    if isinstance(value, bool):
        return {"type": "boolean"}
    if isinstance(value, int):
        return {"type": "integer"}
    if isinstance(value, float):
        return {"type": "number"}
    if isinstance(value, (list, tuple)):
        return {"type": "array", "items": schema_of(value[0]) if value else {}}
    if isinstance(value, dict):
        return object_schema(list(value.items()))
    return {"type": "null"} if value is None else {"type": "string"}


def object_schema(pairs: list[tuple[str, object]], required: list[str] | None = None) -> dict:
    return {"type": "object", "properties": {k: schema_of(v) for k, v in pairs}, "required": required or []}


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict = field(default_factory=lambda: object_schema([]))

    def as_dict(self) -> dict:
        return {"type": "function", "function": {"name": self.name, "description": self.description, "parameters": self.parameters}}


@dataclass(frozen=True)
class Call:
    name: str
    arguments: str

    def parsed(self) -> dict:
        found = json.loads(self.arguments or "{}")
        if not isinstance(found, dict):
            raise ValueError("arguments are an object")
        return found


class Tools(list):
    def find(self, name: str) -> Tool | None:
        return next((t for t in self if t.name == name), None)


#: What the engine offers to call.
ENGINE_TOOLS = Tools(
    Tool(name, text, object_schema(list(example.items()), required))
    for name, text, example, required in (
        ("search_entities", "Entities by code, type, class closure, keyword, properties or place", {"code": "", "type": "", "subclass_of": "", "keyword": "", "radius_m": 0.0}, []),
        ("get_entity_context", "Properties, types and relations around an entity", {"id": ""}, ["id"]),
        ("load_rules", "Add rules", {"text": ""}, ["text"]),
        ("execute_reasoning", "Run the rules to a fixpoint", {"version": ""}, []),
        ("update_entity", "New values of properties, in a version or in place", {"id": "", "properties": {}, "version": ""}, ["id", "properties"]),
        ("create_entity", "A new entity", {"code": "", "name": "", "type": ""}, ["code"]),
        ("create_type", "A new type below another", {"name": "", "parent": ""}, ["name"]),
        ("create_patrol", "A route with its entities", {"code": "", "name": "", "path": [[0.0]]}, ["code", "name"]),
        ("simulate_patrol", "Legs, times and costs of a route", {"code": ""}, ["code"]),
        ("simulate_strike", "Range, score and damage of an engagement", {"attacker": "", "target": "", "weapon": ""}, ["attacker", "target"]),
        ("infer_forward", "Search from an entity over inference edges", {"id": "", "depth": 1}, ["id"]),
        ("create_relationship", "An edge between nodes named by id, code or name", {"start": "", "end": "", "rel_type": ""}, ["start", "end", "rel_type"]),
        ("infer_on_nodes", "Copy, inherit and follow inference edges from nodes", {"ids": [""], "confidence": 0.8, "version": ""}, ["ids"]),
    )
)


@dataclass(frozen=True)
class Response:
    """What a model answered: its kind (tool_calls, json or text), the JSON in it, and its calls."""

    kind: str
    json: str | None
    calls: tuple[Call, ...] = ()


def response(text: str) -> Response:
    found = find_json(text)
    try:
        body = json.loads(text)
        calls = [c["function"] for choice in body["choices"] for c in (choice.get("message") or {}).get("tool_calls") or []]
    except (ValueError, KeyError, TypeError):
        calls = []
    if calls:
        return Response("tool_calls", found, tuple(Call(c["name"], c["arguments"]) for c in calls))
    return Response("json" if found else "text", found)


def match_text(start: NodePattern, edge: EdgePattern, end: NodePattern) -> str:
    """A pattern as text of a graph query language; values are quoted, never pasted as they are."""

    def quoted(v) -> str:
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(v, str) else json.dumps(v)

    def node(name: str, p: NodePattern) -> str:
        known = ", ".join(f"{k}: {quoted(v)}" for k, v in sorted(p.props.items()))
        return f"({name}{':' + p.label if p.label else ''}{' {' + known + '}' if known else ''})"

    link = f"[r{':' + edge.rel_type if edge.rel_type else ''}]"
    arrow = {"out": f"-{link}->", "in": f"<-{link}-", "both": f"-{link}-"}[edge.direction]
    return f"MATCH {node('a', start)}{arrow}{node('b', end)} RETURN a, r, b"


def describe(start: NodePattern, edge: EdgePattern, end: NodePattern) -> str:
    """A pattern in words."""

    def node(p: NodePattern) -> str:
        known = " and ".join(f"{k} is {v!r}" for k, v in sorted(p.props.items()))
        return f"{p.label or 'any node'}{' where ' + known if known else ''}"

    link = edge.rel_type or "any relation"
    return {"out": f"{node(start)} with {link} to {node(end)}", "in": f"{node(start)} with {link} from {node(end)}", "both": f"{node(start)} with {link} to or from {node(end)}"}[edge.direction]
