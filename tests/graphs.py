"""Small graphs that several tests use."""

from graphloom.sources.graph import from_rows

NS = "http://ex#"


def family(spark):
    """Three people: Alice hasParent Bob, Bob hasBrother Charlie."""
    nodes = [{"labels": ["Class"], "iri": NS + c, "label": c} for c in ("Person", "Uncle")]
    nodes += [{"labels": ["Individual"], "iri": NS + i, "label": i} for i in ("Alice", "Bob", "Charlie")]
    edges = [{"src": NS + i, "rel_type": "INSTANCE_OF", "dst": NS + "Person"} for i in ("Alice", "Bob", "Charlie")]
    edges += [{"src": NS + "Alice", "rel_type": NS + "hasParent", "dst": NS + "Bob"}, {"src": NS + "Bob", "rel_type": NS + "hasBrother", "dst": NS + "Charlie"}]
    return from_rows(spark, nodes, edges)


def demo(spark):
    """Five people with parents, brothers and ages."""
    people = ("Alice", "Bob", "Charlie", "Diana", "Eve")
    nodes = [{"labels": ["Class"], "iri": c} for c in ("Person", "Parent", "Uncle", "Brother", "Adult")] + [{"labels": ["Individual"], "iri": i} for i in people]
    nodes.append({"labels": ["Property"], "iri": "hasAge"})
    edges = [{"src": i, "rel_type": "INSTANCE_OF", "dst": "Person"} for i in people]
    edges += [{"src": a, "rel_type": r, "dst": b} for a, r, b in (("Alice", "hasParent", "Bob"), ("Bob", "hasBrother", "Charlie"), ("Eve", "hasParent", "Diana"), ("Diana", "hasBrother", "Bob"))]
    edges += [{"src": i, "rel_type": "HAS_VALUE", "dst": "hasAge", "value": v, "value_kind": "string"} for i, v in (("Alice", "25"), ("Bob", "45"))]
    return from_rows(spark, nodes, edges)


def entity(spark):
    return from_rows(spark, [{"labels": ["Entity"], "code": "E001", "id": "n1", "status": "active", "power": 75.0, "speed": 30, "gone": None, "empty": ""}], [])
