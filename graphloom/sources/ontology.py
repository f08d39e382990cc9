"""An ontology's declarations as rows of a graph: classes, properties, individuals and assertions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..vocab import HAS_VALUE, INSTANCE_OF, SUB_CLASS_OF
from .graph import Graph, from_rows


@dataclass(frozen=True)
class ClassDecl:
    iri: str
    label: str | None = None
    comment: str | None = None
    super_classes: tuple[str, ...] = ()


@dataclass(frozen=True)
class PropertyDecl:
    """A property with its domain and range; ``aspects`` such as transitive and symmetric are kept, and imply nothing."""

    iri: str
    domain: str | None = None
    range: str | None = None
    label: str | None = None
    aspects: tuple[str, ...] = ()


@dataclass(frozen=True)
class IndividualDecl:
    iri: str
    label: str | None = None
    types: tuple[str, ...] = ()
    values: tuple[tuple[str, object], ...] = ()
    links: tuple[tuple[str, str], ...] = ()


@dataclass
class Ontology:
    classes: list[ClassDecl] = field(default_factory=list)
    properties: list[PropertyDecl] = field(default_factory=list)
    individuals: list[IndividualDecl] = field(default_factory=list)

    def rows(self) -> tuple[list[dict], list[dict]]:
        """(nodes, edges): classes with subClassOf edges, properties between domain and range, individuals with types, values and links."""
        some = lambda **k: {a: v for a, v in k.items() if v is not None}
        nodes, edges = [], []
        for c in self.classes:
            nodes.append({"labels": ["Class"], **some(iri=c.iri, label=c.label, comment=c.comment)})
            edges += [{"src": c.iri, "rel_type": SUB_CLASS_OF, "dst": s} for s in c.super_classes]
        for p in self.properties:
            nodes.append({"labels": ["Property"], **some(iri=p.iri, label=p.label), **dict.fromkeys(p.aspects, True)})
            edges += [{"src": p.domain, "rel_type": "HAS_PROPERTY", "dst": p.iri}] * (p.domain is not None) + [{"src": p.iri, "rel_type": "HAS_RANGE", "dst": p.range}] * (p.range is not None)
        for i in self.individuals:
            nodes.append({"labels": ["Individual"], **some(iri=i.iri, label=i.label)})
            edges += [{"src": i.iri, "rel_type": INSTANCE_OF, "dst": t} for t in i.types]
            edges += [{"src": i.iri, "rel_type": HAS_VALUE, "dst": p, "value": str(v), "value_kind": type(v).__name__} for p, v in i.values]
            edges += [{"src": i.iri, "rel_type": r, "dst": o} for r, o in i.links]
        return nodes, edges

    def graph(self, spark: SparkSession) -> Graph:
        return from_rows(spark, *self.rows())
