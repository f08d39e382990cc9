"""The vocabulary of the graph: labels, relations, keys and how they map to ontology terms."""

from __future__ import annotations

# Names that graphs in use hold.

NAMESPACES = {
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}

OWL_LABELS = ("Class", "Individual", "Property", "Restriction", "Axiom", "Ontology")

#: In the order in which a first match is looked for.
DOMAIN_LABELS = ("Entity", "Event", "Patrol", "Strike", "Type", "Behavior")

RULE_LABEL = "Rule"

INSTANCE_OF, SUB_CLASS_OF, HAS_VALUE = "INSTANCE_OF", "subClassOf", "HAS_VALUE"

RELATIONS = (
    "INSTANCE_OF", "subClassOf", "subPropertyOf", "HAS_PROPERTY", "HAS_RANGE", "HAS_VALUE", "equivalentClass", "disjointWith",
    "sameAs", "differentFrom", "inverseOf", "complementOf", "intersectionOf", "unionOf", "oneOf",
)

ASPECTS = ("transitive", "symmetric", "functional", "inverseFunctional", "reflexive", "irreflexive", "deprecated")

BEHAVIOR_KEYS = ("hasPrecondition", "hasEffect", "hasCost", "hasDuration", "hasPriority", "composedOf")

AUDIT_KEYS = ("id", "graph_id", "name", "code", "create_time", "create_user", "update_time", "update_user", "delete_flag", "is_system")

EDGE_ACTION_KEYS = ("actionType", "required", "validationType", "ruleId", "func", "id", "msg", "synonym", "queryVariant")

#: Keys of entities that have a type of their own; any other key is kept as it comes.
ENTITY_STRINGS = (
    "code", "id", "unit_id", "graph_id", "domain", "name", "type", "update_time", "create_time", "static_rule_id", "dynamic_rule_id",
    "description", "status", "version", "cope_version", "source", "owner", "parent_id", *BEHAVIOR_KEYS,
)
ENTITY_INTEGERS = ("leven", "command_side")
ENTITY_FLOATS = ("confidence", "speed", "power")
ENTITY_LISTS = ("Space_abs",)

#: Keys that a child does not inherit from a type.
META_KEYS = ("code", "id", "name", "graph_id", "iri", "type")

INFERENCE_PREFIXES = ("rdfs:", "owl2:", "swrl:", "sh:", "rule:", "func:")

LABEL_OF_ENTITY = {
    "Class": "Class", "ObjectProperty": "Property", "DatatypeProperty": "Property", "AnnotationProperty": "Property",
    "NamedIndividual": "Individual", "Restriction": "Restriction", "Ontology": "Ontology", "Axiom": "Axiom",
}
ENTITY_OF_LABEL = {
    "Class": "Class", "Individual": "NamedIndividual", "Property": "ObjectProperty", "Restriction": "Restriction", "Ontology": "Ontology", "Axiom": "Axiom",
}
RELATION_OF_AXIOM = {
    "ClassAssertion": "INSTANCE_OF", "SubClassOf": "subClassOf", "SubPropertyOf": "subPropertyOf", "ObjectPropertyDomain": "HAS_PROPERTY",
    "ObjectPropertyRange": "HAS_RANGE", "DataPropertyAssertion": "HAS_VALUE", "EquivalentClasses": "equivalentClass", "DisjointClasses": "disjointWith",
    "SameIndividual": "sameAs", "DifferentIndividuals": "differentFrom", "InverseObjectProperties": "inverseOf",
}
AXIOM_OF_RELATION = {r: a for a, r in RELATION_OF_AXIOM.items()}
RDF_PREDICATES = {
    "ClassAssertion": "rdf:type", "SubClassOf": "rdfs:subClassOf", "SubPropertyOf": "rdfs:subPropertyOf", "ObjectPropertyAssertion": "(direct)",
    "DataPropertyAssertion": "(data edge)", "ObjectPropertyDomain": "rdfs:domain", "ObjectPropertyRange": "rdfs:range", "EquivalentClasses": "owl:equivalentClass",
    "DisjointClasses": "owl:disjointWith", "SameIndividual": "owl:sameAs", "DifferentIndividuals": "owl:differentFrom", "InverseObjectProperties": "owl:inverseOf",
    "Other": "(unknown)",
}
KEY_CATEGORIES = {**dict.fromkeys(("iri", "type", "value", "domain", "range"), "Core"), **dict.fromkeys(("label", "comment"), "Annotation"), **dict.fromkeys(ASPECTS, "OwlAspect")}


def rdf_type(entity: str) -> str:
    """The RDF type of a kind of ontology entity."""
    if entity not in LABEL_OF_ENTITY:
        raise KeyError(entity)
    return f"owl:{entity}"


def is_annotation(key: str) -> bool:
    return KEY_CATEGORIES.get(key) == "Annotation"


def is_aspect(key: str) -> bool:
    return KEY_CATEGORIES.get(key) == "OwlAspect"


def is_known_label(label: str) -> bool:
    return label in ENTITY_OF_LABEL or label in DOMAIN_LABELS or label == RULE_LABEL


def is_individual_label(label: str) -> bool:
    return ENTITY_OF_LABEL.get(label) == "NamedIndividual" or label in DOMAIN_LABELS or label == RULE_LABEL


def is_class_label(label: str) -> bool:
    return label in ("Class", "Type")


def is_known_relation(relation: str) -> bool:
    return relation in AXIOM_OF_RELATION
