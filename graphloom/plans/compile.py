"""Rule bodies as joins over facts, and heads as projections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FixpointError
from ..functions.builtins import holds
from ..operators.classes import instances
from ..sources.graph import Graph
from ..vocab import HAS_VALUE, INSTANCE_OF
from .rules import BUILTIN, CLASS, DATA, DIFFERENT, QUERY, RELATION, SAME, Atom, Rule

FACT = ("kind", "subject", "predicate", "object")


def base_facts(graph: Graph) -> DataFrame:
    """The edges of a graph as facts (kind, subject, predicate, object): class, relation and data facts."""
    kind = F.when(F.col("rel_type") == INSTANCE_OF, CLASS).when(F.col("rel_type") == HAS_VALUE, DATA).otherwise(RELATION)
    data = F.col("rel_type") == HAS_VALUE
    return graph.edges.select(
        kind.alias("kind"), F.col("src").alias("subject"), F.when(data, F.col("dst")).otherwise(F.col("rel_type")).alias("predicate"),
        F.when(data, F.col("value")).otherwise(F.col("dst")).alias("object"),
    )


@dataclass
class Known:
    """All facts so far: a graph's edges and derived facts. Atoms read the edges by relation type, so that their partitions are pruned.

    ``data`` are the predicates that have data facts; None if that isn't known.
    """

    edges: DataFrame
    derived: list[DataFrame] = field(default_factory=list)
    data: frozenset[str] | None = None

    def of(self, predicate: str, cls: str = "") -> DataFrame:
        """Facts (FACT) of a predicate; of class facts, those of one class."""
        fact = lambda rows, kind, subject, object_: rows.select(F.lit(kind).alias("kind"), F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"), F.col(object_).alias("object"))
        if cls:
            out = fact(self.edges.where((F.col("rel_type") == INSTANCE_OF) & (F.col("dst") == cls)), CLASS, "src", "dst")
        else:
            if predicate in (HAS_VALUE, INSTANCE_OF):
                out = None
            else:
                out = fact(self.edges.where(F.col("rel_type") == predicate), RELATION, "src", "dst")
            if out is None or self.data is None or predicate in self.data:
                values = fact(self.edges.where((F.col("rel_type") == HAS_VALUE) & (F.col("dst") == predicate)), DATA, "src", "value")
                out = values if out is None else out.unionByName(values)
        for part in self.derived:
            out = out.unionByName(facts_of(part, predicate, cls))
        return out


def facts_of(facts: DataFrame, predicate: str, cls: str = "") -> DataFrame:
    rows = facts.select(*FACT).where(F.col("predicate") == predicate)
    return rows.where((F.col("kind") == CLASS) & (F.col("object") == cls)) if cls else rows.where(F.col("kind") != CLASS)


def atom_rows(source: Known | DataFrame, atom: Atom) -> DataFrame:
    """Bindings of one relational atom: a string column per variable; constants filter and a repeated variable unifies."""
    predicate, cls = (INSTANCE_OF, atom.name) if atom.kind == CLASS else (atom.name, "")
    rows = source.of(predicate, cls) if isinstance(source, Known) else facts_of(source, predicate, cls)
    bound: dict[str, str] = {}
    for slot, arg in zip(("subject", "object"), atom.args):
        if not arg.startswith("?"):
            number = atom.kind == DATA and slot == "object"
            same = F.col(slot) == arg
            rows = rows.where(F.coalesce(F.col(slot).try_cast("double") == F.lit(arg).try_cast("double"), same) if number else same)
        elif arg in bound:
            rows = rows.where(F.col(slot) == F.col(bound[arg]))
        else:
            bound[arg] = slot
    return rows.select(*(F.col(slot).alias(arg[1:]) for arg, slot in bound.items())) if bound else rows.select(F.lit(True).alias("__any")).limit(1)


def joined(left: DataFrame | None, right: DataFrame, same: list[tuple[str, str]] = (), products: bool = False) -> DataFrame:
    """The natural join of bindings, also on variables that ``same`` pairs. Bindings without either have a product, which must be asked for."""
    if left is None:
        return right
    shared = [c for c in left.columns if c in right.columns and c != "__any"]
    if shared:
        return left.join(right.drop("__any") if "__any" in left.columns else right, shared)
    pairs = [p for a, b in same for p in ((a, b), (b, a)) if p[0] in left.columns and p[1] in right.columns]
    if pairs:
        return left.join(right, [F.col(f"`{a}`") == F.col(f"`{b}`") for a, b in pairs])
    if "__any" not in left.columns and "__any" not in right.columns and not products:
        raise FixpointError(f"atoms over {left.columns} and {right.columns} share no variable, so they have a product; ask for it by products=True")
    return left.crossJoin(right.drop("__any") if "__any" in left.columns else right)


def data_predicates(edges: DataFrame, rules: list[Rule]) -> frozenset[str]:
    """Of the predicates in rule bodies, those that the graph has data facts of: one scan of the data edges, a row per predicate."""
    names = {a.name for r in rules for a in (*r.body, *r.head) if a.relational}
    found = edges.where((F.col("rel_type") == HAS_VALUE) & F.col("dst").isin(*names)).select("dst").distinct().collect() if names else []
    return frozenset(r.dst for r in found)


def bindings(graph: Graph, rule: Rule, sources: list[Known | DataFrame], products: bool = False) -> DataFrame:
    """The bindings of a rule's body; ``sources`` has the facts that each atom of ``rule.ordered()`` reads."""
    rows, same = None, [(a.args[0][1:], a.args[1][1:]) for a in rule.body if a.kind == SAME and all(x.startswith("?") for x in a.args)]
    for atom, facts in zip(rule.ordered(), sources):
        rows = joined(rows, atom_rows(facts, atom), same, products)
    if rows is None:
        rows = graph.spark.range(1).select(F.lit(True).alias("__any"))
    for atom in rule.body:
        if atom.kind == QUERY:
            var = atom.args[0][1:]
            members = instances(graph, atom.name).withColumnRenamed("iri", var)
            rows = rows.join(members, var, "left_semi") if var in rows.columns else joined(rows, members, same, products)
    properties = sorted({a for atom in rule.body for a in atom.args if a.startswith("?") and "." in a and a[1:].partition(".")[0] in rows.columns})
    for p in properties:
        var, _, key = p[1:].partition(".")
        own = graph.props.where(F.col("key") == key).select(F.col("node_id").alias(var), F.coalesce(F.col("num").cast("string"), F.col("raw")).alias(p))
        rows = rows.join(own, var, "left")

    def value(arg: str) -> Column | None:
        """The column or constant of an argument; None for an unbound variable."""
        if not arg.startswith("?"):
            return F.lit(arg)
        if arg in properties:
            return F.col(f"`{arg}`")
        return F.col(f"`{arg[1:]}`") if arg[1:] in rows.columns else None

    for atom in rule.body:
        if atom.kind in (SAME, DIFFERENT):
            a, b = map(value, atom.args)
            if a is not None and b is not None:
                rows = rows.where(a == b if atom.kind == SAME else a != b)
        elif atom.kind == BUILTIN:
            args = [value(a) for a in atom.args]
            if all(a is not None for a in args):  # a call on an unbound variable is put off, and keeps the row
                rows = rows.where(holds(atom.name, args))
    return rows


def heads(rule: Rule, rows: DataFrame) -> list[DataFrame]:
    """Facts of each head atom that makes any, one per binding."""
    out = []
    for atom in rule.head:
        term = [F.col(f"`{a[1:]}`") if a.startswith("?") else F.lit(a) for a in atom.args]
        if atom.kind == CLASS:
            parts = F.lit(CLASS), term[0], F.lit(INSTANCE_OF), F.lit(atom.name)
        elif atom.kind in (RELATION, DATA, SAME, DIFFERENT):
            parts = F.lit(RELATION if atom.kind in (SAME, DIFFERENT) else atom.kind), term[0], F.lit(atom.name), term[1]
        else:
            continue
        out.append(rows.select(*(p.cast("string").alias(c) for p, c in zip(parts, FACT))))
    return out


def head_predicates(rules: list[Rule]) -> set[tuple[str, str]]:
    """(predicate, class) of the facts that rules can make; the class only for class facts."""
    return {(INSTANCE_OF, a.name) if a.kind == CLASS else (a.name, "") for r in rules for a in r.head if a.kind != BUILTIN}
