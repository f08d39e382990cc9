"""Rules to a fixpoint, semi-naively: after the first round a rule is evaluated only with one of its atoms on the last round's new facts.

A rule that a predicate is transitive meets all known facts once for each way between two nodes; such rules are evaluated from the farthest facts (closure.py), with the same facts
in the same rounds.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph
from ..sources.work import written
from ..vocab import HAS_VALUE, INSTANCE_OF
from .closure import Closure, Leap, closed
from .compile import FACT, Known, bindings, data_predicates, head_predicates, heads
from .confidence import Gate, Mode, rule_score
from .rules import CLASS, DATA, RELATION, Rule

FACTS = "kind string, subject string, predicate string, object string, rule string, confidence double, iter int"


#: Beyond so many bindings a rule's score is the same.
MANY = 10


class State(Enum):
    RUNNING = "running"
    CONVERGED = "converged"
    MAX_ITERATIONS = "max iterations reached"
    FUSE_TRIPPED = "fuse tripped"


@dataclass
class Outcome:
    """Derived facts (FACTS) and what the run was like."""

    facts: DataFrame
    state: State
    rounds: int
    derived: int
    gate: Gate
    seconds: float
    per_rule: dict[str, int] = field(default_factory=dict)

    @property
    def stats(self) -> dict:
        return {"steps": self.rounds, "total_derived": self.derived, "trips": len(self.gate.trips), "elapsed_ms": int(self.seconds * 1000)}


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _stamped(found: DataFrame, predicate: str, rule: Rule, confidence: Column, iter_: Column) -> DataFrame:
    """Facts (FACTS) of a transitive rule from (subject, object)."""
    return found.select(F.lit(RELATION).alias("kind"), "subject", F.lit(predicate).alias("predicate"), "object", F.lit(rule.name).alias("rule"), confidence.alias("confidence"), iter_.alias("iter"))


def run(graph: Graph, rules: list[Rule], max_iterations: int = 100, threshold: float = Mode.BALANCED.value, version: str | None = None, on_round: Callable[[DataFrame], None] | None = None, start: DataFrame | None = None, products: bool = False) -> Outcome:
    """Evaluate rules until no round makes a fact that is neither in the graph nor derived before.

    With ``start``, facts (FACT) that the graph has got since its rules ran to their fixpoint, the first round too looks only at what these make.

    Each rule's results of a round pass the gate together or not at all. Rounds are written tables, so lineage stays short and a lost executor costs a stage.
    ``on_round`` gets each round's new facts; its first error stops the run.
    """
    began, gate = time.time(), Gate(threshold)
    spark, scope = graph.spark, graph.of_version(version)
    makes = head_predicates(rules)
    parts: list[DataFrame] = []
    results: list[DataFrame] = []
    passes: dict[int, list[tuple[int, float]]] = {}  # rounds and scores of facts found by lists
    delta, data = start, data_predicates(scope.edges, rules)
    leaping, closures = {} if start is not None else closed(rules, Known(scope.edges, data=data)), {}

    def candidates_of(k: int, known: Known) -> list[DataFrame]:
        rule = rules[k]
        atoms = rule.ordered()
        if delta is None:
            variants = [[known] * len(atoms)]
        else:
            moving = [i for i, a in enumerate(atoms) if delta is start or ((INSTANCE_OF, a.name) if a.kind == CLASS else (a.name, "")) in makes]
            variants = [[delta if i == j else known for j in range(len(atoms))] for i in moving]
        out = []
        for sources in variants:
            rows = bindings(scope, rule, sources, products)
            out += [made.withColumns({"rule_no": F.lit(k), "head_no": F.lit(h)}) for h, made in enumerate(heads(rule, rows))]
        return out

    state, rounds, derived, per_rule = State.RUNNING, 0, 0, dict.fromkeys((r.name for r in rules), 0)
    while state is State.RUNNING:
        if rounds >= max_iterations:
            state = State.MAX_ITERATIONS
            break
        rounds += 1
        known = Known(scope.edges, parts, data)
        candidates = [c for k in range(len(rules)) if k not in closures for c in candidates_of(k, known)]
        if not candidates and not closures:
            state = State.CONVERGED
            break
        counts = {}
        if candidates:
            found = written(_union(candidates).groupBy("rule_no", "head_no", *FACT).agg(F.count(F.lit(1)).alias("n")), "candidates")
            counts = {r.rule_no: r.n for r in found.where("head_no = 0").groupBy("rule_no").agg(F.sum("n").alias("n")).collect()}  # a row per rule
        leaps: dict[int, Leap] = {k: c.leap() for k, c in closures.items()}
        for k, leap in leaps.items():
            n, alone = leap.bindings, len(leaps) == 1 and not candidates
            # the score depends on all bindings, of which a leap joins some; without new facts it decides nothing but whether the gate trips
            if n < MANY and (leap.rows or not alone or rule_score(len(rules[k].body_variables), len(rules[k].body), MANY) < threshold):
                n = _union(candidates_of(k, known)).limit(MANY).count()
            if n:
                counts[k] = n
        scores = {k: rule_score(len(rules[k].body_variables), len(rules[k].body), n) for k, n in counts.items()}
        passed = [k for k, s in scores.items() if gate.check(s, rules[k].name)]
        if not passed:
            state = State.FUSE_TRIPPED if len(gate.trips) and counts else State.CONVERGED
            break
        news, made = [], {}
        if plain := [k for k in passed if k not in leaps]:
            scored = F.create_map(*(F.lit(x) for k in plain for x in (k, scores[k])))
            names = F.create_map(*(F.lit(x) for k in plain for x in (k, rules[k].name)))
            first = found.where(F.col("rule_no").isin(*plain)).groupBy(*FACT).agg(F.min("rule_no").alias("rule_no"))
            # new facts are compared with those that the rules can make, and with no others
            others = head_predicates([r for k, r in enumerate(rules) if k not in leaps])
            new = first.join(_union([known.of(*m) for m in sorted(others)]), list(FACT), "left_anti")
            new = written(new.select(*FACT, names[F.col("rule_no")].alias("rule"), scored[F.col("rule_no")].alias("confidence"), F.lit(rounds).alias("iter")), "facts")
            made = {r.rule: r.n for r in new.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
            if made:
                news.append(new)
                results.append(new)
        for k, leap in leaps.items():
            closures[k].take(leap if k in passed else None)
            if k in passed and leap.rows:
                news.append(_stamped(leap.new, leaping[k], rules[k], F.lit(scores[k]), F.lit(rounds)))
                made[rules[k].name] = made.get(rules[k].name, 0) + leap.rows
                if leap.ways is None:
                    results.append(news[-1])
                else:
                    passes.setdefault(k, []).append((rounds, scores[k]))
        if not made:
            state = State.CONVERGED
            break
        new = _union(news)
        if delta is None:
            closures = {k: Closure.begin(name, known, new) for k, name in leaping.items()}
        derived += sum(made.values())
        for name, n in made.items():
            per_rule[name] = per_rule.get(name, 0) + n
        parts.append(new)
        delta = new.select(*FACT)
        if on_round:
            on_round(new)
    for k, found_in in passes.items():
        # a round found the facts of up to twice as many steps as those before
        of_steps = lambda values: F.coalesce(*(F.when(F.col("steps") <= 2 ** (i + 1), F.lit(v)) for i, v in enumerate(values)))
        listed = closures[k].listed_facts(of_steps([r for r, _ in found_in]), of_steps([s for _, s in found_in]))
        results.append(_stamped(listed, leaping[k], rules[k], F.col("confidence"), F.col("iter")))
    facts = _union(results) if results else spark.createDataFrame([], FACTS)
    return Outcome(facts, state, rounds, derived, gate, time.time() - began, per_rule)


def with_facts(graph: Graph, facts: DataFrame, version: str | None = None) -> Graph:
    """The graph with derived facts as edges, stamped with a version where one is given."""
    data = F.col("kind") == DATA
    edges = facts.select(
        F.col("subject").alias("src"), F.when(data, HAS_VALUE).otherwise(F.col("predicate")).alias("rel_type"), F.when(data, F.col("predicate")).otherwise(F.col("object")).alias("dst"),
        F.lit("inference").alias("action_type"), F.lit(version).cast("string").alias("version"), F.when(data, F.col("object")).alias("value"),
        F.when(data, "string").alias("value_kind"), F.lit(None).cast("string").alias("func"), F.lit(None).cast("string").alias("target_id"),
    )
    return graph.with_(edges=graph.edges.unionByName(edges))


def derive_once(graph: Graph, rule: Rule, version: str | None = None, products: bool = False) -> DataFrame:
    """The facts of one rule over the graph, as one lazy plan without dedup against known facts: (kind, subject, predicate, object)."""
    scope = graph.of_version(version)
    known = Known(scope.edges, data=data_predicates(scope.edges, [rule]))
    return _union(heads(rule, bindings(scope, rule, [known] * len(rule.ordered()), products))).distinct()
