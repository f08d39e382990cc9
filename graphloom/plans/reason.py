"""The inference pipeline over nodes, and a facade over all engines."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import behavior, classes, shapes, traverse, versions
from ..operators.behavior import passes
from ..sources.graph import Graph
from ..sources.work import written, written_any
from .confidence import Mode
from .fixpoint import Outcome, run, with_facts
from .rules import Parser, Rule


@dataclass
class Report:
    """The graph after an inference over nodes, and its steps (start, node_id, hop, confidence, state)."""

    graph: Graph
    steps: DataFrame
    source: Graph
    seeds: DataFrame

    @property
    def inherited(self) -> DataFrame:
        """How many properties the seeds and what lies downstream inherit: (node_id, n). Found when asked for, and from these nodes only."""
        below = traverse.inference_closure(self.source, self.seeds).select("node_id")
        return traverse.inherited_props(self.source, of=self.seeds.select("node_id").unionByName(below)).where("depth > 0").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))

    @property
    def states(self) -> DataFrame:
        """Steps per hop and state: why branches end."""
        return self.steps.groupBy("hop", "state").agg(F.count(F.lit(1)).alias("n"))


def reason_on_nodes(graph: Graph, seeds: DataFrame, version: str | None = None, confidence: float = 0.8, threshold: float = Mode.BALANCED.value, max_hops: int | None = None) -> Report:
    """Copy the seeds (column node_id), the types above them and what lies downstream into a version; then follow inference edges from the seeds.

    Each step multiplies the confidence by the node's own, where it has one. A node below the threshold, or whose precondition does not
    pass, is reported with state low_confidence or precondition, and its branch ends there. A ``max_hops`` that leaves nodes unreached is an error.
    """
    if version is not None:
        above = traverse.ontology_closure(graph, seeds, max_hops).select("node_id")
        below = traverse.inference_closure(graph, seeds, max_hops).select("node_id")
        grown, mapping = versions.copy_nodes(graph, version, above.unionByName(below).distinct())
        mapping = written(mapping, "copies")
        grown = grown.with_(edges=grown.edges.unionByName(versions.copy_edges(graph, mapping, version)))
    else:
        grown = graph
    own = graph.nodes.where("confidence IS NOT NULL").select("node_id", F.col("confidence").alias("own"))
    texts = graph.props.where("key = 'hasPrecondition'").select("node_id", F.col("raw").alias("precondition"))
    keys = behavior.graph_keys(graph)
    edges = graph.edges.where("action_type = 'inference'").select("src", "dst")
    frontier = seeds.select(F.col("node_id").alias("start"), "node_id", F.lit(float(confidence)).alias("confidence")).distinct()
    out, visited = [], None
    for hop in traverse.hops(0, max_hops):
        scored = frontier.join(own, "node_id", "left").withColumn("confidence", F.col("confidence") * F.coalesce("own", F.lit(1.0))).drop("own")
        judged = passes(graph, scored.join(texts, "node_id", "left"), keys=keys)
        state = F.when(F.col("confidence") < threshold, "low_confidence").when(~F.col("passes"), "precondition").otherwise("ok")
        level, more = written_any(judged.select("start", "node_id", F.lit(hop).alias("hop"), "confidence", state.alias("state")), "steps")
        if not more:
            break
        if max_hops is not None and hop > max_hops:
            raise RuntimeError(f"more steps lie beyond max_hops={max_hops}")
        out.append(level)
        visited = level.select("start", "node_id") if visited is None else visited.unionByName(level.select("start", "node_id"))
        ahead = level.where("state = 'ok'").select("start", F.col("node_id").alias("src"), "confidence").join(edges, "src")
        frontier = ahead.groupBy("start", F.col("dst").alias("node_id")).agg(F.max("confidence").alias("confidence")).join(visited, ["start", "node_id"], "left_anti")
    steps = level if not out else out[0]
    for later in out[1:]:
        steps = steps.unionByName(later)
    return Report(grown, steps, graph, seeds)


def narrated(steps: DataFrame) -> DataFrame:
    """Steps with a line of text each, for an event sink."""
    return steps.withColumn("line", F.format_string("[%d] %s confidence %.4f %s", "hop", "node_id", "confidence", "state"))


@dataclass
class Reasoner:
    """Rules, queries, shapes and behaviours over one graph. Reasoning adds its facts to ``graph``."""

    graph: Graph
    max_iterations: int = 100
    mode: Mode = Mode.BALANCED
    threshold: float | None = None
    parser: Parser = field(default_factory=Parser)
    rules: list[Rule] = field(default_factory=list)
    shapes: shapes.Shapes = field(default_factory=shapes.Shapes)

    def load_rules(self, text: str) -> list[Rule]:
        new = self.parser.parse_all(text)
        self.rules += new
        return new

    def list_rules(self) -> list[dict]:
        return [{"name": r.name, "body_atoms": len(r.body), "head_atoms": len(r.head)} for r in self.rules]

    def switch_mode(self, mode: str | Mode) -> None:
        self.mode = mode if isinstance(mode, Mode) else Mode.of(mode)

    def reason(self, version: str | None = None) -> Outcome:
        limit = self.mode.value if self.threshold is None else self.threshold
        outcome = run(self.graph, self.rules, self.max_iterations, limit, version)
        self.graph = with_facts(self.graph, outcome.facts, version)
        return outcome

    def query(self, expression: classes.Expr | str, version: str | None = None) -> DataFrame:
        return classes.instances(self.graph, expression, version)

    def is_subclass(self, lower: classes.Expr | str, upper: classes.Expr | str) -> bool:
        return classes.subsumes(self.graph, upper, lower).first().holds

    def is_instance(self, iri: str, expression: classes.Expr | str) -> bool:
        return classes.is_instance(self.graph, iri, expression).first().holds

    def validate(self, version: str | None = None) -> DataFrame:
        return shapes.validate(self.graph, self.shapes, version)

    def behaviors(self) -> DataFrame:
        return behavior.batch(self.graph)

    def execute_behaviors(self, write: bool = False) -> tuple[DataFrame, Outcome | None]:
        """The behaviours that pass, and the outcome of the rules in their effects; facts are added to the graph if asked."""
        ready = behavior.effects(behavior.batch(self.graph).where("passes"))
        texts = [r.effect_body for r in ready.where("action = 'run_rule'").select("effect_body").distinct().collect()]
        rules = []
        for t in texts:
            try:
                rules.append(self.parser.parse(t if t.strip().startswith("[") else f"[{t}]"))
            except Exception:  # an effect that is no rule is only logged
                continue
        outcome = run(self.graph, rules, 1, 0.0) if rules else None
        if write and outcome:
            self.graph = with_facts(self.graph, outcome.facts)
        return ready, outcome

    def on_nodes(self, node_ids: list[str], version: str | None = None, confidence: float = 0.8) -> Report:
        seeds = self.graph.spark.createDataFrame([(n,) for n in node_ids], "node_id string")
        return reason_on_nodes(self.graph, seeds, version, confidence, self.mode.value if self.threshold is None else self.threshold)
