"""Transitive rules: ``p(x,y) ^ p(y,z) -> p(x,z)`` in the rounds of the fixpoint, with one way to each new fact where all others only repeat it.

After a round all facts up to some number of steps are known, and the next round makes those of up to twice as many. Each of these has a way that begins with a fact of
exactly that number, the farthest known, so that only these are joined with the known facts, and not all facts of the last round from both sides.

Where no subject has two objects, or no object two subjects, all nodes that one leads to lie on one way. Its row then has them as a list in their order, and a round joins a list
with that of its last node; it becomes pairs again when it gets long, or when a way leads back to where it began.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.work import written
from .compile import Known, head_predicates
from .rules import RELATION, Rule

#: Lists of more nodes are not made.
LONGEST = 1024

#: Farthest facts up to this counted number are broadcast, as most known facts then meet none of them.
FEW = 200_000


def transitive(rule: Rule) -> str | None:
    """The predicate of a rule that says that it is transitive, and nothing else; None for any other rule."""
    if len(rule.body) != 2 or len(rule.head) != 1 or any(a.kind != RELATION for a in (*rule.body, *rule.head)) or len({a.name for a in (*rule.body, *rule.head)}) != 1:
        return None
    if any(not x.startswith("?") or "." in x for a in (*rule.body, *rule.head) for x in a.args):
        return None
    x, z = rule.head[0].args
    for first, second in (rule.body, rule.body[::-1]):
        y = first.args[1]
        if first.args == (x, y) and second.args == (y, z) and len({x, y, z}) == 3:
            return rule.head[0].name
    return None


def closed(rules: list[Rule], known: Known) -> dict[int, str]:
    """The rules that can be evaluated from the farthest facts, with their predicates: all other facts of the predicate are there before the rule is first evaluated, or all come in the first round."""
    makes, found = head_predicates(rules), {}
    for k, rule in enumerate(rules):
        name = transitive(rule)
        if name is None or known.data is None or name in known.data:
            continue
        others = [r for i, r in enumerate(rules) if i != k and any(a.name == name for a in r.head)]
        if any(a.kind != RELATION for r in others for a in r.head if a.name == name) or any(m in makes for r in others for m in _reads(r)):
            continue
        if not others or known.edges.where(F.col("rel_type") == name).isEmpty():
            found[k] = name
    return found


def _reads(rule: Rule) -> set[tuple[str, str]]:
    return head_predicates([Rule("", (), tuple(a for a in rule.body if a.relational))])


def pairs(facts: DataFrame) -> DataFrame:
    return facts.select("subject", "object")


@dataclass
class Leap:
    """What a round finds: bindings joined, and new facts (subject, object, far) with their rows. ``ways`` is the written table of lists that has them, if any."""

    bindings: int = 0
    new: DataFrame | None = None
    rows: int = 0
    far: int = 0
    ways: DataFrame | None = None


def _counted(df: DataFrame, **what: Column) -> tuple[DataFrame, dict[str, int]]:
    """``df`` written and read back, and what its write observed."""
    seen = Observation()
    table = written(df.observe(seen, *(c.alias(k) for k, c in what.items())), "leap")
    return table, {k: seen.get.get(k) or 0 for k in what}


@dataclass
class Closure:
    """The facts of a transitive predicate between rounds.

    ``last`` are those of the last round (subject, object, far), of which ``far`` many are the farthest; ``older`` the others. As long as ways are lists, ``ways`` are tables of them
    (node, way, tip): each round's grows those of the last whose ``tip``, their end, may lead on, and the others stay where they are. ``back``: ways go from objects to subjects.
    """

    older: list[DataFrame]
    last: DataFrame | None
    far: int
    ways: list[DataFrame] = field(default_factory=list)
    back: bool = False
    listed: bool = False
    steps: int = 1

    @classmethod
    def begin(cls, name: str, known: Known, new: DataFrame) -> Closure:
        """After the first round, whose new facts are all as far as any."""
        own = known.edges.where(F.col("rel_type") == name).select(F.col("src").alias("subject"), F.col("dst").alias("object"))
        new = pairs(new.where(F.col("predicate") == name))
        rows, loops = new.agg(F.count(F.lit(1)), F.count_if(F.col("subject") == F.col("object"))).first()
        out = cls([own], new.withColumn("far", F.lit(True)), rows)
        once = lambda key: new.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
        if rows and not loops and own.isEmpty():
            ends = ("subject", "object") if once("subject") else ("object", "subject") if once("object") else None
            if ends:
                out.back, out.listed = ends[0] == "object", True
                out.ways = [new.select(F.col(ends[0]).alias("node"), F.array(ends[1]).alias("way"), F.col(ends[1]).alias("tip"))]
        return out

    def leap(self) -> Leap:
        """The next round's facts."""
        if not self.far:
            return Leap()
        if self.listed and 2 * self.steps <= LONGEST:
            leap = self._along()
            if leap:
                return leap
        self.listed = False
        start = self.last.where("far").select(F.col("subject").alias("a"), F.col("object").alias("b"))
        known = self.last
        for facts in self.older:
            known = known.unionByName(facts.withColumn("far", F.lit(False)))
        rows = (F.broadcast(start) if self.far <= FEW else start).join(known.withColumnsRenamed({"subject": "b", "object": "c"}), "b").select(F.col("a").alias("subject"), F.col("c").alias("object"), "far")
        # a new fact is among the farthest if none of its ways is shorter
        found, all_ = _counted(rows.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n"), F.bool_and("far").alias("far")), n=F.sum("n"))
        new, seen = _counted(found.drop("n").join(pairs(known), ["subject", "object"], "left_anti"), n=F.count(F.lit(1)), far=F.count_if("far"))
        return Leap(all_["n"], new, seen["n"], seen["far"])

    def _along(self) -> Leap | None:
        """The next round's facts by lists; None if a way leads back to where it began, and lists may repeat nodes."""
        start = self.ways[-1].where("tip IS NOT NULL").withColumnRenamed("way", "first")
        end = self.ways[-1].select(F.col("node").alias("tip"), "way", F.col("tip").alias("then"))
        for table in self.ways[:-1]:
            end = end.unionByName(table.where("tip IS NULL").select(F.col("node").alias("tip"), "way", F.col("tip").alias("then")))
        # each tip has one row at most in ``end``; a list without one stays as it is
        if self.far <= FEW:
            end = end.join(F.broadcast(start.select("tip")), "tip", "left_semi")
        rows = start.join(end, "tip", "left")
        more = F.size("way")
        grown, seen = _counted(
            rows.select("node", F.when(F.col("way").isNull(), F.col("first")).otherwise(F.concat("first", "way")).alias("way"), F.col("then").alias("tip"), F.coalesce(F.when(more > 0, more), F.lit(0)).alias("more"), F.coalesce(F.array_contains("way", F.col("node")), F.lit(False)).alias("back")),
            n=F.sum("more"), far=F.count("tip"), loops=F.count_if("back"),
        )
        if seen["loops"]:
            return None
        ways = grown.select("node", "way", "tip")
        new = ways.select("node", F.explode(F.slice("way", self.steps + 1, LONGEST)).alias("end"), (F.col("tip").isNotNull()).alias("full"), "tip")
        new = self._facts(new, (F.col("full") & (F.col("end") == F.col("tip"))).alias("far"))
        return Leap(seen["n"], new, seen["n"], seen["far"], ways)

    def _facts(self, ends: DataFrame, *more: Column) -> DataFrame:
        subject, object_ = ("end", "node") if self.back else ("node", "end")
        return ends.select(F.col(subject).alias("subject"), F.col(object_).alias("object"), *more)

    def take(self, leap: Leap | None) -> None:
        """Go on to the next round, with what this one found or, where its facts don't count, without."""
        if leap and leap.ways is not None:
            self.ways.append(leap.ways)
            self.steps *= 2
        if self.last is not None:
            self.older.append(pairs(self.last))
        self.last, self.far = (leap.new, leap.far) if leap and leap.new is not None else (None, 0)

    def listed_facts(self, iter_: Column, confidence: Column) -> DataFrame | None:
        """All facts that rounds found by lists, read once: (subject, object, confidence, iter), by columns over ``steps``, how many steps a fact takes."""
        if len(self.ways) < 2:
            return None
        all_ = self.ways[-1]
        for table in self.ways[1:-1]:
            all_ = all_.unionByName(table.where("tip IS NULL"))
        ends = all_.select("node", F.posexplode(F.slice("way", 2, LONGEST)).alias("at", "end")).withColumn("steps", F.col("at") + 2)
        return self._facts(ends, confidence.alias("confidence"), iter_.alias("iter"))
