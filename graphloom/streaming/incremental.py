"""Streams of edges: patterns and rules evaluated as edges arrive, and windowed counts with late data bounded by a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.compile import base_facts
from ..plans.fixpoint import run, with_facts
from ..plans.rules import Rule
from ..sources.graph import EDGES, Graph, full
from ..sources.work import work_dir, written


def event_edges(events: DataFrame) -> DataFrame:
    """Events (user_id, event_type, ts) as edges from users to types; ``ts`` becomes a timestamp, as watermarks need one."""
    return events.select(F.concat(F.lit("user:"), F.col("user_id").cast("string")).alias("src"), F.lit("did").alias("rel_type"), F.concat(F.lit("type:"), "event_type").alias("dst"), F.col("ts").cast("timestamp").alias("ts"))


def relation_counts(edges: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts of edges per relation type, target and window, over a stream or a batch."""
    return edges.withWatermark("ts", late).groupBy(F.window("ts", window), "rel_type", "dst").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "rel_type", "dst", "n")


class RuleStream:
    """Rules over a graph that grows by micro-batches: a ``foreachBatch`` handler.

    The rules have run to their fixpoint over ``graph`` and all earlier batches, so a batch is evaluated semi-naively with its edges as the first delta. Its new
    facts go to ``sink`` with the batch's number, then its edges and facts are written under that number to ``state``, a folder that all executors share. A handler that starts anew
    with the same folder goes on behind the last number there, and leaves out batches that come again.
    """

    def __init__(self, graph: Graph, rules: list[Rule], sink: Callable[[DataFrame, int], None], max_iterations: int = 100, state: str | None = None):
        self.base, self.rules, self.sink, self.max_iterations = graph, rules, sink, max_iterations
        self.state = state or f"{work_dir(graph.spark)}/rule-stream-{uuid.uuid4().hex}"
        self.last = self.stored().agg(F.max("batch")).first()[0]
        self.last = -1 if self.last is None else self.last

    def stored(self) -> DataFrame:
        """Edges and facts of the batches so far, with their numbers."""
        spark, schema = self.base.spark, f"{EDGES}, batch long"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.state)
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.state)

    @property
    def graph(self) -> Graph:
        """The graph with all batches that are done: one table beside the given one, however many there were."""
        return self.base.with_(edges=self.base.edges.unionByName(self.stored().where(F.col("batch") <= self.last).drop("batch")))

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        new = written(full(batch, EDGES), "arrived")
        grown = self.graph.with_(edges=self.graph.edges.unionByName(new))
        outcome = run(grown, self.rules, self.max_iterations, 0.0, start=delta_facts(grown, new))
        made = new
        if outcome.derived:
            self.sink(outcome.facts, number)
            made = with_facts(grown.with_(edges=new), outcome.facts).edges
        # a part of a number that a failure left behind is replaced
        made.write.mode("overwrite").parquet(f"{self.state}/batch={number}")
        self.last = number


def delta_facts(graph: Graph, edges: DataFrame) -> DataFrame:
    """The facts of arriving edges, for callers with loops of their own."""
    return base_facts(graph.with_(edges=edges))
