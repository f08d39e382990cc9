"""Connected components of links, by contraction in rounds of DataFrame joins over written tables.

In each round every node picks one of its links, the one of least weight, where weights are hashes that are new in each round. Nodes with
their picks are trees, but for pairs of nodes that picked the same link, of which the smaller node is the root. Pointers to roots are tripled, each tree becomes a node of
the next round, and links within trees go. A tree has at least two nodes, so a round at least halves the nodes that have links left, whatever their order: n
nodes take at most log2 n rounds, and fresh random weights keep trees shallow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written, written_any


def picks(links: DataFrame, number: int) -> DataFrame:
    """Rows (node, up): for each end of ``links`` (a, b) the other end of its link of least weight."""
    ends = links.select(F.xxhash64("a", "b", F.lit(number)).alias("w"), F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.col("a").alias("up")))).alias("e"))
    # hashes may be equal by chance; the ends of the link then order it, alike for both of them
    least = F.min(F.struct("w", F.least("e.node", "e.up").alias("a"), F.greatest("e.node", "e.up").alias("b"), F.col("e.up").alias("up")))
    return ends.groupBy("e.node").agg(least["up"].alias("up"))


def rooted(tree: DataFrame) -> tuple[DataFrame, int]:
    """Rows (node, root) of picks, as a written table, and how many steps it took, each of which triples the pointers."""
    back = tree.select(F.col("node").alias("up"), F.col("up").alias("back"))
    tree = written(tree.join(back, "up").select("node", F.when((F.col("back") == F.col("node")) & (F.col("node") < F.col("up")), F.col("node")).otherwise(F.col("up")).alias("root")), "tree")
    steps, moved = 0, True
    while moved:
        up, top = tree.toDF("root", "above"), tree.toDF("above", "top")
        tree, moved = written_any(tree.join(up, "root").join(top, "above").select("node", F.col("top").alias("root"), (F.col("top") != F.col("above")).alias("moved")), "tree", F.col("moved"))
        tree = tree.drop("moved")
        steps += 1
    return tree, steps


def contracted(links: DataFrame) -> tuple[list[DataFrame], int]:
    """A table (node, root) per round, and the steps of all rounds."""
    distinct = lambda a, b: links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    links, more = written_any(distinct("child", "parent"), "links")
    rounds, steps = [], 0
    while more:
        # every join reads written tables, one of which has a row per key, so that adaptive execution can split the rows of a hub
        tree, taken = rooted(written(picks(links, len(rounds)), "picks"))
        rounds.append(tree)
        steps += taken
        for end in "ab":
            links = links.join(tree.select(F.col("node").alias(end), F.col("root").alias(f"new_{end}")), end)
        links, more = written_any(distinct("new_a", "new_b"), "links")
    return rounds, steps


def roots(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (child, parent) that is not its component's smallest node, the root, itself. Nodes are not null."""
    rounds, _ = contracted(links)
    if not rounds:
        return links.select(F.col("child").alias("node"), F.col("parent").alias("root")).where(F.lit(False))
    final = rounds.pop()
    while rounds:  # a node of an earlier round has the root that its tree has later
        later = final.select(F.col("node").alias("root"), F.col("root").alias("last"))
        final = written(rounds.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root")), "forest")
    least = written(final.groupBy("root").agg(F.min("node").alias("least")), "least")
    return final.join(least, "root").where("node <> least").select("node", F.col("least").alias("root"))
