"""Hierarchies and graphs by iterated joins, for inputs beyond recursive SQL's limits.

Each step is one join and one aggregation over the frontier only, and is written
to the checkpoint folder, so plans stay short and a lost executor costs one step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import checkpointed


def shortest_paths(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(node, cost long): least sum of dist from any start over at most ``hops`` edges (src, dst, dist >= 0)."""
    best = starts.select("node", F.lit(0).cast("long").alias("cost"))
    frontier = best
    for _ in range(hops):  # each step's result is written, so plans don't grow with hops
        reached = frontier.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("cost") + F.col("dist")).alias("new"))
        frontier = checkpointed(reached.join(best, "node", "left").where(F.col("cost").isNull() | (F.col("new") < F.col("cost"))).select("node", F.col("new").alias("cost")))
        if frontier.isEmpty():
            break
        best = checkpointed(best.unionByName(frontier).groupBy("node").agg(F.min("cost").alias("cost")))
    return best


def levels(tree: DataFrame, separator: str = "/") -> DataFrame:
    """(id, parent, level, path): each row's distance from its root (rows without a parent) and the ids on the way to it.

    One join a level, over that level's rows only. Rows on a cycle, or below one
    or below a parent that is missing, hang from no root and have no row.
    """
    nodes = checkpointed(tree.select("id", "parent"))
    now = nodes.where("parent IS NULL").select("id", "parent", F.lit(0).alias("level"), F.col("id").cast("string").alias("path"))
    out = []
    while True:
        now = checkpointed(now)
        if now.isEmpty():
            break
        out.append(now)
        above = now.select(F.col("id").alias("parent"), F.col("level").alias("upper"), F.col("path").alias("way"))
        now = nodes.join(above, "parent").select("id", "parent", (F.col("upper") + 1).alias("level"), F.concat("way", F.lit(separator), F.col("id").cast("string")).alias("path"))
    return reduce(DataFrame.unionByName, out) if out else now


def rolled_up(tree: DataFrame) -> DataFrame:
    """(id, n, total): rows and summed amounts of each subtree of (id, parent, amount), from the leaves up.

    Sums travel one level a step and only where they changed, so each node
    sends its subtree's total once per level of the tree, not once per ancestor.
    A cycle raises ValueError.
    """
    nodes = checkpointed(tree)
    parents = nodes.select("id", "parent")
    most, steps = nodes.count(), 0
    total = nodes.select("id", F.lit(1).cast("long").alias("n"), F.col("amount").alias("total"))
    moving = total
    while True:
        moving = checkpointed(moving.join(parents, "id").where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
        if moving.isEmpty():
            return total.join(parents.select("id"), "id", "left_semi")
        steps += 1
        if steps > most:  # no path from a leaf up is longer than all nodes
            raise ValueError("the tree has a cycle")
        total = checkpointed(total.unionByName(moving).groupBy("id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")))
