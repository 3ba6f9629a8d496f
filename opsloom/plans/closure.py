"""Graph closures and tree sums by repeated frontier joins."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsloom.plans.storage import cut_lineage


def reach(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Nodes reached from each start, with the shortest depth; all of them, unless the caller names a depth.

    ``edges`` has (src, dst), ``starts`` has (start).  Columns: start, node,
    depth.  Only new pairs travel to the next round, so cycles end by themselves.
    Edges and frontiers are kept as written tables, so no round repeats another.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    frontier = cut_lineage(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct())
    known = frontier
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = (
            frontier.join(links, frontier["node"] == links["src"])
            .select("start", F.col("dst").alias("node"), F.lit(depth).alias("depth"))
            .distinct()
        )
        frontier = step.join(known.select("start", "node"), ["start", "node"], "left_anti")
        frontier = cut_lineage(frontier)
        if frontier.isEmpty():
            break
        known = known.unionByName(frontier)
    return known


def has_cycle(links: DataFrame) -> bool:
    """Whether following (node, parent) from some node never ends.

    Every round doubles the step of all nodes, so a tree is done after the logarithm
    of its depth, and what still has an ancestor after more steps than there are links is on or below a cycle.
    """
    jump, steps, most = links, 1, links.count()
    while not jump.isEmpty():
        if steps > most:
            return True
        above = jump.select(F.col("node").alias("parent"), F.col("parent").alias("_next"))
        jump = cut_lineage(jump.join(above, "parent").select("node", F.col("_next").alias("parent")).distinct())
        steps *= 2
    return False


def sum_up_tree(values: DataFrame, tree: DataFrame, measures: list[str]) -> DataFrame:
    """Own value plus that of all descendants per node, at any depth.

    ``values`` has (node, measures), ``tree`` has (node, parent).  Each round
    moves sums one level up and adds them per parent first, so a node with many
    children costs partial sums only.  A cycle is an error.
    """
    links = cut_lineage(tree.where(F.col("parent").isNotNull()).select("node", "parent").distinct())
    if has_cycle(links):
        raise ValueError("the tree has a cycle")
    level = values.groupBy("node").agg(*[F.sum(m).alias(m) for m in measures])
    total = level
    while True:
        level = (
            level.join(links, "node")
            .groupBy(F.col("parent").alias("node"))
            .agg(*[F.sum(m).alias(m) for m in measures])
        )
        level = cut_lineage(level)
        if level.isEmpty():
            break
        total = total.unionByName(level)
    return total.groupBy("node").agg(*[F.sum(m).alias(m) for m in measures])
