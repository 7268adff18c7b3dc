"""Connected components of a link table, by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _roots(parents: DataFrame, rows: int) -> DataFrame:
    """(node, root) of a forest (node, up) whose parents are smaller than their children, by pointer jumping."""
    while True:
        further = parents.select(F.col("node").alias("up"), F.col("up").alias("_next"))
        jumped = staged(parents.join(further, "up", "left").select("node", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_moved")), rows)
        parents = jumped.select("node", "up")
        if not jumped.where("_moved").limit(1).count():
            return parents.withColumnRenamed("up", "root")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): component is the smallest node that can be reached.

    Each node hooks to the smallest node of its neighbourhood, a minimum that is combined before the shuffle; the trees
    that this makes are replaced by their roots, their smallest nodes, and so are the ends of the links. Links inside a
    tree are gone after one round, and at least half of the nodes that still have links, so rounds follow the logarithm
    of the nodes and links shrink fast. Joins are ones that AQE can split. Rounds are staged in the shared folder, so a
    lost executor costs one round.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    named = None
    while n := edges.count():
        # There are at most twice as many nodes with links as links.
        n *= 2
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), n)
        # Every node but the local minima hangs on a smaller one.
        roots = _roots(least.where("up < node"), n)
        tree = staged(least.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), n)
        moved = edges.join(tree.select(F.col("node").alias("a"), F.col("root").alias("_a")), "a").join(tree.select(F.col("node").alias("b"), F.col("root").alias("_b")), "b")
        edges = staged(moved.where("_a <> _b").select(F.greatest("_a", "_b").alias("a"), F.least("_a", "_b").alias("b")).distinct(), n)
        if named is None:
            named, total = tree.select("node", F.col("root").alias("component")), n
        else:
            up = tree.select(F.col("node").alias("component"), F.col("root").alias("_root"))
            named = staged(named.join(up, "component", "left").select("node", F.coalesce("_root", "component").alias("component")), total)
    return links.sparkSession.createDataFrame([], "node long, component long") if named is None else named
