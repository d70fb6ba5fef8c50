"""Connected components of a graph of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modlytics.session import shared_dir


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) between longs -> (node, root): one root per component, for every node of a link.

    In a round each node takes the least hashed node among itself and its neighbours as its parent,
    and the links are drawn anew between parents. Nodes are hashed anew each round, so a long chain
    shrinks by a constant factor as any other shape. Neighbours are reduced to minima before they are
    shuffled, so a hub sends one row per task. The rounds end when no link is left.
    """
    shared_dir(links.sparkSession)
    left = links.filter("a <> b").select("a", "b").distinct().checkpoint()
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        order = lambda node, n=len(rounds): F.struct(F.xxhash64(F.lit(n), node).alias("h"), node.alias("node"))
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(order(F.col("b"))).alias("near"))
        parent = least.select(F.col("a").alias("node"), F.least("near", order(F.col("a")))["node"].alias("parent")).checkpoint()
        a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        drawn = left.join(a, "a").join(b, "b").filter("pa <> pb")
        left = drawn.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct().checkpoint()
        rounds.append(parent)
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("parent").alias("root"))
    for parent in reversed(rounds[:-1]):
        up = roots.select(F.col("node").alias("parent"), "root")
        roots = parent.join(up, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots
