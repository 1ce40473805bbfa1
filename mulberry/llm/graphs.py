"""Connected components and pointer chains by joins; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mulberry.session import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of the component) for every node of ``edges`` (a, b).

    Alternating stars: each round links every node's neighbours to the smallest of them (first the larger
    neighbours, then the smaller ones). Minima are pre-aggregated, so a node with a third of all edges is no
    hot group. Self-links and repeated links are allowed. Rounds grow as the logarithm of the longest path.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    total = _sum(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        now = checkpointed(small)
        after = _sum(now)
        if after == total:
            break
        total = after
    return nodes.join(now.groupBy("u").agg(F.min("v").alias("root")), F.col("node") == F.col("u"), "left").select("node", F.coalesce("root", "node").alias("root"))


def _sum(edges: DataFrame) -> tuple:
    """A fingerprint of a set of edges: count and two sums of hashes, order aside."""
    h = lambda seed: F.sum(F.xxhash64("u", "v", F.lit(seed)).cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), h(1), h(2)).first())


def chain_ends(pointers: DataFrame) -> DataFrame:
    """``node``, ``root``: the end of each node's chain of pointers (node, next); in a loop, and for what leads
    into one, the smallest node of the loop.

    Pointers double their reach each round. A pointer that reached a node without a pointer is done; the rest are
    joined again. Once the set of nodes that are pointed at stops shrinking while no pointer gets done, every one
    of them lies on a loop, and a last round of doubling has passed all of it. ``node`` must be unique.
    """
    heads = pointers.select(F.col("node").alias("head"))
    first = pointers.join(heads, F.col("next") == F.col("head"), "left").select("node", "next", F.col("head").isNull().alias("done"), F.col("next").alias("low"))
    now = checkpointed(first)
    finished = now.where("done").select("node", F.col("next").alias("root"))
    open_ = now.where("not done").select("node", "next", "low")
    seen = None
    while True:
        state = open_.agg(F.count(F.lit(1)), F.count_distinct("next"), F.sum(F.xxhash64("node", "low").cast("decimal(38,0)"))).first()
        if state[0] == 0:
            return finished
        if state == seen:
            break
        seen = state
        # the reach of a node: itself through the node before ``next``; ``low`` is the smallest node of that reach, next included
        ahead = now.select(F.col("node").alias("n2"), F.col("next").alias("next2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        now = checkpointed(open_.join(ahead, F.col("next") == F.col("n2")).select("node", F.col("next2").alias("next"), F.least("low", "low2").alias("low"), F.col("done2").alias("done")).unionByName(now.where("done").select("node", "next", "low", "done")))
        finished = now.where("done").select("node", F.col("next").alias("root"))
        open_ = now.where("not done").select("node", "next", "low")
    # ``next`` of every open node lies on its loop, and low of a node on the loop is the smallest of the loop
    ring = now.where("not done").select(F.col("node").alias("n2"), F.col("low").alias("root"))
    return finished.unionByName(open_.join(ring, F.col("next") == F.col("n2")).select("node", "root"))
