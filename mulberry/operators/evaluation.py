"""Retrieval evaluation over ranked lists (query_id, rank, relevant) and the number of relevant items per query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def query_metrics(ranked: DataFrame, truth: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """``query_id`` with recall at each cut-off (1 if any relevant item is in it), ``rr`` and ``ndcg10``.

    ranked: query_id, rank, relevant (boolean); truth: query_id, n_relevant. Queries without results score 0.
    """
    gain = F.sum(F.when(F.col("relevant") & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1)))
    told = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.coalesce(gain, F.lit(0.0)).alias("dcg"), F.least(F.max("rank"), F.lit(10)).alias("shown"))
    both = truth.join(told, "query_id", "left")
    most = F.least(F.col("n_relevant"), F.col("shown")).cast("int")
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    first = F.col("first")
    return both.select(
        "query_id",
        *[F.coalesce((first <= k).cast("int"), F.lit(0)).alias(f"recall{k}") for k in cutoffs],
        F.round(F.coalesce(1 / first, F.lit(0.0)), 6).alias("rr"),
        F.round(F.when(most > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0), 6).alias("ndcg10"),
    )


def grouped_means(metrics: DataFrame, groups: list[str], values: list[str]) -> DataFrame:
    """Means over all queries and by each group by itself, in one pass (grouping sets)."""
    told = metrics.groupingSets([[], *[[g] for g in groups]], *groups).agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(v), 6).alias(v) for v in values])
    return told


def rank_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """``query_id``, ``id``, ``rank_a``, ``rank_b`` of everything that two rankings place differently (null: not ranked)."""
    left, right = a.select("query_id", "id", F.col("rank").alias("rank_a")), b.select("query_id", "id", F.col("rank").alias("rank_b"))
    return left.join(right, ["query_id", "id"], "full_outer").where(~F.col("rank_a").eqNullSafe(F.col("rank_b")))
