"""Combining rankings. Every ranked relation carries query_id, id and rank; a DataFrame has no order of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mulberry.config import DEFAULTS


def reciprocal_rank(lists: list[tuple[DataFrame, float]], k: int = DEFAULTS.rrf_k) -> DataFrame:
    """``query_id``, ``id``, ``score``: the weighted sum of 1/(k+rank) over the lists an id is in."""
    parts = [d.select("query_id", "id", (F.lit(w) / (k + F.col("rank"))).alias("s")) for d, w in lists]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return all_.groupBy("query_id", "id").agg(F.round(F.sum("s"), 9).alias("score"))


def merge_variants(ranked: DataFrame, k: int = DEFAULTS.rrf_k, limit: int = DEFAULTS.variants) -> DataFrame:
    """One list per question from the lists of its variants: ranked has query_id, variant (0 is the original), id, rank.
    The original counts twice; at most ``limit`` variants count."""
    told = ranked.where(F.col("variant") <= limit)
    s = F.when(F.col("variant") == 0, 2.0).otherwise(1.0) / (k + F.col("rank"))
    return told.groupBy("query_id", "id").agg(F.round(F.sum(s), 9).alias("score"))


def best_child(ranked: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The first child of each parent in the order of rank."""
    w = Window.partitionBy("query_id", parent).orderBy("rank")
    return ranked.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def topic_filter(ranked: DataFrame, sparse: DataFrame, wanted: int = DEFAULTS.k) -> DataFrame:
    """Rows of the query's topic after recall; where fewer than ``wanted`` remain, further rows of the topic from the
    sparse list fill up: behind the others, but with their own scores. Both lists: query_id, topic, id, domain, score, rank."""
    kept = ranked.where((F.col("domain") == F.col("topic")) | F.col("topic").isNull())
    count = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
    more = sparse.where(F.col("domain") == F.col("topic")).join(kept.select("query_id", "id"), ["query_id", "id"], "left_anti").join(count, "query_id", "left")
    w = Window.partitionBy("query_id").orderBy("rank")
    filled = more.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= wanted - F.coalesce("have", F.lit(0)))
    cols = ["query_id", "id", "domain", "score", F.col("rank").alias("__r")]
    both = kept.select(*cols, F.lit(0).alias("topped")).unionByName(filled.select(*cols, F.lit(1).alias("topped")))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("topped", "__r", "id"))).drop("__r")


def min_max(c: Column, by: str = "query_id") -> Column:
    """Scores of one list scaled to 0..1; equal scores become 0."""
    w = Window.partitionBy(by)
    low, high = F.min(c).over(w), F.max(c).over(w)
    return F.when(high > low, (c - low) / (high - low)).otherwise(0.0)


def alpha_fusion(scored: DataFrame, alpha: float = DEFAULTS.rerank_alpha, k: int = DEFAULTS.rerank_k) -> DataFrame:
    """``alpha`` times the scaled rerank score plus the rest times the linear rank; equal sums keep their order.
    scored: query_id, id, rank, rerank."""
    n = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    linear = F.when(n > 1, (n - F.col("rank") + 1) / (n - 1)).otherwise(1.0)
    fused = scored.withColumn("fused", F.round(alpha * min_max(F.col("rerank")) + (1 - alpha) * linear, 9))
    w = Window.partitionBy("query_id").orderBy(F.col("fused").desc(), "rank")
    return fused.withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)


def alpha_or_order(scored: DataFrame, alpha: float = DEFAULTS.rerank_alpha) -> DataFrame:
    """alpha_fusion as ``new_rank`` of all rows; a query with a single row, or with a row without score, keeps its order."""
    w = Window.partitionBy("query_id")
    n, known = F.count(F.lit(1)).over(w), F.count("rerank").over(w)
    linear = (n - F.col("rank") + 1) / F.greatest(n - 1, F.lit(1))
    fused = F.when((n > 1) & (known == n), F.round(alpha * min_max(F.col("rerank")) + (1 - alpha) * linear, 9)).otherwise(0.0)
    return scored.withColumn("fused", fused).withColumn("new_rank", F.row_number().over(w.orderBy(F.col("fused").desc(), "rank")))


def scattered(candidates: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores that came back by index: ``rerank`` of each candidate (query_id, index), 0 where there is none. scores: query_id,
    index, rerank; an index that no candidate has is ignored, of several scores of one the last by ``rerank`` counts."""
    one = scores.groupBy("query_id", "index").agg(F.max("rerank").alias("rerank"))
    return candidates.join(one, ["query_id", "index"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))


def margin_fusion(scored: DataFrame, delta: float) -> DataFrame:
    """Order by the rerank score in steps of ``delta``; within a step the old order holds."""
    w = Window.partitionBy("query_id").orderBy(F.bround(F.col("rerank") / delta).desc(), "rank")
    return scored.withColumn("new_rank", F.row_number().over(w))
