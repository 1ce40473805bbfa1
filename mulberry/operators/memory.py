"""Conversation memory over rounds (thread_id, id, question, answer, intent, created_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threads(rounds: DataFrame, limit: int = 20) -> DataFrame:
    """``thread_id``, ``last_at``, ``rounds``, the newest threads first; rounds without thread don't count."""
    return rounds.where("thread_id is not null").groupBy("thread_id").agg(F.max("created_at").alias("last_at"), F.count(F.lit(1)).alias("rounds")).orderBy(F.col("last_at").desc(), "thread_id").limit(limit)


def newest(rounds: DataFrame, n: int) -> DataFrame:
    """The n newest rounds of each thread with ``age`` (1 is the newest). The limit is applied before the shuffle too."""
    w = Window.partitionBy("thread_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return rounds.where("thread_id is not null").withColumn("age", F.row_number().over(w)).where(F.col("age") <= n)


def messages(rounds: DataFrame, last: int) -> DataFrame:
    """The newest ``last`` messages of each thread in order: each round is the user's message, then the assistant's."""
    told = newest(rounds, -(-last // 2))
    pair = F.array(F.struct(F.lit("user").alias("role"), F.col("question").alias("content"), (2 * F.col("age")).alias("n")), F.struct(F.lit("assistant").alias("role"), F.col("answer").alias("content"), (2 * F.col("age") - 1).alias("n")))
    return told.select("thread_id", F.inline(pair)).where(F.col("n") <= last)


def thread_matches(scored: DataFrame, k: int) -> DataFrame:
    """The k best rounds of the asking thread: the thread is filtered before the cut. scored: query_id, query_thread,
    id, thread_id, score."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return scored.where(F.col("query_thread") == F.col("thread_id")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def round_text(question: Column, answer: Column, intent: Column) -> Column:
    """The text of a round that is embedded; what is missing is empty."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    return F.concat_ws("\n", part("意图", intent), part("用户", question), part("助手", answer))
