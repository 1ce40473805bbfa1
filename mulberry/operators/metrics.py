"""Order statistics by two rules, request metrics, structure metrics and threshold gates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mulberry.functions import text as T

BINS, FEW = 1024, 50_000


def rule_capped(n: int, p: float) -> int:
    """Index min(int(n p), n - 1)."""
    return min(int(n * p), n - 1)


def rule_inner(n: int, p: float) -> int:
    """Index int((n - 1) p)."""
    return int((n - 1) * p)


def order_statistics(df: DataFrame, column: str, shares: list[float], rule: Callable[[int, float], int] = rule_capped) -> dict[float, float | None]:
    """The exact value at the index each share has by the rule, nulls aside; None without values.

    Values are counted in bins of equal width; only the bin that holds an index is looked at again, until it has few
    rows. No global sort, at most ``FEW`` values are fetched at once.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    first = values.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    out: dict[float, float | None] = {}
    for p in shares:
        if not first.n:
            out[p] = None
            continue
        index, part, n, low, high = rule(first.n, p), values, first.n, first.a, first.b
        while n > FEW and high > low:
            width = (high - low) / BINS
            number = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
            for row in sorted(part.groupBy(number.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect(), key=lambda r: r.bin):
                if index < row.n:
                    part, n, low, high = part.where((F.col("v") >= row.a) & (F.col("v") <= row.b)), row.n, row.a, row.b
                    break
                index -= row.n
        out[p] = low if high == low else sorted(r.v for r in part.collect())[index]
    return out


def percentile_rows(df: DataFrame, column: str, shares: list[float], rule: Callable[[int, float], int] = rule_capped, digits: int = 1) -> DataFrame:
    """``share``, ``value`` rows of order_statistics."""
    found = order_statistics(df, column, shares, rule)
    told = [(p, None if v is None else float(v)) for p, v in found.items()]
    return df.sparkSession.createDataFrame(told, "share double, value double").select("share", F.round("value", digits).alias("value"))


def capped_percentile(c: Column, p: float) -> Column:
    """The same by rule_capped as an aggregate, for a bounded number of rows (a window of the newest requests)."""
    ordered = F.sort_array(F.collect_list(c))
    n = F.size(ordered)
    return F.get(ordered, F.least(F.floor(n * p).cast("int"), n - 1))


def request_summary(requests: DataFrame, last: int = 500) -> DataFrame:
    """One row over the newest requests: count, mean and 95 % latency. requests: id, value; nulls are left out."""
    newest = requests.orderBy(F.col("id").desc()).limit(last)
    return newest.agg(F.count(F.lit(1)).alias("requests"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 6).alias("mean"), F.round(capped_percentile(F.col("value"), 0.95), 1).alias("p95"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("total"))


def request_report(requests: DataFrame, last: int = 500) -> DataFrame:
    """One row over the newest requests: how many, mean total, route and retrieval times, 95 % first-token and total times, token
    sums. requests: id, route_ms, retrieval_ms, first_token_ms, total_ms, prompt_tokens, completion_tokens; nulls don't count, a mean
    or sum of nothing is 0, a percentile of nothing null."""
    newest = requests.orderBy(F.col("id").desc()).limit(last)
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 1).alias(f"avg_{c}")
    p95 = lambda c: F.round(capped_percentile(F.col(c), 0.95), 1).alias(f"p95_{c}")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(f"total_{c}")
    return newest.agg(F.count(F.lit(1)).alias("requests"), *map(mean, ("total_ms", "route_ms", "retrieval_ms")), *map(p95, ("first_token_ms", "total_ms")), *map(total, ("prompt_tokens", "completion_tokens")))


def requests_by_intent(requests: DataFrame, last: int = 500) -> DataFrame:
    """``intent``, ``requests`` over the newest requests: an empty intent is unknown, a null one doesn't count."""
    newest = requests.orderBy(F.col("id").desc()).limit(last).where(F.col("intent").isNotNull())
    return newest.groupBy(F.coalesce(F.nullif("intent", F.lit("")), F.lit("unknown")).alias("intent")).agg(F.count(F.lit(1)).alias("requests"))


def structure_report(chunks: DataFrame) -> DataFrame:
    """``kind``, ``chunks``, ``parents``, ``children_per_parent``, mean, median, 90 % and greatest length, ``titled`` and ``duplicates`` (content
    keys that occur before) in percent. Order statistics are taken from the counts of each length, of which there are few.

    chunks: kind, parent_id, title, text; a null text has length 0.
    """
    told = chunks.select("kind", "parent_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.coalesce("title", F.lit("")).alias("title"), F.md5(T.content_key(F.coalesce("text", F.lit("")))).alias("key"))
    sums = told.groupBy("kind").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("parent_id").alias("parents"), F.round(F.avg("n"), 1).alias("mean"), F.max("n").alias("longest"),
        F.round(100 * F.avg((F.col("title") != "").cast("int")), 1).alias("titled"), F.round(100 * (1 - F.count_distinct("key") / F.count(F.lit(1))), 2).alias("duplicates"),
    )
    upto = Window.partitionBy("kind").orderBy("n")
    counts = told.groupBy("kind", "n").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(upto)).withColumn("all", F.sum("c").over(Window.partitionBy("kind")))
    at = lambda index: F.min(F.when(F.col("upto") > index, F.col("n")))
    low, high = at(F.floor((F.col("all") - 1) / 2)), at(F.floor(F.col("all") / 2))
    orders = counts.groupBy("kind").agg(((low + high) / 2).alias("median"), at(F.floor((F.col("all") - 1) * 0.9)).alias("p90"))
    return sums.join(orders, "kind").withColumn("children_per_parent", F.round(F.col("chunks") / F.col("parents"), 2))


def threshold_gate(values: DataFrame, thresholds: DataFrame) -> DataFrame:
    """``metric``, ``value``, ``threshold`` of every metric that is missing or below its threshold."""
    return thresholds.join(values, "metric", "left").where(F.col("value").isNull() | (F.col("value") < F.col("threshold"))).select("metric", "value", "threshold")
