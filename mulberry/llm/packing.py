"""Items of varying length in containers of fixed capacity: minimum bin slack over a histogram of lengths.

Only lengths matter, and there are at most ``capacity`` of them, so the plan is made on the driver from the
histogram, whatever the number of items: each step takes the largest length left, finds by a bitset subset-sum
over the lengths left the fullest container that holds it, and uses that combination as often as the lengths last.
A step uses up a length, so the plan is about as long as there are lengths.

Items get their container by their rank among the items of their length. Ranks are counted in salted groups of
(length, hash), so a length that a third of all items share is spread over many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mulberry.session import checkpointed

CAPACITY = 2048
GROUP_ROWS = 1_000_000


def fullest(lengths: list[int], counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of which lengths fill a container best, with one of the largest. lengths: in falling order."""
    first = lengths[0]
    room = capacity - first
    keep = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        left = min(counts[length] - (length == first), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            left -= take
            before, reach = reach, (reach | reach << (take * length)) & keep
            if reach != before:
                steps.append((length, take, before))
            take *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    chosen = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def pack_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths and how many containers each fills; together they use up ``counts``."""
    counts = {n: c for n, c in counts.items() if c > 0 and n > 0}
    lengths = sorted(counts, reverse=True)
    plan = []
    while lengths:
        chosen = fullest(lengths, counts, capacity)
        times = min(counts[n] // k for n, k in chosen.items())
        plan.append((chosen, times))
        for n, k in chosen.items():
            counts[n] -= k * times
        lengths = [n for n in lengths if counts[n]]
    return plan


def items_of(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """Items of at most the capacity: ``key``, ``part``, ``start``, ``n``. Only what is above the capacity is cut, into
    full parts and a rest; sizes that are null, 0 or less give no item."""
    parts = F.sequence(F.lit(0), F.floor((F.col(size) - 1) / capacity).cast("int"))
    cut = sizes.where(F.col(size) > 0).select(F.col(key), F.explode(parts).alias("part"), F.col(size).alias("__size"))
    return cut.select(key, "part", (F.col("part") * capacity).alias("start"), F.least(F.col("__size") - F.col("part") * capacity, F.lit(capacity)).cast("int").alias("n"))


def packed(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """``key``, ``part``, ``start``, ``n``, ``container`` of every item. The same input gives the same containers but for
    repeated rows, which share their places in any order. An empty table gives an empty result."""
    items = checkpointed(items_of(sizes, key, size, capacity))
    histogram = {r.n: r.c for r in items.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # at most ``capacity`` rows
    salts = max(1, sum(histogram.values()) // GROUP_ROWS)
    plan = pack_lengths(histogram, capacity)
    rows, used, container = [], dict.fromkeys(histogram, 0), 0
    for chosen, times in plan:
        for n, k in chosen.items():
            rows.append((n, used[n], k, container))
            used[n] += k * times
        container += times
    steps = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4)

    salted = items.withColumn("__salt", F.pmod(F.xxhash64(key, "part"), F.lit(salts)).cast("int"))
    before = Window.partitionBy("n").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("n", "__salt").agg(F.count(F.lit(1)).alias("c")).select("n", "__salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("__offset"))
    place = F.row_number().over(Window.partitionBy("n", "__salt").orderBy(key, "part")) - 1
    ranked = salted.withColumn("__rank", place).join(offsets, ["n", "__salt"]).select(key, "part", "start", "n", (F.col("__rank") + F.col("__offset")).alias("rank"))

    def container_of(n: pd.Series, rank: pd.Series) -> pd.Series:
        n, rank = n.to_numpy(np.int64), rank.to_numpy(np.int64)
        width = np.int64(1) << 44  # a length and a rank in one number
        at = np.searchsorted(steps[:, 0] * width + steps[:, 1], n * width + rank, side="right") - 1
        return pd.Series(steps[at, 3] + (rank - steps[at, 1]) // steps[at, 2])

    return ranked.select(key, "part", "start", "n", F.pandas_udf(container_of, "long")("n", "rank").alias("container"))


def fill_report(packed_items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: ``containers``, ``items``, ``tokens``, ``fill`` (share of the capacity used), ``least`` (the fewest
    containers any packing needs)."""
    each = packed_items.groupBy("container").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    total = each.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("k"), F.lit(0)).alias("items"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return total.select("containers", "items", "tokens", F.round(F.col("tokens") / (F.col("containers") * capacity), 6).alias("fill"), F.ceil(F.col("tokens") / capacity).alias("least"))
