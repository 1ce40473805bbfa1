"""Tables that grow: insert-if-absent, missing vectors, manifest checks, fallback sources."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mulberry.session import checkpointed


def new_rows(batch: DataFrame, existing: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a batch whose key isn't there yet; of several with one key the first by ``order``. Existing rows are
    never changed. Append the result."""
    first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
    return first.join(existing.select(key), key, "left_anti")


def manifest_problems(counts: dict[str, DataFrame], expected: dict[str, int]) -> DataFrame:
    """``asset``, ``expected``, ``found`` for every asset whose number of rows isn't as expected."""
    spark = next(iter(counts.values())).sparkSession
    parts = [d.agg(F.count(F.lit(1)).alias("found")).select(F.lit(n).alias("asset"), "found") for n, d in counts.items()]
    told = parts[0]
    for p in parts[1:]:
        told = told.unionByName(p)
    wanted = spark.createDataFrame(list(expected.items()), "asset string, expected bigint")
    return wanted.join(told, "asset", "left").where(~F.col("found").eqNullSafe(F.col("expected"))).select("asset", "expected", F.coalesce("found", F.lit(0)).alias("found"))


def missing_vectors(chunks: DataFrame, vectors: DataFrame, key: str = "id") -> DataFrame:
    """Chunks whose stable id has no vector yet."""
    return chunks.join(vectors.select(key), key, "left_anti")


def first_with_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """``id`` and ``first_id``: the first row (by order) with the same key, where that is another row."""
    first = df.where(F.col(key) != "").groupBy(key).agg(F.min_by("id", F.struct(order, "id")).alias("first_id"))
    return df.join(first, key).where(F.col("id") != F.col("first_id")).select("id", "first_id")


def non_empty(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary source, or the fallback where the primary has no rows."""
    return fallback if primary.isEmpty() else primary


def updated_manifest(held: DataFrame, fields: dict[str, object]) -> DataFrame:
    """A manifest (key, value as JSON text) with new values: those named are replaced or added, the others stay."""
    new = held.sparkSession.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in fields.items()], "key string, value string")
    return held.join(new, "key", "left_anti").select("key", "value").unionByName(new)


def cached_or_made(wanted: DataFrame, cache: DataFrame, make, model: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Vectors of texts by content: ``id``, ``vector`` of every wanted row (id, text), and the rows to append to the cache (key,
    vector). The key is made of model, dimension and text; equal texts are made once. make: (key, text) -> (key, vector)."""
    keyed = wanted.select("id", "text", F.md5(F.concat_ws("\x1f", F.lit(model), F.lit(str(dimension)), F.coalesce("text", F.lit("")))).alias("key"))
    lacking = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    made = checkpointed(make(lacking))
    known = cache.select("key", "vector").dropDuplicates(["key"]).unionByName(made.select("key", "vector"))
    return keyed.join(known, "key").select("id", "vector"), made
