"""Dense retrieval: exact cosine of a stated query set against all vectors, in blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.operators.lexical import top_k

BLOCK_QUERIES, BLOCK_ROWS, STEP = 8_192, 20_000, 256


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero."""
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1e-9, norms)


def nearest(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest values of each row, the largest first; of equal ones the earlier column."""
    if k >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
    held = [np.flatnonzero(row >= x) for row, x in zip(scores, least)]
    return np.stack([h[np.argsort(-row[h], kind="stable")[:k]] for h, row in zip(held, scores)])


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int, rows: int | None = None) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank`` of the k nearest vectors of each query (itself included).

    queries: query_id, vector; vectors: id, vector. Both sides are cut into blocks by the hash of their ids; a task
    multiplies one block of each and keeps k rows a query, so neither side has to fit into a task. rows: size of
    ``vectors``, counted if not given.
    """
    n = vectors.count() if rows is None else rows
    m = queries.count()
    slices, blocks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-m // BLOCK_QUERIES))
    left = vectors.select(F.pmod(F.xxhash64("id"), F.lit(slices)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "id", "vector")
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("s"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), "query_id", "vector")

    def multiply(v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": q["query_id"].iloc[:0], "id": v["id"].iloc[:0].reset_index(drop=True), "score": np.empty(0)})
        if v.empty or q.empty:
            return none
        v = v.sort_values("id", kind="stable")
        ids, names = v["id"].to_numpy(), q["query_id"].to_numpy()
        rows, asked = unit(np.stack(v["vector"]).astype(np.float64)), unit(np.stack(q["vector"]).astype(np.float64))
        parts = []
        for at in range(0, len(names), STEP):
            scores = np.round(asked[at : at + STEP] @ rows.T, 6)
            order = nearest(scores, k)
            parts.append(pd.DataFrame({"query_id": np.repeat(names[at : at + STEP], order.shape[1]), "id": ids[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()}))
        return pd.concat(parts)

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    near = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(multiply, kinds)
    return top_k(near, k)


def hash_embedding(df: DataFrame, key: str, text: str, bins: int = 256) -> DataFrame:
    """key, ``bin``, ``weight``: characters hashed into bins (the first two bytes of their md5, low byte first), counted and
    scaled to length 1, as sparse rows."""
    c = F.md5(F.col("ch"))
    byte = lambda at: F.conv(F.substring(c, at, 2), 16, 10).cast("int")
    chars = df.select(key, F.explode(F.split(F.col(text), "")).alias("ch")).where("ch <> ''")
    counted = chars.select(key, ((byte(1) + 256 * byte(3)) % bins).alias("bin")).groupBy(key, "bin").agg(F.count(F.lit(1)).alias("n"))
    norms = counted.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counted.join(norms, key).select(key, "bin", F.round(F.col("n") / F.col("norm"), 6).alias("weight"))


def below_floor(best: Column, floor: float) -> Column:
    """Whether the best dense score is below the floor; without any dense score it isn't."""
    return F.coalesce(best < floor, F.lit(False))
