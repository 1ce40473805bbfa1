"""Lexical retrieval over a postings table: BM25 is a join on the term and a sum, no document is visited twice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mulberry.config import DEFAULTS
from mulberry.session import checkpointed


#: Most terms of queries that are broadcast; more are joined by a shuffle.
BROADCAST_TERMS = 200_000
#: Queries and documents of a block of bm25_top_k, and queries whose scores are held at once.
BLOCK_QUERIES, BLOCK_ROWS, STEP = 8_192, 8_192, 256


def tokenised(corpus: DataFrame, tokens: Column, key: str = "id") -> DataFrame:
    """key and ``tokens`` of every document, kept so that totals and postings don't cut the texts anew."""
    return checkpointed(corpus.select(key, tokens.alias("tokens")))


def postings(corpus: DataFrame, tokens: Column, key: str = "id", asked: DataFrame | None = None) -> DataFrame:
    """``term``, key, ``tf``, ``length``, ``df``, ``n_docs``, ``avg_length``: documents without tokens count with length 0.

    asked: queries (with ``tokens``) the index is made for; then only their terms are kept, and what isn't asked for is
    dropped before anything is shuffled. Lengths and totals count all tokens. Without asked the whole index.
    """
    told = corpus.select(key, tokens.alias("__t")).select(key, "__t", F.size("__t").alias("length"))
    stats = told.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    terms = told.select(key, "length", F.explode("__t").alias("term"))
    few = False
    if asked is not None:
        wanted = asked.select(F.explode("tokens").alias("term")).distinct()
        few = wanted.count() <= BROADCAST_TERMS
        terms = terms.join(F.broadcast(wanted) if few else wanted, "term", "left_semi")
    tf = terms.groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))
    # every tf is above 0; a count that reads it needs the same columns as tf, so both share one shuffle
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    df = F.broadcast(df) if few else df  # a row for each asked term at most; the postings aren't shuffled again for it
    return tf.join(df, "term").crossJoin(F.broadcast(stats))  # one row


def save_index(corpus: DataFrame, tokens: Column, path: str, key: str = "id", parts: int = 256) -> None:
    """Write the whole index: postings in ``parts`` folders by the hash of the term, and beside them the totals. A search then reads
    the folders of its terms only, and no text is cut again."""
    index = postings(tokenised(corpus, tokens, key), F.col("tokens"), key)
    part = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    index.drop("n_docs", "avg_length").withColumn("part", part).repartition("part").sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")
    told = corpus.select(F.size(tokens).alias("length")).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length"))
    told.withColumn("parts", F.lit(parts)).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")


def saved_index(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The postings of the asked terms (queries with ``tokens``) as written by save_index; folders without such a term aren't read."""
    totals = spark.read.parquet(f"{path}/totals")
    parts = totals.first().parts
    wanted = asked.select(F.explode("tokens").alias("term")).distinct().withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int"))
    folders = [r.part for r in wanted.select("part").distinct().collect()]  # at most as many as there are folders
    held = spark.read.parquet(f"{path}/postings").where(F.col("part").isin(folders))
    kept = held.join(F.broadcast(wanted.select("term")) if wanted.count() <= BROADCAST_TERMS else wanted.select("term"), "term", "left_semi")
    return kept.drop("part").crossJoin(F.broadcast(totals.select("n_docs", "avg_length")))  # one row


def _weight(qtf: Column, k1: float, b: float) -> Column:
    """What a posting adds to the score of a query that has its term ``qtf`` times."""
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return qtf * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))


def bm25(queries: DataFrame, index: DataFrame, key: str = "id", k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
    """``query_id``, key, ``score`` of every document that shares a term. queries: query_id, tokens; a term that a
    query repeats counts as often."""
    terms = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    part = _weight(F.col("qtf"), k1, b)
    return terms.join(index, "term").groupBy("query_id", key).agg(F.round(F.sum(part), 6).alias("score"))


def _first(row: np.ndarray, k: int) -> np.ndarray:
    """The columns above 0 that may be among the k best once scores are rounded to 6 digits; of equal scores the first k."""
    least = np.partition(row, len(row) - k)[len(row) - k] if k < len(row) else 0.0
    held = np.flatnonzero((row > 0) & (row >= least - 2e-6))
    if len(held) <= k:
        return held
    held = held[np.argsort(-row[held], kind="stable")]
    starts = np.flatnonzero(np.r_[True, np.diff(row[held]) != 0])
    return held[np.arange(len(held)) - np.repeat(starts, np.diff(np.r_[starts, len(held)])) < k]


def bm25_top_k(queries: DataFrame, index: DataFrame, k: int, documents: int, key: str = "id", k1: float = DEFAULTS.bm25_k1, b: float = DEFAULTS.bm25_b) -> DataFrame:
    """The same rows as ``top_k(bm25(queries, index).where("score > 0"), k)``, without a row for every pair of query and document.

    Nearly every query shares a term with a good part of the documents, so the pairs grow with the product of both. Here
    documents and queries are cut into blocks by the hash of their ids; a task adds up the scores of one block of each in a
    matrix and keeps the k best documents a query. documents: about how many there are.
    """
    slices, blocks = max(1, -(-documents // BLOCK_ROWS)), max(1, -(-queries.count() // BLOCK_QUERIES))
    left = index.select(F.pmod(F.xxhash64(key), F.lit(slices)).alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.col(key).alias("d"), "term", _weight(F.lit(1), k1, b).alias("w"))
    right = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("s"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("b"), "query_id", "tokens")

    def add_up(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": q["query_id"].iloc[:0], "d": p["d"].iloc[:0].reset_index(drop=True), "score": np.empty(0)})
        if p.empty or q.empty:
            return none
        document, ids = pd.factorize(p["d"], sort=True)  # in order, so that of equal scores the first keys stay; a null is the first
        if document.min() < 0:
            document, ids = document + 1, np.r_[[None], np.asarray(ids, object)]
        term, terms = pd.factorize(p["term"])
        order = np.lexsort((document, term))
        document, term, weight = document[order], term[order], p["w"].to_numpy()[order]
        new = np.flatnonzero(np.r_[True, (np.diff(document) != 0) | (np.diff(term) != 0)])
        document, term, weight = document[new], term[new], np.add.reduceat(weight, new)
        ends = np.searchsorted(term, np.arange(len(terms) + 1))
        asker, names = pd.factorize(q["query_id"], use_na_sentinel=False)
        number = {t: i for i, t in enumerate(terms)}
        asked: list[dict[int, int]] = [{} for _ in names]
        for i, tokens in zip(asker, q["tokens"]):
            for t in tokens if tokens is not None else ():
                if (at := number.get(t)) is not None:
                    asked[i][at] = asked[i].get(at, 0) + 1
        parts = [none]
        for at in range(0, len(names), STEP):
            scores = np.zeros((min(STEP, len(names) - at), len(ids)))
            for row, told in zip(scores, asked[at : at + STEP]):
                for t, n in sorted(told.items()):
                    row[document[ends[t] : ends[t + 1]]] += n * weight[ends[t] : ends[t + 1]]
            kept = [_first(row, k) for row in scores]
            sizes = [len(x) for x in kept]
            if sum(sizes):
                parts.append(pd.DataFrame({"query_id": np.asarray(names)[at : at + STEP].repeat(sizes), "d": np.asarray(ids)[np.concatenate(kept)], "score": np.concatenate([row[x] for row, x in zip(scores, kept)])}))
        return pd.concat(parts) if len(parts) > 1 else none

    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, d {index.schema[key].dataType.simpleString()}, score double"
    near = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(add_up, kinds)
    return top_k(near.select("query_id", F.col("d").alias(key), F.round("score", 6).alias("score")).where("score > 0"), k, key)


def top_k(scored: DataFrame, k: int, key: str = "id", by: str = "score", partition: str = "query_id") -> DataFrame:
    """The k best of each query with ``rank``; ties go to the smaller key."""
    w = Window.partitionBy(partition).orderBy(F.col(by).desc(), F.col(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(scored: DataFrame, key: str = "id", by: str = "score", partition: str = "query_id") -> DataFrame:
    """All rows of each query with ``rank``; ties go to the smaller key."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(F.col(by).desc(), F.col(key))))


def out_of_vocabulary(queries: DataFrame, index: DataFrame, share: float = 0.99) -> DataFrame:
    """``query_id``, ``degraded``: whether less than ``share`` of a query's distinct tokens of two or more characters occur. The
    index may be one made for these queries."""
    terms = queries.select("query_id", F.explode(F.array_distinct("tokens")).alias("term")).where(F.length("term") >= 2)
    known = index.select("term").distinct().withColumn("known", F.lit(1))
    told = terms.join(known, "term", "left").groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("known").alias("k"))
    return queries.select("query_id").join(told, "query_id", "left").select("query_id", F.coalesce(F.col("k") / F.col("n") < share, F.lit(False)).alias("degraded"))


def switched_search(queries: DataFrame, corpus: DataFrame, k: int, more: Callable[[Column], Column], key: str = "id") -> DataFrame:
    """``query_id``, key, ``score``, ``word_score``, ``degraded``, ``rank``: BM25 over words; where a query has words outside the
    vocabulary, over the words and what ``more`` makes of them, on both sides. word_score is that of the words alone.

    queries: query_id, tokens (words); corpus: key, tokens (words).
    """
    words = checkpointed(postings(corpus, F.col("tokens"), key, queries))
    flags = checkpointed(out_of_vocabulary(queries, words))
    by_words = bm25(queries, words, key).withColumnRenamed("score", "word_score")
    lost = queries.join(flags.where("degraded"), "query_id", "left_semi").select("query_id", more(F.col("tokens")).alias("tokens"))
    mixed = bm25(lost, postings(corpus, more(F.col("tokens")), key, lost), key)
    plain = by_words.join(flags.where("not degraded"), "query_id", "left_semi").select("query_id", key, F.col("word_score").alias("score"), "word_score")
    other = mixed.join(by_words, ["query_id", key], "left").select("query_id", key, "score", F.coalesce("word_score", F.lit(0.0)).alias("word_score"))
    return top_k(plain.unionByName(other).where("score > 0"), k, key).join(flags, "query_id")
