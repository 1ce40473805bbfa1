"""The whole search as one plan over a batch of queries: recall of every variant, fusion, collapse, reranking, refusal.

Nothing is computed a query at a time: each step is a join or a window over (query, candidate) rows, of which there are at
most as many as the lists are long.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.config import DEFAULTS, Settings
from mulberry.functions import text as T
from mulberry.operators import dense as D
from mulberry.operators import fusion, lexical, rerank
from mulberry.session import checkpointed

#: Gives (query_id, id, score, rank) for (query_id, query): dense recall with any embedding.
Recall = Callable[[DataFrame], DataFrame]
#: Gives a score for a query and a candidate's text; null where it has none. A cross-encoder is a pandas UDF of the two.
Scorer = Callable[[Column, Column], Column]


def shared_tokens(query: Column, text: Column) -> Column:
    """The offline scorer: the share of the query's tokens in the text."""
    return F.round(rerank.overlap(T.tokens(query), text), 6)


def asks(queries: DataFrame, limit: int = DEFAULTS.variants) -> DataFrame:
    """``query_id``, ``variant``, ``ask`` (query and variant as one key), ``query``, ``topic``: the rewritten query as variant 0 and up to
    ``limit`` of its variants that are neither blank nor the query itself."""
    told = queries.select("query_id", "topic", T.rewritten(F.col("query")).alias("query"), *([F.col("variants")] if "variants" in queries.columns else []))
    if "variants" in queries.columns:
        other = F.slice(F.filter("variants", lambda v: (T.strip(v) != "") & (T.strip(v) != F.col("query"))), 1, limit)
        told = told.withColumn("all", F.concat(F.array("query"), F.coalesce(other, F.array().cast("array<string>"))))
    else:
        told = told.withColumn("all", F.array("query"))
    return told.select("query_id", "topic", F.posexplode("all").alias("variant", "query")).withColumn("ask", F.concat_ws("#", "query_id", "variant"))


def recalled(asked: DataFrame, corpus: DataFrame, dense: Recall | None, settings: Settings = DEFAULTS) -> DataFrame:
    """``ask``, ``id``, ``score``, ``rank``, ``dense_score`` of each ask's list: both recalls fused, rows of other topics dropped and
    filled up from the sparse list. Without dense recall more of the sparse list takes its place."""
    keyed = asked.select(F.col("ask").alias("query_id"), "query", "topic")
    tokens = keyed.select("query_id", T.tokens(F.col("query")).alias("tokens"))
    told = lexical.tokenised(corpus, T.tokens(F.coalesce(F.col("embedding_text"), F.col("text"), F.lit(""))))
    # what is recalled is small (60 rows an ask) and used several times
    sparse = checkpointed(lexical.top_k(lexical.bm25(tokens, lexical.postings(told, F.col("tokens"), asked=tokens)).where("score > 0"), settings.degraded_sparse_k))
    near = None if dense is None else checkpointed(dense(keyed.select("query_id", "query")).where(F.col("rank") <= settings.dense_k))
    lists = [(sparse, 1.0)] if near is None else [(sparse.where(F.col("rank") <= settings.sparse_k), 1.0), (near, 1.0)]
    topics = corpus.select("id", "domain")
    known = lambda ranked: ranked.join(topics, "id").join(keyed.select("query_id", "topic"), "query_id")
    fused = known(lexical.ranked(fusion.reciprocal_rank(lists, settings.rrf_k)))
    kept = fusion.topic_filter(fused, known(sparse.where(F.col("rank") <= settings.topup_k)), settings.k)
    scores = None if near is None else near.select("query_id", "id", F.col("score").alias("dense_score"))
    out = kept.withColumn("dense_score", F.lit(None).cast("double")) if scores is None else kept.join(scores, ["query_id", "id"], "left")
    return out.select(F.col("query_id").alias("ask"), "id", "score", "rank", "dense_score")


def merged(lists: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``query_id``, ``id``, ``score``, ``rank``, ``dense_score``: the lists of a query's variants as one (the first counts twice); a query
    with one list keeps it as it is. lists: query_id, variant, id, score, rank, dense_score."""
    several = lists.groupBy("query_id").agg((F.max("variant") > 0).alias("several"))
    both = lists.join(several, "query_id")
    gain = F.when(F.col("variant") == 0, 2.0).otherwise(1.0) / (settings.rrf_k + F.col("rank"))
    fused = both.where("several").groupBy("query_id", "id").agg(F.round(F.sum(gain), 9).alias("score"), F.min_by(F.struct("dense_score"), "variant")["dense_score"].alias("dense_score"))
    return both.where("not several").select("query_id", "id", "score", "rank", "dense_score").unionByName(lexical.ranked(fused).select("query_id", "id", "score", "rank", "dense_score"))


def search(
    queries: DataFrame, corpus: DataFrame, dense: Recall | None = None, scorer: Scorer | None = shared_tokens, model: dict | None = None, kinds: str | None = "process", settings: Settings = DEFAULTS
) -> DataFrame:
    """``query_id``, ``id``, ``rank``, ``score``, ``refused`` of the best chunks of each query.

    queries: query_id, query, topic (null for any), and if there are any: ``variants`` (array of text) and ``context`` (array of
    struct source, page: what was shown before). corpus: id, domain, source, page, title, text, and if there are any:
    ``parent_id`` and ``embedding_text``. model: for queries of the ``kinds`` the learned score decides the order. scorer: its scores
    are blended with the order of the best; where it gives none for a candidate, or there is no scorer, the order stays.
    refused: whether the best dense score shown is below the floor. Null texts are empty; a query without candidates gives no row.
    """
    plain = corpus.select(
        "id", "domain", "source", "page", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"),
        (F.coalesce("parent_id", "id") if "parent_id" in corpus.columns else F.col("id")).alias("parent_id"),
        (F.col("embedding_text") if "embedding_text" in corpus.columns else F.lit(None).cast("string")).alias("embedding_text"),
    )
    asked = asks(queries, settings.variants)
    listed = recalled(asked, plain, dense, settings).join(asked.select("ask", "query_id", "variant"), "ask")
    pool = checkpointed(merged(listed, settings))
    told = fusion.best_child(pool.join(plain, "id"))
    context = F.col("context") if "context" in queries.columns else F.lit(None).cast("array<struct<source:string,page:int>>")
    first = asked.where("variant = 0").select("query_id", "query").join(queries.select("query_id", F.col("query").alias("own"), context.alias("context")), "query_id")
    full = told.join(first, "query_id").withColumn("terms", T.tokens(F.col("query"))).withColumn("element", F.when(F.contains("text", F.lit("\n|")), "table").otherwise("text"))
    near = F.exists("context", lambda p: (p["source"] == F.col("source")) & rerank.near_page(F.col("page"), p["page"]))
    ranked = checkpointed(rerank.reranked(full.withColumn("context", F.coalesce(near, F.lit(False)))).drop("rank", "score").withColumnRenamed("new_rank", "rank").withColumnRenamed("feature_score", "score"))
    slots = rerank.fold_versions(ranked.select("query_id", "id", "rank", "domain", "title", "source", "text"))
    folded = rerank.renumbered(slots.join(ranked.drop("rank"), ["query_id", "id"]), F.col("slot"))
    if model is not None:
        values = rerank.features(F.col("query"), F.col("terms"))
        learned = F.when(T.learned_ranking_applies(F.col("query"), kinds), F.round(rerank.logistic_score([values[n] for n in rerank.FEATURES], model), 6)).otherwise(0.0)
        folded = rerank.renumbered(folded.withColumn("learned", learned), F.col("learned").desc(), F.col("rank"))
    best = folded
    if scorer is not None:
        best = best.where(F.col("rank") <= settings.rerank_k).withColumn("rerank", scorer(F.col("own"), F.coalesce(F.nullif("embedding_text", F.lit("")), "text")))
        best = fusion.alpha_or_order(best, settings.rerank_alpha).drop("rank").withColumnRenamed("new_rank", "rank")
    shown = best.where(F.col("rank") <= settings.k)
    floor = shown.groupBy("query_id").agg(D.below_floor(F.max("dense_score"), settings.relevance_floor).alias("refused"))
    return shown.join(floor, "query_id").select("query_id", "id", "rank", "score", "refused")
