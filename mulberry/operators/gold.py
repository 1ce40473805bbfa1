"""Gold sets: evidence resolved to pages, contracts, coverage, and the joins that compare and explain runs.

cases: id, question, topic, kind. evidence: case_id, source, page, must_contain (array of text). chunks: id, source, page, text and, if
there are any, parent_id and element. Everything is a join on (source, page); no chunk is compared with all cases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mulberry.functions import text as T

KINDS = ("fact", "definition", "acronym", "comparison", "process", "scenario", "mechanism")


def bare(c: Column) -> Column:
    """Lower case without blanks of any kind."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), T.SPACES, ""))


def share_held(text: Column, terms: Column) -> Column:
    """The share of the terms that the text holds, blanks and case aside; null without terms."""
    told = bare(text)
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(told, bare(t)))) / F.size(terms))


def relevant_parents(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """``case_id``, ``parent_id``: pages of the evidence whose text holds all that it must; evidence without terms takes any."""
    parent = F.coalesce("parent_id", "id") if "parent_id" in chunks.columns else F.col("id")
    told = evidence.join(chunks.select("source", "page", "text", parent.alias("parent_id")), ["source", "page"])
    return told.where(F.coalesce(share_held(F.col("text"), F.col("must_contain")), F.lit(1.0)) == 1.0).select("case_id", "parent_id").distinct()


def cases_on_tables(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """``case_id`` of every case with evidence on a page that carries a table."""
    pages = chunks.where(F.col("element") == "table").select("source", "page")
    return evidence.join(pages, ["source", "page"], "left_semi").select("case_id").distinct()


def keyword_coverage(results: DataFrame, evidence: DataFrame, depth: int = 5) -> DataFrame:
    """``case_id``, ``coverage``: the best share of one evidence's terms in one of the first results. results: case_id, rank, text; a
    case without results covers 0."""
    shares = results.where(F.col("rank") <= depth).select("case_id", "text").join(evidence.select("case_id", "must_contain"), "case_id")
    best = shares.groupBy("case_id").agg(F.max(share_held(F.col("text"), F.col("must_contain"))).alias("c"))
    return evidence.select("case_id").distinct().join(best, "case_id", "left").select("case_id", F.round(F.coalesce("c", F.lit(0.0)), 6).alias("coverage"))


def contract(cases: DataFrame, evidence: DataFrame, chunks: DataFrame, topics: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``problem``, ``item``: repeated ids, empty questions, unknown topics and kinds, cases without evidence or whose evidence no
    page holds, topics without a case. No row: the set is sound."""
    told = lambda df, name, c: df.select(F.lit(name).alias("problem"), F.col(c).cast("string").alias("item"))
    named = topics.select(F.col("domain").alias("topic"))
    held = evidence.select(F.col("case_id").alias("id")).distinct()
    found = relevant_parents(evidence, chunks).select(F.col("case_id").alias("id"))
    parts = [
        told(cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated_id", "id"),
        told(cases.where(T.strip(F.coalesce("question", F.lit(""))) == ""), "empty_question", "id"),
        told(cases.join(named, "topic", "left_anti"), "unknown_topic", "id"),
        told(cases.where(~F.coalesce("kind", F.lit("")).isin(*kinds)), "unknown_kind", "id"),
        told(cases.join(held, "id", "left_anti"), "no_evidence", "id"),
        told(held.join(found, "id", "left_anti"), "unresolved_evidence", "id"),
        told(named.join(cases.select("topic"), "topic", "left_anti"), "uncovered_topic", "topic"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_of_topic(ranked: DataFrame, truth: DataFrame, depth: int = 10) -> DataFrame:
    """``label``, ``queries``, ``top1``, ``top5``, ``mrr``: how early a row of the query's topic comes. ranked: query_id, rank, domain;
    truth: query_id, label; a query whose topic isn't among the first ``depth`` counts 0."""
    hits = ranked.where(F.col("rank") <= depth).join(truth, "query_id").where(F.col("domain") == F.col("label")).groupBy("query_id").agg(F.min("rank").alias("first"))
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    told = truth.join(hits, "query_id", "left")
    return told.groupBy("label").agg(
        F.count(F.lit(1)).alias("queries"), share((F.col("first") <= 1).cast("double")).alias("top1"), share((F.col("first") <= 5).cast("double")).alias("top5"), share(1 / F.col("first")).alias("mrr")
    )


def conditional_means(rows: DataFrame, groups: list[str], means: dict[str, Column], only: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` and the mean of each measure by group (all rows without groups); ``only`` names the rows a measure is taken over.
    A measure without rows is null."""
    held = only or {}
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("rows"), *[F.round(F.avg(F.when(held.get(n, F.lit(True)), c.cast("double"))), 6).alias(n) for n, c in means.items()])


def pair_key(model: Column, query: Column, text: Column) -> Column:
    """The key of a scored pair: equal model, query and text give an equal key."""
    return F.md5(F.concat_ws("\x1f", model, query, text))


def with_cached_scores(candidates: DataFrame, cache: DataFrame, complete: bool = True) -> DataFrame:
    """Candidates (with ``key``) with the ``score`` of the cache. complete: a pair without score ends the run with an error that
    names it; otherwise it has a null score."""
    one = cache.groupBy("key").agg(F.max("score").alias("score"))
    told = candidates.join(one, "key", "left")
    if not complete:
        return told
    return told.withColumn("score", F.when(F.col("score").isNull(), F.raise_error(F.concat(F.lit("no score for the pair "), "key")).cast("double")).otherwise(F.col("score")))


def uncached(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """The keys of candidates the cache has no score for."""
    return candidates.select("key").distinct().join(cache.select("key"), "key", "left_anti")


def page_snippets(ranked: DataFrame, chunks: DataFrame, depth: int = 5, most: int = 260) -> DataFrame:
    """The first rows of each query (query_id, rank, source, page) with a ``snippet`` of their page, line ends as bars; of several
    chunks of a page the last by id counts, a page without chunk has an empty snippet."""
    last = chunks.groupBy("source", "page").agg(F.max_by("text", "id").alias("__t"))
    told = ranked.where(F.col("rank") <= depth).join(last, ["source", "page"], "left")
    return told.withColumn("snippet", F.replace(F.left(F.coalesce("__t", F.lit("")), F.lit(most)), F.lit("\n"), F.lit(" | "))).drop("__t")


def proxy_vectors(held: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors for chunks that have none of their own, from the first chunk (by id) with one of the same topic, source and page; and
    the chunks no page has a vector for. held: id, domain, source, page, vector; wanted: id, domain, source, page."""
    page = ["domain", "source", "page"]
    first = held.groupBy(*page).agg(F.min_by("vector", "id").alias("vector"))
    return wanted.join(first, page).select("id", "vector"), wanted.join(first, page, "left_anti").select("id", *page)


def reused_vectors(chunks: DataFrame, held: DataFrame, model: str, embed) -> DataFrame:
    """``id``, ``vector`` of every chunk: the held one of the same id and model, else what ``embed`` (id, text -> id, vector) makes of it.
    held: id, embedding_model, vector. Only missing chunks are embedded."""
    known = held.where(F.col("embedding_model") == model).select("id", "vector")
    return chunks.select("id").join(known, "id").select("id", "vector").unionByName(embed(chunks.select("id", "text").join(known, "id", "left_anti")))


def in_order(chunks: DataFrame) -> DataFrame:
    """Chunks with ``position`` in the order of topic, source, page and id; positions are counted by topic and source and put
    together from their sizes, so no task sees all chunks."""
    part = ["domain", "source"]
    told = chunks.withColumn("__n", F.row_number().over(Window.partitionBy(*part).orderBy("page", "id")))
    sizes = chunks.groupBy(*part).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("domain").alias("__d"), F.col("source").alias("__s"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"))
    both = told.join(offsets, F.col("domain").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")))
    return both.withColumn("position", F.col("__before") + F.col("__n")).drop("__d", "__s", "__before", "__n")
