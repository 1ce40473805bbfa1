"""Queries over search, ranking and evaluation. Search queries are all questions asked whose id is divisible by 100,
vector queries all vectors whose id is; they run against all rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mulberry.config import DEFAULTS as S
from mulberry.functions import text as T
from mulberry.operators import dense, evaluation, fusion, lexical, metrics, rerank, retrieve
from mulberry.plans.sql import INTENT, REWRITTEN, SPACES, TOKENS, WORDS, any_of
from mulberry.sources.tables import table

MODEL = {
    "intercept": -0.4,
    "coef": [0.9, 0.3, 0.5, 0.6, 0.8, 0.2, 0.1, 0.1, -0.4, -0.3, 0.2, 0.2, 0.2, 0.2, 0.1],
    "mean": [0.05, 0.2, 0.1, 0.2, 0.1, 0.05, 0.0, 0.5, 0.1, 0.3, 0.02, 0.1, 0.02, 0.1, 0.01],
    "scale": [0.02, 0.2, 0.2, 0.2, 0.3, 0.2, 0.0, 0.5, 0.2, 0.4, 0.1, 0.3, 0.1, 0.3, 0.1],
}


def _title(c: str = "text"):
    return F.regexp_extract(F.coalesce(F.col(c), F.lit("")), "^([^\n。，]{1,30})\n", 1)


def _asked(spark, d, every: int = 100) -> DataFrame:
    return table(spark, d, "question_signals").where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.coalesce("question", F.lit("")).alias("query"), F.nullif(F.trim("domain"), F.lit("")).alias("topic"))


def _corpus(spark, d) -> DataFrame:
    return table(spark, d, "kb_chunks", wide=True).select("id", "domain", "source", "page", "kind", _title().alias("title"), F.coalesce("text", F.lit("")).alias("text"), T.embedding_text(F.col("domain"), _title(), F.coalesce("text", F.lit(""))).alias("embedding_text"))


def _bm25(spark, d, tokenizer=T.tokens, k: int = S.sparse_k, column: str = "embedding_text") -> DataFrame:
    asked = _asked(spark, d).select("query_id", tokenizer(F.col("query")).alias("tokens"))
    told = lexical.tokenised(_corpus(spark, d), tokenizer(F.col(column)))
    return lexical.bm25_top_k(asked, lexical.postings(told, F.col("tokens"), asked=asked), k, told.count())


def embedded(df: DataFrame, key: str, text: str, bins: int = 256) -> DataFrame:
    """``id``, ``vector``: hashed tokens as unit vectors, the offline stand-in for an embedding model (Arrow batches)."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros((len(batch), bins))
            for i, tokens in enumerate(batch["t"]):
                for t in tokens:
                    out[i, hashlib.md5(t.encode()).digest()[0] % bins] += 1
            yield pd.DataFrame({"id": batch["id"], "vector": list(dense.unit(out))})

    told = df.select(F.col(key).alias("id"), T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return told.mapInPandas(embed, f"id {df.schema[key].dataType.simpleString()}, vector array<double>")


def _near(corpus: DataFrame) -> retrieve.Recall:
    vectors = embedded(corpus, "id", "embedding_text")
    return lambda asked: dense.cosine_top_k(embedded(asked, "query_id", "query").withColumnRenamed("id", "query_id"), vectors, S.dense_k)


def _full_questions(spark, d, every: int = 100) -> DataFrame:
    """The questions asked with a variant (letters and digits only) and as context the first page of each source of the topic."""
    pages = table(spark, d, "kb_chunks").where("domain is not null").groupBy("domain", "source").agg(F.min("page").alias("page"))
    context = pages.groupBy(F.col("domain").alias("topic")).agg(F.array_sort(F.collect_list(F.struct("source", "page"))).alias("context"))
    return _asked(spark, d, every).withColumn("variants", F.array(T.compact(F.col("query")))).join(context, "topic", "left")


def hybrid_search(spark, d, every: int = 100) -> DataFrame:
    """Search with the questions whose id is divisible by ``every``."""
    corpus = _corpus(spark, d)
    return retrieve.search(_full_questions(spark, d, every), corpus.withColumn("parent_id", F.concat_ws("|", "source", "page")), _near(corpus), model=MODEL)


def q_hybrid_search(spark, d):
    return hybrid_search(spark, d)


def q_degraded_search(spark, d):
    """Without dense recall, variants, context and learned score."""
    return retrieve.search(_asked(spark, d), _corpus(spark, d))


def q_bm25_topk(spark, d):
    return _bm25(spark, d).select("query_id", "id", "score", "rank")


def q_bm25_oov_switch(spark, d):
    asked = _asked(spark, d).select("query_id", T.word_tokens(F.col("query")).alias("tokens"))
    told = lexical.tokenised(_corpus(spark, d), T.word_tokens(F.col("embedding_text")))
    return lexical.switched_search(asked, told, S.sparse_k, T.with_bigrams).select("query_id", "id", "score", "word_score", "rank", "degraded")


def _two_lists(spark, d):
    return _bm25(spark, d), _bm25(spark, d, column="title")


def q_rrf_fuse(spark, d):
    a, b = _two_lists(spark, d)
    return lexical.top_k(fusion.reciprocal_rank([(a, 1.0), (b, 1.0)]), S.dense_k)


def q_multi_query_merge(spark, d):
    a, b = _two_lists(spark, d)
    lists = a.select("query_id", F.lit(0).alias("variant"), "id", "rank").unionByName(b.select("query_id", F.lit(1).alias("variant"), "id", "rank"))
    return lexical.top_k(fusion.merge_variants(lists), S.dense_k)


def _known(spark, d, ranked):
    return ranked.join(_corpus(spark, d).select("id", "domain"), "id").join(_asked(spark, d).select("query_id", "topic"), "query_id")


def q_topic_postfilter_topup(spark, d):
    deep = _bm25(spark, d, k=S.topup_k)
    return fusion.topic_filter(_known(spark, d, deep.where(F.col("rank") <= S.dense_k)), _known(spark, d, deep)).select("query_id", "id", "score", "rank", "topped")


def q_parent_collapse(spark, d):
    told = _bm25(spark, d).join(_corpus(spark, d).select("id", F.concat_ws("|", "source", "page").alias("parent_id")), "id")
    return fusion.best_child(told).select("query_id", "parent_id", "id", "rank")


def _candidates(spark, d):
    full = _bm25(spark, d).join(_corpus(spark, d), "id").join(_asked(spark, d).select("query_id", "query"), "query_id")
    return full.withColumn("terms", T.tokens(F.col("query"))).withColumn("element", F.when(F.contains("text", F.lit("\n|")), "table").otherwise("text")).withColumn("dense_score", F.lit(None).cast("double")).withColumn("context", F.lit(False))


def q_feature_rerank(spark, d):
    return rerank.reranked(_candidates(spark, d)).select("query_id", "id", "feature_score", "new_rank")


def q_near_dup_fold(spark, d):
    return rerank.fold_versions(_candidates(spark, d).select("query_id", "id", "rank", "domain", "title", "source", "text"))


def q_ltr_score(spark, d):
    f = rerank.features(F.col("query"), F.col("terms"))
    return _candidates(spark, d).select("query_id", "id", F.round(rerank.logistic_score([f[n] for n in rerank.FEATURES], MODEL), 6).alias("learned"))


def _rescored(spark, d):
    """The sparse list with the share of shared tokens as the rerank score."""
    told = _candidates(spark, d)
    return told.select("query_id", "id", "rank", F.round(rerank.overlap(F.col("terms"), F.col("text")), 6).alias("rerank"))


def q_alpha_fusion(spark, d):
    return fusion.alpha_fusion(_rescored(spark, d)).select("query_id", "id", "fused", "new_rank")


def q_margin_fusion(spark, d):
    return fusion.margin_fusion(_rescored(spark, d), 0.1).select("query_id", "id", "new_rank")


def q_band_context(spark, d):
    """Candidates one to three pages from the best page of their query, in the same source."""
    told = _bm25(spark, d).join(_corpus(spark, d).select("id", "source", "page"), "id")
    best = told.where("rank = 1").select("query_id", F.col("source").alias("s"), F.col("page").alias("p"))
    near = told.join(best, (told.query_id == best.query_id) & (F.col("source") == F.col("s")) & rerank.near_page(F.col("page"), F.col("p")), "left_semi")
    return near.select("query_id", "id", "rank")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _vector_top(spark, d, k: int):
    held = _vectors(spark, d)
    near = dense.cosine_top_k(held.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector"), held, k + 1).where("query_id <> id")
    return lexical.top_k(near.drop("rank"), k)


def q_dense_topk(spark, d):
    return _vector_top(spark, d, 10)


def q_relevance_gate(spark, d):
    best = _vector_top(spark, d, 1)
    return best.select("query_id", "score", dense.below_floor(F.col("score"), S.relevance_floor).alias("refused"))


def _judged(spark, d, k: int = 10):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    told = _vector_top(spark, d, k).join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want")), "query_id").join(labels.withColumnRenamed("vec_id", "id"), "id")
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    truth = labels.where("vec_id % 100 = 0").join(sizes, "label").select(F.col("vec_id").alias("query_id"), "n_relevant", "label")
    return told.select("query_id", "id", "rank", (F.col("label") == F.col("want")).alias("relevant")), truth


def q_eval_metrics(spark, d):
    return evaluation.query_metrics(*_judged(spark, d))


def q_eval_grouped(spark, d):
    ranked, truth = _judged(spark, d)
    told = evaluation.query_metrics(ranked, truth).join(truth.select("query_id", "label"), "query_id").withColumn("half", F.col("query_id") % 2)
    return evaluation.grouped_means(told, ["label", "half"], ["recall1", "recall10", "rr", "ndcg10"])


def q_grid_search(spark, d):
    """Recall for each depth and fusion constant, best first as rank."""
    ranked, truth = _judged(spark, d)
    grid = spark.createDataFrame([(k, c) for k in (1, 3, 5, 10) for c in (10, 20, 60)], "depth int, constant int")
    told = ranked.crossJoin(F.broadcast(grid)).where(F.col("rank") <= F.col("depth"))
    total = truth.agg(F.count(F.lit(1)).alias("n"))
    per = told.groupBy("depth", "constant", "query_id").agg(F.max(F.col("relevant").cast("int")).alias("hit"), F.sum(F.when(F.col("relevant"), 1 / (F.col("constant") + F.col("rank"))).otherwise(0.0)).alias("gain"))
    return per.groupBy("depth", "constant").agg(F.sum("hit").alias("hits"), F.round(F.sum("gain"), 6).alias("gain")).crossJoin(F.broadcast(total)).select("depth", "constant", F.round(F.col("hits") / F.col("n"), 6).alias("recall"), "gain").withColumn("rank", F.row_number().over(Window.orderBy(F.col("recall").desc(), F.col("gain").desc(), "depth", "constant")))  # a row for each setting


def q_ab_rank_diff(spark, d):
    a, b = _two_lists(spark, d)
    return evaluation.rank_changes(a.where("rank <= 10"), b.where("rank <= 10"))


def q_threshold_gate(spark, d):
    ranked, truth = _judged(spark, d)
    told = evaluation.query_metrics(ranked, truth).agg(*[F.avg(c).alias(c) for c in ("recall1", "recall10", "rr")])
    values = told.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(c, 6).alias("value")) for c in told.columns])))
    gates = spark.createDataFrame([("recall1", 0.9), ("recall10", 0.0), ("rr", 0.99), ("answered", 0.5)], "metric string, threshold double")
    return metrics.threshold_gate(values, gates)


def q_training_matrix(spark, d):
    """Candidates with their feature values and the label whether they have the query's topic."""
    f = rerank.features(F.col("query"), F.col("terms"))
    told = _candidates(spark, d).join(_asked(spark, d).select("query_id", "topic"), "query_id")
    return told.select("query_id", "id", *[F.round(f[n], 6).alias(n) for n in rerank.FEATURES], (F.col("domain") == F.col("topic")).alias("label"))


_ASKED = "SELECT id AS query_id, coalesce(question, '') AS query, nullif(trim(domain, ' '), '') AS topic FROM question_signals WHERE id % 100 = 0"
_CORPUS = "SELECT *, concat_ws(chr(10), '知识域：' || coalesce(domain, ''), CASE WHEN title <> '' THEN '知识点：' || title END, text) AS embedding_text FROM (SELECT id, domain, source, page, regexp_extract(coalesce(text, ''), '^([^\\n。，]{1,30})\\n', 1) AS title, coalesce(text, '') AS text FROM kb_chunks)"


def _bm25_sql(tokens, column: str = "embedding_text", k: int = 20, name: str = "", asked: str = "asked") -> str:
    n = name
    return (
        f"d{n} AS (SELECT id, {tokens(column)} AS t FROM corpus), s{n} AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d{n}), "
        f"tf{n} AS (SELECT id, term, any_value(l) AS l, count(*) AS tf FROM (SELECT id, len(t) AS l, unnest(t) AS term FROM d{n}) GROUP BY id, term), "
        f"df{n} AS (SELECT term, count(*) AS df FROM tf{n} GROUP BY term), "
        f"q{n} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM {asked}) GROUP BY ALL), "
        f"sc{n} AS (SELECT query_id, id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM q{n} JOIN tf{n} USING (term) JOIN df{n} USING (term), s{n} GROUP BY ALL), "
        f"r{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc{n} WHERE score > 0) WHERE rank <= {k})"
    )


def _mixed(c: str) -> str:
    w = WORDS(c)
    return f"({w} || flatten(list_transform(list_filter({w}, lambda x: regexp_matches(x, '^[一-鿿]{{2,}}$')), lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2)))))"


_BASE = f"WITH asked AS ({_ASKED}), corpus AS ({_CORPUS}), "
_ONE = _BASE + _bm25_sql(TOKENS)
_TWO = _ONE + ", " + _bm25_sql(TOKENS, "title", name="2")
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY {} DESC, id)"
_VEC = (
    "WITH u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT q.id AS query_id, e.id, q.label AS want, e.label, "
    "round(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))), 6) AS score FROM u q, u e WHERE q.id % 100 = 0 AND q.id <> e.id), "
    "t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p) WHERE rank <= 10)"
)
_METRICS = (
    _VEC + ", n AS (SELECT vec_id AS query_id, label, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM embeddings), h AS (SELECT query_id, min(CASE WHEN label = want THEN rank END) AS f, sum(CASE WHEN label = want THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, max(rank) AS shown FROM t GROUP BY query_id), "
    "m AS (SELECT query_id, n.label, coalesce((f <= 1)::INT, 0) AS recall1, coalesce((f <= 3)::INT, 0) AS recall3, coalesce((f <= 5)::INT, 0) AS recall5, coalesce((f <= 10)::INT, 0) AS recall10, round(coalesce(1 / f, 0), 6) AS rr, "
    "round(CASE WHEN least(n_relevant, shown, 10) > 0 THEN dcg / list_sum(list_transform(range(1, least(n_relevant, shown, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg10 FROM n JOIN h USING (query_id))"
)
_CAND = _ONE + f", c AS (SELECT r.query_id, r.id, r.score, r.rank, query, {TOKENS('query')} AS terms, title, text, source, domain FROM r JOIN corpus USING (id) JOIN asked USING (query_id))"


def _over(c: str) -> str:
    return f"CASE WHEN len(terms) > 0 THEN len(list_filter(terms, lambda t: contains(regexp_replace(lower({c}), '{SPACES}', '', 'g'), t))) / len(terms) ELSE 0 END"


def _comp(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^一-鿿A-Za-z0-9]', '', 'g')"


_ACR = lambda c: f"list_distinct(regexp_extract_all({c}, '{T.ACRONYM}'))"
_HIT = lambda c, words: "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"
_FEATURES = {
    "base_score": "score", "dense_score": "0.0", "title_overlap": _over("title"), "text_overlap": _over("text"),
    "phrase_match": f"CASE WHEN {_comp('query')} = '' OR {_comp('title')} = '' THEN 0.0 WHEN contains({_comp('query')}, {_comp('title')}) OR contains({_comp('title')}, {_comp('query')}) THEN 1.0 WHEN length({_comp('title')}) >= 5 AND contains({_comp('query')}, left({_comp('title')}, 5)) THEN 0.6 ELSE 0.0 END",
    "acronym_hit": f"list_has_any({_ACR('query')}, {_ACR('title')})::INT", "source_first": "contains(source, 'CISP 4.2')::INT", "source_v42": "regexp_matches(source, '[Vv]4[.]2')::INT",
    "overview": "CASE WHEN starts_with(title, '知识子域') OR starts_with(title, '课程内容') THEN 1.0 WHEN len(regexp_extract_all(text, '了解|理解|掌握')) >= 3 THEN 0.5 ELSE 0.0 END",
    "short_detail": f"({any_of('query', T.DETAIL_CUES)} AND length(text) < 120)::INT",
    "composition_title": f"({any_of('query', T.COMPOSITION_CUES)} AND {any_of('title', T.COMPOSITION_TEXT_CUES)})::INT", "composition_text": f"({any_of('query', T.COMPOSITION_CUES)} AND {any_of('text', T.COMPOSITION_TEXT_CUES)})::INT",
    "process_title": f"({any_of('query', T.PROCESS_CUES)} AND {any_of('title', T.PROCESS_TEXT_CUES)})::INT", "process_text": f"({any_of('query', T.PROCESS_CUES)} AND {any_of('text', T.PROCESS_TEXT_CUES)})::INT",
    "table_numeric": "(contains(text, chr(10) || '|') AND regexp_matches(query, '[0-9]|第[一二三四五六七八九十]+|等级|字段|取值|赋值|位|表'))::INT",
}
_F = _CAND + ", f AS (SELECT *, " + ", ".join(f"({e}) AS {n}" for n, e in _FEATURES.items()) + " FROM c)"
_RULES = " + ".join(
    "CASE WHEN " + " AND ".join([f"contains(upper(query), '{w}')" for w in r.needs] + ([any_of("upper(query)", r.one_of)] if r.one_of else [])) + f" AND {_HIT('upper(text)', r.terms)} + {_HIT('upper(title || chr(10) || text)', r.titled) if r.titled else 0} >= {r.hits} THEN {r.bonus} ELSE 0.0 END" for r in rerank.RULES
)
_NAMED = f"len(list_filter({_ACR('query')}, lambda a: contains(upper(text), upper(a))))"
_AT = "list_filter(range(1, length(query) + 1), lambda i: regexp_matches(substr(query, i), '^[A-Za-z][A-Za-z0-9+-]+') AND (i = 1 OR NOT regexp_matches(substr(query, 1, i - 1), '[A-Za-z][A-Za-z0-9+-]*$')))"
_BESIDE = f"list_transform({_AT}, lambda i: right(substr(query, 1, i - 1), 10) || left(substr(query, i + length(regexp_extract(substr(query, i), '^[A-Za-z][A-Za-z0-9+-]+'))), 10))"
_NAMES = f"list_transform(flatten(list_transform({_BESIDE}, lambda w: regexp_extract_all(w, '[一-鿿]{{4,}}'))), lambda n: regexp_replace(n, '^[{T.PARTICLES}]+', ''))"
_WRITTEN = f"len(list_filter({_NAMES}, lambda n: length(n) >= 7 AND contains(title, left(n, 5)))) > 0"
_SCORE = (
    "base_score + 0.003 * title_overlap + 0.002 * text_overlap + 0.003 * phrase_match + 0.003 * (composition_title + composition_text) + 0.002 * (process_title + process_text) + 0.002 * table_numeric"
    f" + CASE WHEN {any_of('query', (*T.PROCESS_CUES, '哪些方法', '哪些工作', '哪些要点'))} AND len(regexp_extract_all(text, 'P\\d+-|D\\d+-|C\\d+-|第[一二三四五六七八九十]+阶段|（\\d+）|[1-9][、.．]')) >= 3 THEN 0.004 ELSE 0.0 END + {_RULES}"
    f" + CASE WHEN len({_ACR('query')}) >= 2 AND {_NAMED} >= 2 THEN least(0.004 * {_NAMED}, 0.012) ELSE 0.0 END + 0.001 * acronym_hit + CASE WHEN acronym_hit > 0 OR {_WRITTEN} THEN 0.004 ELSE 0.0 END + CASE WHEN source_first > 0 THEN 0.0015 WHEN source_v42 > 0 THEN 0.001 ELSE 0.0 END"
    f" - CASE overview WHEN 1.0 THEN 0.006 WHEN 0.5 THEN 0.003 ELSE 0.0 END - CASE WHEN NOT {any_of('query', T.DETAIL_CUES)} THEN 0.0 WHEN length(text) < 80 THEN 0.004 WHEN length(text) < 120 THEN 0.002 ELSE 0.0 END"
)
# of a fold group the first page holds the place; below 80 characters it goes to the first other page of 80 or more, else to the longest
_FOLD = (
    "v AS (SELECT *, CASE WHEN regexp_matches(coalesce(source, ''), '[vV]4\\.\\d+') AND length({t}) >= 4 THEN coalesce(domain, '') || chr(31) || {t} END AS g FROM {rows}), "
    "o AS (SELECT *, length(text) AS z, first_value(source) OVER w AS s0, first_value(id) OVER w AS i0, first_value(length(text)) OVER w AS z0, first_value(rank) OVER w AS r0 FROM v WHERE g IS NOT NULL WINDOW w AS (PARTITION BY query_id, g ORDER BY rank)), "
    "h AS (SELECT query_id, g, any_value(r0) AS slot, CASE WHEN any_value(z0) >= 80 THEN any_value(i0) ELSE coalesce(arg_min(id, rank) FILTER (source IS DISTINCT FROM s0 AND z >= 80), arg_max(id, (z, -rank)) FILTER (source IS DISTINCT FROM s0 OR id = i0)) END AS id FROM o GROUP BY query_id, g), "
    "fo AS (SELECT query_id, id, slot FROM h UNION ALL SELECT query_id, id, rank FROM v WHERE g IS NULL UNION ALL SELECT query_id, id, rank FROM o WHERE source IS NOT DISTINCT FROM s0 AND id <> i0)"
)
_Z = " + ".join([str(MODEL["intercept"]), *[f"({n} - {m}) / {s or 1.0} * {w}" for n, m, s, w in zip(rerank.FEATURES, MODEL["mean"], MODEL["scale"], MODEL["coef"])]])


def _search_sql(dense: bool) -> str:
    """The whole search: recall of each variant, fill up, merge, collapse, features, fold, learned order, blend, refusal."""
    rewritten = REWRITTEN.format(q="query")
    variants = f" UNION ALL SELECT query_id, 1, {_comp('own')}, own, topic FROM b0 WHERE trim({_comp('own')}) <> '' AND {_comp('own')} <> query" if dense else ""
    bins = lambda frm, col, key: f"SELECT {key}, b, count(*)::DOUBLE AS c FROM (SELECT {key}, ('0x' || substr(md5(t), 1, 2))::INT AS b FROM (SELECT {key}, unnest({TOKENS(col)}) AS t FROM {frm})) GROUP BY ALL"
    near = (
        f"bq AS ({bins('asks', 'query', 'query_id')}), bd AS ({bins('corpus', 'embedding_text', 'id')}), nq AS (SELECT query_id, sqrt(sum(c * c)) AS n FROM bq GROUP BY 1), nd AS (SELECT id, sqrt(sum(c * c)) AS n FROM bd GROUP BY 1), "
        "dp AS (SELECT query_id, id, sum(bq.c * bd.c) AS p FROM bq JOIN bd USING (b) GROUP BY ALL), dl AS (SELECT * FROM (SELECT a.query_id, k.id, round(coalesce(p / (nq.n * nd.n), 0), 6) AS score, row_number() OVER (PARTITION BY a.query_id ORDER BY round(coalesce(p / (nq.n * nd.n), 0), 6) DESC, k.id) AS rank "
        "FROM asks a CROSS JOIN corpus k LEFT JOIN dp ON dp.query_id = a.query_id AND dp.id = k.id LEFT JOIN nq ON nq.query_id = a.query_id LEFT JOIN nd ON nd.id = k.id) WHERE rank <= 10), "
        if dense else "dl AS (SELECT query_id, id, score, rank FROM r WHERE false), "
    )
    context = "cp AS (SELECT domain AS topic, source, min(page) AS page FROM kb_chunks WHERE domain IS NOT NULL GROUP BY ALL)" if dense else "cp AS (SELECT domain AS topic, source, page FROM kb_chunks WHERE false)"
    learned = f"CASE WHEN {INTENT.replace('question', 'query')} = 'process' THEN round(1 / (1 + exp(-greatest(least({_Z}, 50), -50))), 6) ELSE 0.0 END" if dense else "0.0"
    parent = "source || '|' || page" if dense else "id"
    return (
        f"WITH a0 AS ({_ASKED}), b0 AS (SELECT query_id, query AS own, topic, {rewritten} AS query FROM a0), a1 AS (SELECT query_id, 0 AS variant, query, own, topic FROM b0{variants}), "
        f"asks AS (SELECT query_id || '#' || variant AS query_id, query_id AS q, variant, query, topic FROM a1), corpus AS ({_CORPUS}), " + _bm25_sql(TOKENS, k=60, asked="asks") + f", {near}{context}, "
        f"u AS (SELECT query_id, id, rank FROM r WHERE rank <= {20 if dense else 60} UNION ALL SELECT query_id, id, rank FROM dl), f1 AS (SELECT query_id, id, round(sum(1 / (20 + rank)), 9) AS score FROM u GROUP BY ALL), "
        f"f2 AS (SELECT *, {_RANK.format('score')} AS rank FROM f1), f3 AS (SELECT f2.*, q, variant, topic FROM f2 JOIN asks USING (query_id) JOIN corpus k USING (id) WHERE topic IS NULL OR k.domain = topic), "
        "x1 AS (SELECT r.query_id, r.id, r.score, r.rank, q, variant, topic, row_number() OVER (PARTITION BY r.query_id ORDER BY r.rank) AS n FROM r JOIN asks USING (query_id) JOIN corpus k USING (id) WHERE r.rank <= 40 AND k.domain = topic AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.query_id = r.query_id AND f3.id = r.id)), "
        "f4 AS (SELECT query_id, q, variant, id, score, rank, 0 AS t FROM f3 UNION ALL SELECT query_id, q, variant, id, score, rank, 1 FROM x1 WHERE n <= 5 - (SELECT count(*) FROM f3 WHERE f3.query_id = x1.query_id)), "
        "f5 AS (SELECT f4.* EXCLUDE (rank), dl.score AS ds, row_number() OVER (PARTITION BY f4.query_id ORDER BY t, f4.rank, f4.id) AS rank FROM f4 LEFT JOIN dl ON dl.query_id = f4.query_id AND dl.id = f4.id), "
        "sv AS (SELECT q, max(variant) AS m FROM f5 GROUP BY q), m1 AS (SELECT q AS query_id, id, round(sum(CASE variant WHEN 0 THEN 2.0 ELSE 1.0 END / (20 + rank)), 9) AS score, (list(ds ORDER BY variant))[1] AS ds FROM f5 JOIN sv USING (q) WHERE m > 0 GROUP BY ALL), "
        f"m2 AS (SELECT query_id, id, score, ds, {_RANK.format('score')} AS rank FROM m1 UNION ALL SELECT q, id, score, ds, rank FROM f5 JOIN sv USING (q) WHERE m = 0), "
        f"m3 AS (SELECT m2.*, k.* EXCLUDE (id), row_number() OVER (PARTITION BY query_id, {parent} ORDER BY rank) AS pn FROM m2 JOIN corpus k USING (id)), "
        f"c AS (SELECT m3.* EXCLUDE (ds), ds, b0.query, b0.own, b0.topic, {TOKENS('b0.query')} AS terms FROM m3 JOIN b0 USING (query_id) WHERE pn = 1), "
        "f AS (SELECT *, " + ", ".join(f"({'coalesce(ds, 0.0)' if n == 'dense_score' else e}) AS {n}" for n, e in _FEATURES.items()) + " FROM c), "
        f"g1 AS (SELECT * EXCLUDE (score, rank, base_score), rank AS old, round({_SCORE} + CASE WHEN EXISTS (SELECT 1 FROM cp WHERE cp.topic = f.topic AND cp.source = f.source AND abs(cp.page - f.page) BETWEEN 1 AND 3) THEN 0.0015 ELSE 0 END, 6) AS base_score FROM f), "
        "g2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY base_score DESC, old) AS rank FROM g1), " + _FOLD.format(t=_comp("title"), rows="g2") + ", "
        f"g3 AS (SELECT g2.* EXCLUDE (rank), row_number() OVER (PARTITION BY g2.query_id ORDER BY slot) AS rank FROM fo JOIN g2 ON g2.query_id = fo.query_id AND g2.id = fo.id), g4 AS (SELECT *, {learned} AS learned FROM g3), "
        "g5 AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY query_id ORDER BY learned DESC, rank) AS rank FROM g4), "
        f"g6 AS (SELECT *, round({_over('embedding_text').replace('terms', 'own_terms')}, 6) AS rs FROM (SELECT *, {TOKENS('own')} AS own_terms FROM g5 WHERE rank <= 10)), "
        "g7 AS (SELECT *, count(*) OVER w AS n, min(rs) OVER w AS lo, max(rs) OVER w AS hi FROM g6 WINDOW w AS (PARTITION BY query_id)), "
        "g8 AS (SELECT *, CASE WHEN n > 1 THEN round(0.5 * CASE WHEN hi > lo THEN (rs - lo) / (hi - lo) ELSE 0 END + 0.5 * (n - rank + 1) / (n - 1), 9) ELSE 0 END AS fu FROM g7), "
        "g9 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fu DESC, rank) AS final FROM g8) "
        "SELECT query_id, id, final AS rank, base_score AS score, coalesce(max(ds) OVER (PARTITION BY query_id) < 0.45, false) AS refused FROM g9 WHERE final <= 5"
    )


_HYBRID, _DEGRADED = _search_sql(True), _search_sql(False)
_RE = _CAND + f", e AS (SELECT query_id, id, rank, round({_over('text')}, 6) AS rerank FROM c)"

SQL = {
    "q_bm25_topk": _ONE + " SELECT query_id, id, score, rank FROM r",
    "q_bm25_oov_switch": _BASE + f"w AS (SELECT query_id, unnest(list_distinct({WORDS('query')})) AS term FROM asked), v AS (SELECT DISTINCT unnest({WORDS('embedding_text')}) AS term FROM corpus), g AS (SELECT a.query_id, coalesce(f.share < 0.99, false) AS degraded FROM asked a LEFT JOIN (SELECT query_id, count(v.term) / count(*) AS share FROM w LEFT JOIN v USING (term) WHERE length(term) >= 2 GROUP BY query_id) f USING (query_id)), asked1 AS (SELECT * FROM asked JOIN g USING (query_id) WHERE NOT degraded), asked2 AS (SELECT * FROM asked JOIN g USING (query_id) WHERE degraded), "
    + _bm25_sql(WORDS, name="1") + ", " + _bm25_sql(WORDS, name="4", asked="asked1") + ", " + _bm25_sql(_mixed, name="3", asked="asked2") + " SELECT query_id, id, score, score AS word_score, rank, false AS degraded FROM r4 UNION ALL SELECT r3.query_id, r3.id, r3.score, coalesce(sc1.score, 0) AS word_score, rank, true FROM r3 LEFT JOIN sc1 USING (query_id, id)",
    "q_rrf_fuse": _TWO + f", f AS (SELECT query_id, id, round(sum(1 / (20 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM r UNION ALL SELECT query_id, id, rank FROM r2) GROUP BY ALL) SELECT * FROM (SELECT *, {_RANK.format('score')} AS rank FROM f) WHERE rank <= 10",
    "q_multi_query_merge": _TWO + f", f AS (SELECT query_id, id, round(sum(w / (20 + rank)), 9) AS score FROM (SELECT query_id, id, rank, 2.0 AS w FROM r UNION ALL SELECT query_id, id, rank, 1.0 FROM r2) GROUP BY ALL) SELECT * FROM (SELECT *, {_RANK.format('score')} AS rank FROM f) WHERE rank <= 10",
    "q_topic_postfilter_topup": _BASE + _bm25_sql(TOKENS, k=40) + ", x AS (SELECT r.*, domain, topic FROM r JOIN corpus USING (id) JOIN asked USING (query_id)), k AS (SELECT * FROM x WHERE rank <= 10 AND (topic IS NULL OR domain = topic)), m AS (SELECT x.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n, (SELECT count(*) FROM k WHERE k.query_id = x.query_id) AS have FROM x WHERE domain = topic AND rank > 10), "
    "y AS (SELECT query_id, id, score, 0 AS topped, rank AS old FROM k UNION ALL SELECT query_id, id, score, 1, rank FROM m WHERE n <= 5 - have) SELECT query_id, id, score, topped, row_number() OVER (PARTITION BY query_id ORDER BY topped, old) AS rank FROM y",
    "q_parent_collapse": _ONE + ", x AS (SELECT query_id, source || '|' || page AS parent_id, id, rank FROM r JOIN corpus USING (id)) SELECT query_id, parent_id, arg_min(id, rank) AS id, min(rank) AS rank FROM x GROUP BY ALL",
    "q_feature_rerank": _F + f", fs AS (SELECT query_id, id, rank, round({_SCORE}, 6) AS feature_score FROM f) SELECT query_id, id, feature_score, row_number() OVER (PARTITION BY query_id ORDER BY feature_score DESC, rank) AS new_rank FROM fs",
    "q_ltr_score": _F + f" SELECT query_id, id, round(1 / (1 + exp(-greatest(least({_Z}, 50), -50))), 6) AS learned FROM f",
    "q_training_matrix": _F + ", l AS (SELECT query_id, topic FROM asked) SELECT query_id, id, " + ", ".join(f"round({n}, 6) AS {n}" for n in rerank.FEATURES) + ", domain = topic AS label FROM f JOIN l USING (query_id)",
    "q_alpha_fusion": _RE + ", n AS (SELECT *, count(*) OVER w AS n, min(rerank) OVER w AS a, max(rerank) OVER w AS b FROM e WINDOW w AS (PARTITION BY query_id)), f AS (SELECT query_id, id, rank, round(0.5 * CASE WHEN b > a THEN (rerank - a) / (b - a) ELSE 0 END + 0.5 * CASE WHEN n > 1 THEN (n - rank + 1) / (n - 1) ELSE 1 END, 9) AS fused FROM n) SELECT query_id, id, fused, new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, rank) AS new_rank FROM f) WHERE new_rank <= 10",
    "q_margin_fusion": _RE + " SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round_even(rerank / 0.1, 0) DESC, rank) AS new_rank FROM e",
    "q_band_context": _ONE + ", x AS (SELECT query_id, id, rank, source, page FROM r JOIN corpus USING (id)) SELECT query_id, id, rank FROM x WHERE EXISTS (SELECT 1 FROM x b WHERE b.query_id = x.query_id AND b.rank = 1 AND b.source = x.source AND abs(b.page - x.page) BETWEEN 1 AND 3)",
    "q_near_dup_fold": _CAND + ", " + _FOLD.format(t=_comp("title"), rows="c") + " SELECT query_id, id, slot FROM fo",
    "q_hybrid_search": _HYBRID,
    "q_degraded_search": _DEGRADED,
    "q_dense_topk": _VEC + " SELECT query_id, id, score, rank FROM t",
    "q_relevance_gate": _VEC + " SELECT query_id, score, score < 0.45 AS refused FROM t WHERE rank = 1",
    "q_eval_metrics": _METRICS + " SELECT query_id, recall1, recall3, recall5, recall10, rr, ndcg10 FROM m",
    "q_eval_grouped": _METRICS + ", y AS (SELECT *, query_id % 2 AS half FROM m) SELECT label, half, count(*) AS queries, round(avg(recall1), 6) AS recall1, round(avg(recall10), 6) AS recall10, round(avg(rr), 6) AS rr, round(avg(ndcg10), 6) AS ndcg10 FROM y GROUP BY GROUPING SETS ((), (label), (half))",
    "q_grid_search": _VEC + ", g AS (SELECT * FROM (VALUES (1), (3), (5), (10)) a(depth), (VALUES (10), (20), (60)) b(constant)), y AS (SELECT depth, constant, query_id, max((label = want)::INT) AS hit, sum(CASE WHEN label = want THEN 1 / (constant + rank) ELSE 0 END) AS gain FROM t, g WHERE rank <= depth GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY recall DESC, gain DESC, depth, constant) AS rank FROM (SELECT depth, constant, round(sum(hit) / (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0), 6) AS recall, round(sum(gain), 6) AS gain FROM y GROUP BY ALL)",
    "q_ab_rank_diff": _TWO + " SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.id, b.id) AS id, a.rank AS rank_a, b.rank AS rank_b FROM (SELECT * FROM r WHERE rank <= 10) a FULL JOIN (SELECT * FROM r2 WHERE rank <= 10) b ON a.query_id = b.query_id AND a.id = b.id WHERE a.rank IS DISTINCT FROM b.rank",
    "q_threshold_gate": _METRICS + ", v AS (SELECT 'recall1' AS metric, round(avg(recall1), 6) AS value FROM m UNION ALL SELECT 'recall10', round(avg(recall10), 6) FROM m UNION ALL SELECT 'rr', round(avg(rr), 6) FROM m) SELECT g.metric, v.value, g.threshold FROM (VALUES ('recall1', 0.9), ('recall10', 0.0), ('rr', 0.99), ('answered', 0.5)) g(metric, threshold) LEFT JOIN v USING (metric) WHERE v.value IS NULL OR v.value < g.threshold",
}
QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
