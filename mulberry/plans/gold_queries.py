"""Queries over gold sets, caches, reports and whole profiles, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from mulberry.functions import text as T
from mulberry.operators import chunking, evaluation, gold, learner, lexical, memory, metrics, questions
from mulberry.plans import learner_queries, retrieval_queries, text_queries
from mulberry.plans.sql import INTENT, SPACES, strip
from mulberry.session import checkpointed
from mulberry.sources.tables import table

NOW = learner_queries.NOW


def _chunks(spark, d):
    element = F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("\n|")), "table").otherwise("text")
    return retrieval_queries._corpus(spark, d).select("id", "domain", "source", "page", "kind", "title", "text", F.concat_ws("|", "source", "page").alias("parent_id"), element.alias("element"))


def _evidence(spark, d):
    """One case for each page: its first chunk's first four and last two characters must be there."""
    first = _chunks(spark, d).groupBy("source", "page").agg(F.min_by("text", "id").alias("t"))
    bare = gold.bare(F.col("t"))
    return first.select(F.concat_ws("|", "source", "page").alias("case_id"), "source", "page", F.array(F.left(bare, F.lit(4)), F.right(bare, F.lit(2))).alias("must_contain"))


def q_relevant_parents(spark, d):
    found = gold.relevant_parents(_evidence(spark, d), _chunks(spark, d).withColumn("parent_id", F.col("id")))
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.min("parent_id").alias("first"))


def q_cases_on_tables(spark, d):
    return gold.cases_on_tables(_evidence(spark, d), _chunks(spark, d))


def q_keyword_coverage(spark, d):
    """The first five chunks of each source against the evidence of its pages."""
    results = lambda e: e.select("case_id", "source").distinct().join(_ranked_chunks(spark, d), "source").select("case_id", "rank", "text")
    evidence = _evidence(spark, d)
    return gold.keyword_coverage(results(evidence), evidence)


def _ranked_chunks(spark, d):
    return lexical.top_k(_chunks(spark, d).withColumn("score", -F.col("page")), 5, partition="source").select("source", "rank", "text")


def q_full_contract(spark, d):
    """All chat questions as cases, with the pages of their thread's number as evidence."""
    asked = table(spark, d, "question_signals")
    cases = asked.select("id", "question", F.coalesce("domain", F.lit("")).alias("topic"), T.query_intent(F.coalesce("question", F.lit(""))).alias("kind"))
    pages = _evidence(spark, d).withColumn("n", F.pmod(F.length("case_id") * 7 + F.col("page"), F.lit(50)))
    evidence = asked.select(F.col("id").alias("case_id"), F.pmod("id", F.lit(50)).cast("int").alias("n")).where("case_id % 3 > 0").join(pages.groupBy("n").agg(F.min(F.struct("source", "page", "must_contain")).alias("e")), "n")
    told = evidence.select("case_id", "e.source", "e.page", F.when(F.col("case_id") % 5 == 0, F.array(F.lit("没有这个词"))).otherwise(F.col("e.must_contain")).alias("must_contain"))
    return gold.contract(cases, told, _chunks(spark, d), table(spark, d, "topics")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def q_first_of_topic(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("domain"))
    ranked = retrieval_queries._vector_top(spark, d, 10).join(labels, "id")
    truth = labels.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("domain").alias("label"))
    return gold.first_of_topic(ranked, truth)


def q_conditional_means(spark, d):
    ranked, truth = retrieval_queries._judged(spark, d)
    told = evaluation.query_metrics(ranked, truth).withColumn("style", F.col("query_id") % 3)
    return gold.conditional_means(told, ["style"], {"recall1": F.col("recall1"), "recall5": F.col("recall5"), "rr_found": F.col("rr")}, {"rr_found": F.col("recall10") > 0})


def _pairs(spark, d):
    return retrieval_queries._candidates(spark, d).select("query_id", "id", "rank", gold.pair_key(F.lit("m"), F.col("query"), F.col("text")).alias("key"))


def q_uncached_pairs(spark, d):
    """Pairs a cache of every query's first ten lacks, and the scores of those it has."""
    pairs = checkpointed(_pairs(spark, d))  # the search runs once for both sides
    held = pairs.where("rank <= 10").select("key", (1 / F.col("rank")).alias("score"))
    told = gold.with_cached_scores(pairs, held, complete=False)
    return told.groupBy("query_id").agg(F.count(F.when(F.col("score").isNull(), 1)).alias("missing"), F.round(F.sum("score"), 6).alias("total"))


def q_page_snippets(spark, d):
    told = retrieval_queries._bm25(spark, d).select("query_id", "id", "rank").join(_chunks(spark, d).select("id", "source", "page"), "id")
    return gold.page_snippets(told, _chunks(spark, d)).select("query_id", "id", "rank", F.md5("snippet").alias("h"))


def q_proxy_vectors(spark, d):
    held = _chunks(spark, d).where("kind = 'courseware'").withColumn("vector", F.array(F.length("text")))
    found, _ = gold.proxy_vectors(held, _chunks(spark, d).where("kind <> 'courseware'"))
    return found.select("id", F.col("vector")[0].alias("v"))


def q_proxy_missing(spark, d):
    held = _chunks(spark, d).where("kind = 'courseware'").withColumn("vector", F.array(F.length("text")))
    return gold.proxy_vectors(held, _chunks(spark, d).where("kind <> 'courseware'"))[1].select("id")


def q_reused_vectors(spark, d):
    """Vectors (length and 1) of chunks with an even page are held; the others are made anew (length and 2)."""
    held = _chunks(spark, d).where("page % 2 = 0").select("id", F.when(F.col("page") % 4 == 0, "m").otherwise("old").alias("embedding_model"), F.array(F.length("text"), F.lit(1)).alias("vector"))
    told = gold.reused_vectors(_chunks(spark, d), held, "m", lambda c: c.select("id", F.array(F.length("text"), F.lit(2)).alias("vector")))
    return told.select("id", F.col("vector")[0].alias("n"), F.col("vector")[1].alias("way"))


def q_chunk_order(spark, d):
    return gold.in_order(chunking.deduplicated(table(spark, d, "kb_chunks"))).select("id", "position")


def _requests(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "").when(F.col("event_type") == "error", None).otherwise(F.col("event_type")).alias("intent"),
        (F.col("value") * 0.1).alias("route_ms"), F.when(F.col("event_type") != "error", F.col("value") * 0.3).alias("retrieval_ms"), F.when(F.col("event_type") == "click", F.col("value") * 0.6).alias("first_token_ms"),
        F.col("value").alias("total_ms"), k.alias("prompt_tokens"), (k * 2).alias("completion_tokens"),
    )


def q_request_report(spark, d):
    return metrics.request_report(_requests(spark, d))


def q_requests_by_intent(spark, d):
    return metrics.requests_by_intent(_requests(spark, d))


def q_structure_report(spark, d):
    return metrics.structure_report(_chunks(spark, d))


def _profile(spark, d):
    return learner.full_profile(table(spark, d, "attempts"), table(spark, d, "question_signals"), NOW, table(spark, d, "topics"))


def q_full_profile(spark, d):
    return _profile(spark, d).select("domain", "accuracy", "last_seen_days", "rating", "streak", "best_streak", "mastery", "weak")


def q_flagged_topics(spark, d):
    return learner.flagged_topics(learner_queries._profile(spark, d))


def q_summary(spark, d):
    return learner.summary(learner_queries._profile(spark, d), table(spark, d, "review_cards"), NOW)


def q_simulated_profile(spark, d):
    """A student of rising ability from topic to topic: accuracy of 200 simulated answers each."""
    able = table(spark, d, "topics").select("domain", (F.col("topic_no") * 0.09).alias("ability"))
    told = learner.simulated_attempts(able, 200, learner_queries.SEED, NOW)
    return learner.topic_accuracy(told).select("domain", "attempts", "correct", F.round((F.lit(NOW) - F.col("last_at")) / 86400.0, 6).alias("last_days"))


def q_round_text(spark, d):
    asked = table(spark, d, "question_signals")
    return asked.select("id", F.md5(memory.round_text(F.col("question"), F.concat(F.lit("答："), "question"), F.col("intent"))).alias("h"))


def q_redacted(spark, d):
    told = questions.redacted(table(spark, d, "questions"))
    return told.select("id", "source", "domain", F.md5("stem").alias("stem"), F.md5("options").alias("options"))


def q_generated_questions(spark, d):
    """The questions without topic as if generated: new ids, and those of the bank aren't taken again."""
    bank = table(spark, d, "questions")
    made = questions.generated(bank.where("domain is null").select("stem", "options", "answer", "analysis", F.lit("x").alias("domain")), int(NOW * 1000), "stem")
    return made.select("id", "source", "num", F.md5("stem").alias("h"))


_CHUNKS = f"(SELECT id, domain, source, page, kind, title, text, source || '|' || page AS parent_id, CASE WHEN contains(text, chr(10) || '|') THEN 'table' ELSE 'text' END AS element, lower(regexp_replace(text, '{SPACES}', '', 'g')) AS bare FROM (SELECT *, row_number() OVER () AS _ FROM (SELECT kb.id, kb.domain, kb.source, kb.page, kb.kind, regexp_extract(coalesce(kb.text, ''), '^([^\\n。，]{{1,30}})\\n', 1) AS title, coalesce(kb.text, '') AS text FROM kb_chunks kb)))"
_CASES = f"k AS {_CHUNKS}, e AS (SELECT source || '|' || page AS case_id, source, page, [left(arg_min(bare, id), 4), right(arg_min(bare, id), 2)] AS terms FROM k GROUP BY source, page)"
_HELD = "len(list_filter(terms, lambda t: contains(bare, t)))"
_CAND = retrieval_queries._CAND
_REQ = "q AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN '' WHEN 'error' THEN NULL ELSE event_type END AS intent, value * 0.1 AS route, CASE WHEN event_type <> 'error' THEN value * 0.3 END AS retr, CASE WHEN event_type = 'click' THEN value * 0.6 END AS first, value AS total, json_extract_string(props, '$.k')::INT AS k FROM events ORDER BY event_id DESC LIMIT 500)"
_P95 = "list_sort(list({c}) FILTER ({c} IS NOT NULL))"
_at95 = lambda c: f"round({_P95.format(c=c)}[least(floor(len({_P95.format(c=c)}) * 0.95), len({_P95.format(c=c)}) - 1)::INT + 1], 1)"
_PROFILE, _ELO = learner_queries._PROFILE, learner_queries._ELO

SQL = {
    "q_relevant_parents": f"WITH {_CASES} SELECT case_id, count(*) AS n, min(id) AS first FROM (SELECT DISTINCT case_id, id FROM e JOIN k USING (source, page) WHERE {_HELD} = len(terms)) GROUP BY case_id",
    "q_cases_on_tables": f"WITH {_CASES} SELECT DISTINCT case_id FROM e WHERE (source, page) IN (SELECT (source, page) FROM k WHERE element = 'table')",
    "q_keyword_coverage": f"WITH {_CASES}, r AS (SELECT * FROM (SELECT source, bare, row_number() OVER (PARTITION BY source ORDER BY page, id) AS n FROM k) WHERE n <= 5) SELECT case_id, round(max({_HELD} / len(terms)), 6) AS coverage FROM e JOIN r USING (source) GROUP BY case_id",
    "q_full_contract": f"WITH {_CASES}, c AS (SELECT id, question, coalesce(domain, '') AS topic, {INTENT.replace('question', chr(99) + 'oalesce(question, chr(32))')} AS kind FROM question_signals), p AS (SELECT *, (length(case_id) * 7 + page) % 50 AS n FROM e), b AS (SELECT n, min(struct_pack(source := source, page := page, terms := terms)) AS e FROM p GROUP BY n), "
    "v AS (SELECT c.id AS case_id, b.e.source AS source, b.e.page AS page, CASE WHEN c.id % 5 = 0 THEN ['没有这个词'] ELSE b.e.terms END AS terms FROM c JOIN b ON b.n = c.id % 50 WHERE c.id % 3 > 0), "
    f"w AS (SELECT DISTINCT case_id FROM v JOIN k USING (source, page) WHERE {_HELD} = len(terms)), "
    f"x AS (SELECT 'repeated_id' AS problem FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'empty_question' FROM c WHERE {strip('coalesce(question, chr(32))')} = '' UNION ALL SELECT 'unknown_topic' FROM c WHERE topic NOT IN (SELECT domain FROM topics) UNION ALL SELECT 'unknown_kind' FROM c WHERE kind NOT IN ('fact', 'definition', 'acronym', 'comparison', 'process', 'scenario', 'mechanism') "
    "UNION ALL SELECT 'no_evidence' FROM c WHERE id NOT IN (SELECT case_id FROM v) UNION ALL SELECT 'unresolved_evidence' FROM (SELECT DISTINCT case_id FROM v) WHERE case_id NOT IN (SELECT case_id FROM w) UNION ALL SELECT 'uncovered_topic' FROM topics WHERE domain NOT IN (SELECT topic FROM c)) SELECT problem, count(*) AS n FROM x GROUP BY problem",
    "q_first_of_topic": retrieval_queries._VEC + ", f AS (SELECT query_id, min(rank) AS f FROM t WHERE label = want GROUP BY query_id) SELECT label, count(*) AS queries, round(avg(CASE WHEN f <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN f <= 5 THEN 1.0 ELSE 0 END), 6) AS top5, round(avg(coalesce(1 / f, 0)), 6) AS mrr FROM embeddings LEFT JOIN f ON f.query_id = vec_id WHERE vec_id % 100 = 0 GROUP BY label",
    "q_conditional_means": retrieval_queries._METRICS + " SELECT query_id % 3 AS style, count(*) AS rows, round(avg(recall1), 6) AS recall1, round(avg(recall5), 6) AS recall5, round(avg(rr) FILTER (recall10 > 0), 6) AS rr_found FROM m GROUP BY query_id % 3",
    "q_uncached_pairs": _CAND + ", p AS (SELECT query_id, rank, 'm' || chr(31) || query || chr(31) || text AS key FROM c), h AS (SELECT key, max(1 / rank) AS score FROM p WHERE rank <= 10 GROUP BY key) SELECT query_id, count(*) FILTER (score IS NULL) AS missing, round(sum(score), 6) AS total FROM p LEFT JOIN h USING (key) GROUP BY query_id",
    "q_page_snippets": retrieval_queries._ONE + f", k AS {_CHUNKS}, l AS (SELECT source, page, arg_max(text, id) AS t FROM k GROUP BY ALL) SELECT query_id, r.id, rank, md5(replace(left(l.t, 260), chr(10), ' | ')) AS h FROM r JOIN k ON k.id = r.id JOIN l ON l.source = k.source AND l.page = k.page WHERE rank <= 5",
    "q_proxy_vectors": f"WITH k AS {_CHUNKS}, h AS (SELECT domain, source, page, arg_min(length(text), id) AS v FROM k WHERE kind = 'courseware' GROUP BY ALL) SELECT id, v FROM k JOIN h USING (domain, source, page) WHERE kind <> 'courseware'",
    "q_proxy_missing": f"WITH k AS {_CHUNKS} SELECT id FROM k a WHERE kind <> 'courseware' AND NOT EXISTS (SELECT 1 FROM k b WHERE b.kind = 'courseware' AND a.domain = b.domain AND a.source = b.source AND a.page = b.page)",
    "q_reused_vectors": "SELECT id, length(coalesce(text, '')) AS n, CASE WHEN page % 4 = 0 THEN 1 ELSE 2 END AS way FROM kb_chunks",
    "q_chunk_order": "SELECT id, row_number() OVER (ORDER BY domain NULLS FIRST, source NULLS FIRST, page NULLS FIRST, id) AS position FROM kb_chunks JOIN (" + text_queries.SQL["q_exact_dedup"] + ") USING (id)",
    "q_request_report": f"WITH {_REQ} SELECT count(*) AS requests, round(coalesce(avg(total), 0), 1) AS avg_total_ms, round(coalesce(avg(route), 0), 1) AS avg_route_ms, round(coalesce(avg(retr), 0), 1) AS avg_retrieval_ms, {_at95('first')} AS p95_first_token_ms, {_at95('total')} AS p95_total_ms, coalesce(sum(k), 0) AS total_prompt_tokens, coalesce(sum(2 * k), 0) AS total_completion_tokens FROM q",
    "q_requests_by_intent": f"WITH {_REQ} SELECT CASE intent WHEN '' THEN 'unknown' ELSE intent END AS intent, count(*) AS requests FROM q WHERE intent IS NOT NULL GROUP BY ALL",
    "q_structure_report": f"WITH k AS {_CHUNKS}, z AS (SELECT *, length(text) AS n, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}_]+', '', 'g') AS key FROM k) SELECT kind, count(*) AS chunks, count(DISTINCT parent_id) AS parents, round(count(*) / count(DISTINCT parent_id), 2) AS children_per_parent, round(avg(n), 1) AS mean, max(n) AS longest, median(n) AS median, list_sort(list(n))[floor((count(*) - 1) * 0.9)::INT + 1] AS p90, round(100 * avg((title <> '')::INT), 1) AS titled, round(100 * (1 - count(DISTINCT key) / count(*)), 2) AS duplicates FROM z GROUP BY kind",
    "q_full_profile": f"WITH RECURSIVE {_ELO}, {_PROFILE}, s2 AS ({learner_queries.SQL['q_streaks']}) SELECT f.domain, CASE WHEN attempts > 0 THEN round(correct / attempts, 4) END AS accuracy, round(({NOW} - l.last_at) / 86400, 6) AS last_seen_days, round(coalesce(elo, 1500), 1) AS rating, coalesce(streak, 0) AS streak, coalesce(best_streak, 0) AS best_streak, mastery, weak FROM f LEFT JOIN elo USING (domain) LEFT JOIN s2 USING (domain) LEFT JOIN (SELECT domain, max(answered_at) AS last_at FROM attempts GROUP BY domain) l USING (domain)",
    "q_flagged_topics": f"WITH {_PROFILE} SELECT 'weak' AS flag, domain FROM f WHERE weak UNION ALL SELECT 'review_due', domain FROM f WHERE due_for_review UNION ALL SELECT 'ask_unverified', domain FROM f WHERE ask_unverified",
    "q_summary": f"WITH {_PROFILE} SELECT sum(attempts)::BIGINT AS total_attempts, round(sum(correct) / sum(attempts), 4) AS total_accuracy, count_if(weak) AS weak_topics, count_if(due_for_review) AS due_topics, count_if(ask_unverified) AS unverified_topics, (SELECT count(*) FROM review_cards WHERE due <= {NOW}) AS due_cards FROM f",
    "q_simulated_profile": f"WITH s AS (SELECT domain, topic_no * 0.09::DOUBLE AS ability, unnest(range(1, 201)) AS k FROM topics) SELECT domain, count(*) AS attempts, count_if((('0x' || left(md5('{learner_queries.SEED}|' || domain || '|' || k), 8))::BIGINT + 1) / 4294967296.0 <= ability) AS correct, 1.0::DOUBLE AS last_days FROM s GROUP BY domain",
    "q_round_text": "SELECT id, md5('意图: ' || coalesce(intent, '') || chr(10) || '用户: ' || coalesce(question, '') || chr(10) || '助手: ' || coalesce('答：' || question, '')) AS h FROM question_signals",
    "q_redacted": "SELECT id, source, domain, md5(stem) AS stem, md5(options) AS options FROM questions",
    "q_generated_questions": f"SELECT 'ai_' || ({int(NOW * 1000)} + row_number() OVER (ORDER BY stem) - 1) AS id, 'AI生成' AS source, 0 AS num, md5(stem) AS h FROM questions WHERE domain IS NULL",
}
QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
