"""Queries that put question banks together, train the ranking model and pick questions, with reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from mulberry.functions import text as T
from mulberry.operators import banks, catalog, exams, fusion, learner, ltr, rerank
from mulberry.plans import learner_queries, retrieval_queries
from mulberry.plans.sql import SPACES, strip
from mulberry.sources.tables import table


def _questions(spark, d):
    return table(spark, d, "questions")


def q_answer_key(spark, d):
    """Missing answers from the newest answered question with the same source and number among the attempts' right choices."""
    q = _questions(spark, d)
    right = table(spark, d, "attempts").where("correct").join(q.select(F.col("id").alias("question_id"), "source", "num"), "question_id")
    key = right.select("source", "num", T.choice_letters(F.col("choice")).alias("answer"), F.struct("answered_at", "id").alias("ord"))
    return banks.with_answer_key(q, key).select("id", "answer")


def q_analysis_backfill(spark, d):
    """Missing analyses from the question with the same number of the best-known source (the largest id)."""
    q = _questions(spark, d)
    given = q.where("length(analysis) > 10").select("num", "stem", "analysis", F.col("id").alias("ord"))
    filled, _ = banks.with_analyses(q, given)
    return filled.select("id", F.md5("analysis").alias("h"))


def q_analysis_conflicts(spark, d):
    q = _questions(spark, d)
    given = q.where("length(analysis) > 10").select("num", "stem", "analysis", F.col("id").alias("ord"))
    return banks.with_analyses(q, given)[1]


def q_same_number_merge(spark, d):
    return banks.merged_numbers(_questions(spark, d)).select("source", "num", "id", F.md5("stem").alias("h"))


def q_structural_ok(spark, d):
    return _questions(spark, d).select("id", banks.is_valid(F.coalesce("answer", F.lit("")), F.col("options")).alias("valid"))


def q_gold_contract(spark, d):
    cases = table(spark, d, "question_signals").select(F.col("question").alias("id"), "question", F.coalesce("domain", F.lit("")).alias("topic"))
    return banks.gold_problems(cases, table(spark, d, "topics")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def q_citation_support(spark, d):
    """Citations made from each chunk's source and page against the pages of its own source."""
    kb = table(spark, d, "kb_chunks")
    told = kb.select("id", F.concat(F.lit("答。\n【出处】《"), F.substring_index("source", "_", 1), F.lit("》第"), "page", F.lit("页；《别处》第1页")).alias("answer"), F.array(F.struct("source", "page")).alias("pages"))
    c = banks.citations(F.col("answer"))
    return told.select("id", F.size(c).alias("cited"), F.size(banks.supported(c, F.col("pages"))).alias("supported"))


def q_source_display(spark, d):
    """The first four sources of each topic's chunks as shown beside an answer."""
    told = table(spark, d, "kb_chunks").groupBy("domain").agg(F.array_sort(F.collect_set("source")).alias("s"))
    return told.select("domain", F.array_join(F.slice("s", 1, 4), "、").alias("sources"))


def q_next_question(spark, d):
    weights = learner_queries.q_topic_weights(spark, d).select("domain", "weight")
    return banks.next_question(_questions(spark, d), table(spark, d, "attempts"), table(spark, d, "review_cards"), weights, learner_queries.NOW, learner_queries.SEED)


def q_ltr_train(spark, d):
    """Each feature's coefficient after training on the candidates of the chat questions."""
    model = ltr.train(retrieval_queries.q_training_matrix(spark, d), rerank.FEATURES)
    rows = list(zip(model["features"], model["mean"], model["scale"], model["coef"]))
    return spark.createDataFrame(rows, "feature string, mean double, scale double, coef double")


def q_exam_questions(spark, d):
    """Questions in the lines of all documents, by how their answers are told."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\\r\\n|\\r|\\n")).alias("at", "line"))
    return exams.exam_questions(lines)


def q_exam_lines(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(exams.exam_line(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def q_cached_vectors(spark, d):
    """Texts that a cache of the even pages lacks are made (their length stands for a vector), each text once."""
    kb = table(spark, d, "kb_chunks").select("id", "page", F.coalesce("text", F.lit("")).alias("text"))
    key = F.md5(F.concat_ws("\x1f", F.lit("m"), F.lit("2"), F.col("text")))
    cache = kb.where("page % 2 = 0").select(key.alias("key"), F.array(F.length("text"), F.lit(1)).alias("vector")).distinct()
    told, _ = catalog.cached_or_made(kb, cache, lambda lacking: lacking.select("key", F.array(F.length("text"), F.lit(2)).alias("vector")), "m", 2)
    return told.select("id", F.col("vector")[0].alias("n"), F.col("vector")[1].alias("way"))


def q_scattered(spark, d):
    """Scores of every second candidate, put back by index."""
    told = retrieval_queries._candidates(spark, d).select("query_id", "id", F.col("rank").alias("index"))
    scores = told.where(F.col("index") % 2 == 0).select("query_id", "index", (1 / F.col("index")).alias("rerank"))
    return fusion.scattered(told, scores).select("query_id", "id", F.round("rerank", 6).alias("rerank"))


def q_ask_bonus(spark, d):
    """Topics asked about at least three times, with their attempts."""
    asks = learner.ask_signals(table(spark, d, "question_signals")).where("asks >= 3")
    told = learner.topic_accuracy(table(spark, d, "attempts")).select("domain", "attempts")
    return asks.select("domain", "asks").join(told, "domain", "left").select("domain", "asks", F.coalesce("attempts", F.lit(0)).alias("attempts"))


_HEAD = lambda c: f"left(regexp_replace(coalesce({c}, ''), '{SPACES}|[，。：:；;、（）().,．]', '', 'g'), 10)"
_GIVEN = "g AS (SELECT num, arg_max(stem, id) AS s, arg_max(analysis, id) AS a FROM questions WHERE length(analysis) > 10 GROUP BY num)"
_LETTERS = "array_to_string(list_sort(regexp_extract_all(upper(choice), '[ABCD]')), '')"

SQL = {
    "q_answer_key": f"WITH r AS (SELECT q.source, q.num, {_LETTERS} AS answer, row_number() OVER (PARTITION BY q.source, q.num ORDER BY answered_at DESC, a.id DESC) AS n FROM attempts a JOIN questions q ON q.id = a.question_id WHERE a.correct) SELECT q.id, coalesce(nullif(trim(q.answer, ' '), ''), r.answer) AS answer FROM questions q LEFT JOIN r ON r.source = q.source AND r.num = q.num AND r.n = 1",
    "q_analysis_backfill": f"WITH {_GIVEN} SELECT id, md5(CASE WHEN coalesce(analysis, '') = '' AND {_HEAD('stem')} = {_HEAD('s')} THEN a ELSE analysis END) AS h FROM questions LEFT JOIN g USING (num)",
    "q_analysis_conflicts": f"WITH {_GIVEN} SELECT id, num FROM questions JOIN g USING (num) WHERE {_HEAD('stem')} <> {_HEAD('s')}",
    "q_same_number_merge": "SELECT source, num, min(id) AS id, md5(string_agg(coalesce(stem, ''), '' ORDER BY id)) AS h FROM questions GROUP BY source, num, CASE WHEN num IS NULL THEN id END",
    "q_structural_ok": f"WITH v AS (SELECT id, answer, list_transform(json_keys(options), lambda k: json_extract_string(options, '$.' || k)) AS v FROM questions) SELECT id, regexp_matches({strip(chr(99) + 'oalesce(answer, ' + chr(39) * 2 + ')')}, '^[ABCD]$') AND len(v) = 4 AND len(list_distinct(list_filter(v, lambda x: trim(x, ' ') <> ''))) = 4 AS valid FROM v",
    "q_gold_contract": "WITH c AS (SELECT question AS id, question, coalesce(domain, '') AS topic FROM question_signals), p AS (SELECT 'repeated_id' AS problem FROM (SELECT id FROM c GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'empty_question' FROM c WHERE coalesce(trim(question, ' '), '') = '' UNION ALL SELECT 'unknown_topic' FROM c WHERE topic NOT IN (SELECT domain FROM topics) UNION ALL SELECT 'uncovered_topic' FROM topics WHERE domain NOT IN (SELECT topic FROM c)) SELECT problem, count(*) AS n FROM p GROUP BY problem",
    "q_citation_support": "SELECT id, 2 AS cited, (page IS NOT NULL)::INT + (page = 1 AND contains(source, '别处'))::INT AS supported FROM kb_chunks",
    "q_source_display": "SELECT domain, array_to_string(list_slice(list_sort(list(DISTINCT source)), 1, 4), '、') AS sources FROM kb_chunks GROUP BY domain",
    "q_next_question": learner_queries.SQL["q_topic_weights"].replace(" SELECT domain, round(w, 6) AS weight, round(w / sum(w) OVER (), 6) AS share FROM u", "")
    + ", wt AS (SELECT domain, round(w, 6) AS weight FROM u), p0 AS (SELECT id, domain FROM questions WHERE coalesce(answer, '') <> '' AND NOT coalesce(needs_review, false) AND coalesce(trim(dup_of, ' '), '') = ''), p1 AS (SELECT * FROM p0 WHERE id NOT IN (SELECT question_id FROM attempts WHERE correct AND question_id IS NOT NULL)), p2 AS (SELECT * FROM p1 UNION ALL SELECT * FROM p0 WHERE NOT EXISTS (SELECT 1 FROM p1)), "
    f"du AS (SELECT question_id AS id FROM review_cards WHERE due <= {learner_queries.NOW} AND question_id IN (SELECT id FROM p2) ORDER BY due, question_id LIMIT 20), tp AS (SELECT domain FROM wt WHERE weight > 0 AND domain IN (SELECT domain FROM p2) ORDER BY -ln((('0x' || left(md5('{learner_queries.SEED}|' || domain), 8))::BIGINT + 1) / 4294967296.0) / weight, domain LIMIT 1), "
    f"al AS (SELECT id, 0 AS way FROM du UNION ALL SELECT id, 1 FROM p2 WHERE domain IN (SELECT domain FROM tp)) SELECT id, way FROM al ORDER BY way, md5('{learner_queries.SEED}|' || id), id LIMIT 1",
    "q_exam_lines": f"SELECT CASE WHEN regexp_matches(l, '{exams.KEY_LINE}') THEN 'key' WHEN regexp_matches(l, '{exams.KEY_RUN}') THEN 'keys' WHEN regexp_matches(l, '{exams.NOTE_LINE}') THEN 'note' WHEN regexp_matches(l, '{exams.OPTION_LINE}') THEN 'option' WHEN regexp_matches(l, '{exams.NUMBER_LINE}') THEN 'number' ELSE 'text' END AS kind, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY ALL",
    "q_cached_vectors": "SELECT k.id, length(coalesce(text, '')) AS n, CASE WHEN coalesce(text, '') IN (SELECT coalesce(text, '') FROM kb_chunks WHERE page % 2 = 0) THEN 1 ELSE 2 END AS way FROM kb_chunks k",
    "q_scattered": retrieval_queries._CAND + " SELECT query_id, id, CASE WHEN rank % 2 = 0 THEN round(1 / rank, 6) ELSE 0.0 END AS rerank FROM c",
    "q_ask_bonus": "WITH s AS (SELECT domain, count(*) AS asks FROM question_signals WHERE domain IS NOT NULL GROUP BY domain HAVING count(*) >= 3) SELECT s.domain, asks, coalesce(a.n, 0) AS attempts FROM s LEFT JOIN (SELECT domain, count(*) AS n FROM attempts GROUP BY domain) a ON a.domain = s.domain",
}
QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
