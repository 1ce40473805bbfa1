"""Queries over text expressions and question banks, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from mulberry.functions import text as T
from mulberry.operators import catalog, chunking, dense, questions
from mulberry.plans.sql import CHOICE, INTENT, LEVELS, REWRITTEN, SPACES, TOKENS, any_of, strip, words_hit
from mulberry.sources.tables import table


def _kb(spark, d):
    return table(spark, d, "kb_chunks")


def _signals(spark, d):
    return table(spark, d, "question_signals")


def _questions(spark, d):
    return table(spark, d, "questions")


def q_clean_text(spark, d):
    return _kb(spark, d).select("id", F.md5(T.clean_text(F.col("text"))).alias("cleaned"), F.length(T.clean_text(F.col("text"))).alias("n"))


def q_version(spark, d):
    return _kb(spark, d).groupBy("source", T.version_of(F.col("source")).alias("version"), questions.topic_of_file(F.col("source")).alias("topic")).agg(F.count(F.lit(1)).alias("chunks"))


def q_normalise(spark, d):
    s = F.coalesce("stem", F.lit(""))
    return _questions(spark, d).select("id", T.match_form(s).alias("match_form"), T.compact(s).alias("compact"), F.md5(T.content_key(s)).alias("content"))


def q_acronyms(spark, d):
    return _questions(spark, d).select(F.explode(T.acronyms(F.col("stem"))).alias("acronym")).groupBy("acronym").agg(F.count(F.lit(1)).alias("n"))


def q_levels(spark, d):
    told = _kb(spark, d).select("id", F.explode(F.regexp_extract_all("text", F.lit("[第一二三四五六七八九十0-9]{1,5}级"), F.lit(0))).alias("level"))
    return told.select("id", "level", T.level_numbers(F.col("level")).alias("normal")).groupBy("level", "normal").agg(F.count(F.lit(1)).alias("n"))


def q_query_rewrite(spark, d):
    return _signals(spark, d).select("id", T.rewritten(F.col("question")).alias("query"))


def q_query_intent(spark, d):
    q = F.col("question")
    return _signals(spark, d).select("id", T.query_intent(q).alias("kind"), T.learned_ranking_applies(q, "process, fact").alias("learned"))


def q_topic_classify(spark, d):
    text = F.concat_ws(" ", "stem", F.array_join(F.map_values(F.from_json("options", "map<string,string>")), " "), "analysis")
    return table(spark, d, "questions", wide=True).select("id", questions.topic_by_words(text).alias("topic"))


def q_choice_grade(spark, d):
    told = questions.graded(table(spark, d, "attempts"), _questions(spark, d))
    return told.groupBy("correct", F.col("right").alias("graded")).agg(F.count(F.lit(1)).alias("n"))


def q_line_classify(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''").groupBy(T.line_kind(F.col("line")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def q_stable_id(spark, d):
    return _kb(spark, d).select("id", T.stable_id("chunk", F.col("source"), F.col("page"), F.col("text")).alias("stable_id"))


def q_embedding_text(spark, d):
    title = F.regexp_extract(F.coalesce("text", F.lit("")), "^([^\n。，]{1,30})\n", 1)
    return _kb(spark, d).select("id", F.md5(T.embedding_text(F.col("domain"), title, F.col("text"))).alias("h"))


def q_hash_embed(spark, d):
    return dense.hash_embedding(_signals(spark, d), "id", "question")


def q_token_stats(spark, d):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents", wide=True).select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("kinds"))


def q_strip_repeated_lines(spark, d):
    told = chunking.drop_repeated_lines(_kb(spark, d), share=0.01)
    return told.select("source", "id", F.md5("text").alias("h"))


def q_title_ffill(spark, d):
    title = F.regexp_extract(F.coalesce("text", F.lit("")), "^([^\n。，]{1,30})\n", 1)
    told = _kb(spark, d).select("id", "source", "page", title.alias("title"))
    return chunking.carried_forward(told, "source", "page", "id", "title").select("id", "title")


def q_plain_windows(spark, d):
    return chunking.plain_windows(table(spark, d, "documents").withColumnRenamed("doc_id", "id"))


def q_fixed_chunks(spark, d):
    return chunking.fixed_chunks(table(spark, d, "documents").withColumnRenamed("doc_id", "id")).select("id", "n", "start", "end", F.md5("text").alias("h"))


def q_structured_chunks(spark, d):
    return chunking.structured_chunks(table(spark, d, "kb_chunks", wide=True))


def q_legacy_chunks(spark, d):
    return chunking.legacy_chunks(_kb(spark, d)).select("id", "n", F.md5("text").alias("h"))


def q_exact_dedup(spark, d):
    return chunking.deduplicated(_kb(spark, d)).select("id")


def q_prefix_dup_of(spark, d):
    return questions.prefix_duplicates(_questions(spark, d))


def q_near_dup_ratio(spark, d):
    return questions.similar_stems(_questions(spark, d))


def q_self_check(spark, d):
    return questions.self_check(_questions(spark, d))


def q_parse_failures(spark, d):
    return questions.parse_failures(_questions(spark, d))


def q_bank_split(spark, d):
    told = questions.banks(_questions(spark, d).select("id", "source", "num"), "source", ["id"], "num")
    return told.select("id", "bank")


def q_question_rows(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    told = questions.continued_rows(lines, "doc_id", "at", "line")
    return told.select("doc_id", "item", F.md5("text").alias("h"))


def q_inline_answer(spark, d):
    told = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = told.select("doc_id", questions.answer_at_end(F.col("line")).alias("answer")).where("answer <> ''")
    return found.groupBy("doc_id", "answer").agg(F.count(F.lit(1)).alias("n"))


def q_bank_views(spark, d):
    told = _questions(spark, d).where("not needs_review and domain is not null").select(F.trim("domain").alias("domain"))
    return told.where("domain <> ''").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def q_insert_if_absent(spark, d):
    held = _questions(spark, d)
    batch = table(spark, d, "attempts").where("question_id is not null").select(F.col("question_id").alias("id"), F.col("id").alias("ord"), "choice")
    return catalog.new_rows(batch, held, "id", "ord").select("id", "ord", "choice")


def q_missing_vectors(spark, d):
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    return catalog.missing_vectors(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"), held)


def q_manifest_check(spark, d):
    names = {"questions": 1200, "kb_chunks": 600, "topics": 10, "publishers": 12, "region": 6}
    return catalog.manifest_problems({n: table(spark, d, n) for n in names}, names)


_TITLE = "regexp_extract(coalesce(text, ''), '^([^\\n。，]{1,30})\\n', 1)"
_CLEAN = strip("regexp_replace(regexp_replace(text, '[ \\t\\x{3000}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")
_MATCH = f"regexp_replace(coalesce(stem, ''), '{SPACES}|[，。：:；;、（）().,．]', '', 'g')"
_FILE_TOPIC = "CASE " + " ".join(f"WHEN contains(source, '{p}') THEN '{t}'" for p, t in questions.FILE_TOPICS) + " ELSE '未分类' END"
_HITS = ", ".join(f"({words_hit('x', w)}, {-i}, '{t}')" for i, (t, w) in enumerate(questions.TOPIC_WORDS))
_OPTION_KEYS = "CASE WHEN json_valid(options) THEN json_keys(options) ELSE []::VARCHAR[] END"
_INTENT = INTENT
# the end of a window: behind the last mark, tried in order, of its last two fifths
_MARK = lambda m: f"length(substr(text, {{a}} + 1, 300)) - instr(reverse(substr(text, {{a}} + 1, 300)), {m})"
_HAS = lambda m: f"instr(reverse(substr(text, {{a}} + 1, 300)), {m}) > 0 AND {_MARK(m)} >= 180"
_CUT = "CASE WHEN {a} + 300 >= length(text) THEN length(text) " + " ".join(f"WHEN {_HAS(m)} THEN {{a}} + {_MARK(m)} + 1" for m in ("'。'", "'！'", "'？'", "chr(10)")) + " ELSE {a} + 300 END"
LEVEL_ANY = LEVELS("level")

SQL = {
    "q_clean_text": f"SELECT id, md5(c) AS cleaned, length(c) AS n FROM (SELECT id, {_CLEAN} AS c FROM kb_chunks)",
    "q_version": f"SELECT source, regexp_extract(source, '{T.VERSION}') AS version, {_FILE_TOPIC} AS topic, count(*) AS chunks FROM kb_chunks GROUP BY ALL",
    "q_normalise": f"SELECT id, {_MATCH} AS match_form, regexp_replace(lower(coalesce(stem, '')), '[^一-鿿A-Za-z0-9]', '', 'g') AS compact, md5(regexp_replace(lower(coalesce(stem, '')), '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS content FROM questions",
    "q_acronyms": f"SELECT acronym, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(stem, '{T.ACRONYM}'))) AS acronym FROM questions) GROUP BY ALL",
    "q_levels": f"SELECT level, {LEVEL_ANY} AS normal, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[第一二三四五六七八九十0-9]{{1,5}}级')) AS level FROM kb_chunks) GROUP BY ALL",
    "q_query_rewrite": f"SELECT id, {REWRITTEN.format(q='question')} AS query FROM question_signals",
    "q_query_intent": f"SELECT id, k AS kind, k IN ('process', 'fact') AS learned FROM (SELECT id, {_INTENT} AS k FROM question_signals)",
    "q_topic_classify": f"WITH t AS (SELECT id, lower(concat_ws(' ', stem, array_to_string(list_transform(json_keys(options), lambda k: json_extract_string(options, '$.' || k)), ' '), analysis)) AS x FROM questions), h AS (SELECT id, unnest([{_HITS}]) AS s FROM t) SELECT id, CASE WHEN max(s)[1] > 0 THEN max(s)[3] END AS topic FROM h GROUP BY id",
    "q_choice_grade": f"SELECT a.correct, CASE WHEN q.id IS NOT NULL THEN {CHOICE('a.choice')} = {CHOICE('q.answer')} END AS graded, count(*) AS n FROM attempts a LEFT JOIN questions q ON q.id = a.question_id GROUP BY ALL",
    "q_line_classify": f"SELECT CASE WHEN regexp_matches(l, '{T.PAGE_LINE}') THEN 'page_number' WHEN regexp_matches(l, '{T.BULLET_LINE}') THEN 'bullet' WHEN right(l, 1) IN ('。', '！', '？', '!', '?', '；', ';', '：', ':') THEN 'sentence' WHEN length(l) <= 24 OR length(l) <= 45 AND regexp_matches(l, '{T.HEADING_LINE}') THEN 'title' ELSE 'text' END AS kind, count(*) AS n FROM (SELECT {strip('line')} AS l, line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE line <> '' GROUP BY ALL",
    "q_stable_id": "SELECT id, 'chunk_' || left(sha256(coalesce(source, '') || chr(31) || coalesce(page::VARCHAR, '') || chr(31) || coalesce(text, '')), 20) AS stable_id FROM kb_chunks",
    "q_embedding_text": f"SELECT id, md5(concat_ws(chr(10), '知识域：' || coalesce(domain, ''), CASE WHEN {_TITLE} <> '' THEN '知识点：' || {_TITLE} END, text)) AS h FROM kb_chunks",
    "q_hash_embed": "WITH c AS (SELECT id, unnest(string_split(question, '')) AS ch FROM question_signals), b AS (SELECT id, ('0x' || substr(md5(ch), 1, 2))::INT AS bin, count(*) AS n FROM c WHERE ch <> '' GROUP BY ALL) SELECT id, bin, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS weight FROM b",
    "q_token_stats": f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS kinds FROM (SELECT doc_id, {TOKENS(chr(116) + 'ext')} AS t FROM documents)",
    "q_strip_repeated_lines": r"WITH l AS (SELECT source, id, line, pos, trim(line) AS told FROM (SELECT source, id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM kb_chunks)), z AS (SELECT source, count(DISTINCT id) AS pages FROM kb_chunks GROUP BY source), o AS (SELECT l.source, told FROM l JOIN z USING (source) WHERE told <> '' AND length(told) <= 60 GROUP BY l.source, told, pages HAVING count(DISTINCT id) >= greatest(3, ceil(0.01 * pages))) SELECT source, id, md5(string_agg(line, chr(10) ORDER BY pos)) AS h FROM l WHERE NOT regexp_matches(told, '^(?:[-—–]\s*)?(?:第\s*)?\d{1,4}(?:\s*页)?(?:\s*[-—–])?$') AND NOT EXISTS (SELECT 1 FROM o WHERE o.source = l.source AND o.told = l.told) GROUP BY ALL",
    "q_title_ffill": f"SELECT id, last_value(t IGNORE NULLS) OVER (PARTITION BY source ORDER BY page, id ROWS UNBOUNDED PRECEDING) AS title FROM (SELECT id, source, page, nullif({_TITLE}, '') AS t FROM kb_chunks)",
    "q_plain_windows": "SELECT id, s AS start, length(substr(text, s + 1, 300)) AS size, md5(substr(text, s + 1, 300)) AS hash FROM (SELECT doc_id AS id, text, unnest(range(0, greatest(length(text) - 101, 0) + 1, 200)) AS s FROM documents WHERE text <> '')",
    "q_legacy_chunks": f"WITH RECURSIVE p AS (SELECT id, {_CLEAN} AS c FROM kb_chunks WHERE length(text) >= 10), u AS (SELECT id, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM (SELECT id, regexp_extract_all(c, '{T.SENTENCES}') AS x FROM p WHERE length(c) > 1200)), "
    "g AS (SELECT id, i, s, 1 AS g, length(s) AS n FROM u WHERE i = 1 UNION ALL SELECT u.id, u.i, u.s, CASE WHEN g.n + length(u.s) > 1200 THEN g.g + 1 ELSE g.g END, CASE WHEN g.n + length(u.s) > 1200 THEN length(u.s) ELSE g.n + length(u.s) END FROM g JOIN u ON u.id = g.id AND u.i = g.i + 1), "
    f"t AS (SELECT id, g, string_agg(s, '' ORDER BY i) AS t FROM g GROUP BY id, g), h AS (SELECT id, g, a, {strip('substr(t, a, 1200)')} AS t FROM (SELECT id, g, t, unnest(range(1, length(t) + 1, 1200)) AS a FROM t)), "
    "o AS (SELECT id, 1 AS g, 1 AS a, c AS t FROM p WHERE length(c) <= 1200 UNION ALL SELECT * FROM h WHERE t <> '') SELECT id, row_number() OVER (PARTITION BY id ORDER BY g, a) - 1 AS n, md5(t) AS h FROM o",
    "q_fixed_chunks": "WITH RECURSIVE d AS (SELECT doc_id::VARCHAR AS id, text, length(text) AS n FROM documents WHERE text <> ''), "
    "w(id, k, a, b) AS (SELECT id, 0, 0, " + _CUT.format(a="0") + " FROM d UNION ALL SELECT d.id, k + 1, w.b - 100, " + _CUT.format(a="(w.b - 100)") + " FROM w JOIN d USING (id) WHERE w.b - 100 > w.a AND w.b - 100 < d.n) "
    "SELECT id, k AS n, a AS start, b AS \"end\", md5(substr(text, a + 1, b - a)) AS h FROM w JOIN d USING (id)",
    "q_exact_dedup": "WITH k AS (SELECT id, length(text) AS n, regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+', '', 'g') AS key, CASE WHEN kind = 'summary' THEN 3 WHEN contains(lower(source), 'v4.2') THEN 2 ELSE 1 END AS p FROM kb_chunks) SELECT id FROM k WHERE length(key) < 6 UNION ALL SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY key ORDER BY p DESC, n DESC, id) AS r FROM k WHERE length(key) >= 6) WHERE r = 1",
    "q_prefix_dup_of": f"WITH k AS (SELECT id, left({_MATCH}, 40) AS key FROM questions), f AS (SELECT id, min(id) OVER (PARTITION BY key) AS first_id FROM k WHERE key <> '') SELECT * FROM f WHERE id <> first_id",
    "q_self_check": f"WITH t AS (SELECT source, coalesce(nullif(trim(domain, ' '), ''), '未分类') AS topic, coalesce(answer, '') AS a, needs_review, dup_of, {_OPTION_KEYS} AS k FROM questions) SELECT source, topic, count(*) AS total, count_if(trim(a, ' ') = '') AS no_answer, count_if(topic = '未分类') AS no_domain, count_if(coalesce(needs_review, false) OR topic = '未分类' OR len(list_filter(regexp_extract_all(a, '[A-Z]'), lambda x: NOT list_contains(k, x))) > 0) AS needs_review, count_if(coalesce(trim(dup_of, ' '), '') <> '') AS duplicates FROM t GROUP BY GROUPING SETS ((), (source), (topic))",
    "q_parse_failures": f"SELECT id, 'empty_stem' AS reason FROM questions WHERE coalesce(trim(stem, ' '), '') = '' UNION ALL SELECT id, 'few_options' FROM questions WHERE len({_OPTION_KEYS}) < 2 UNION ALL SELECT id, 'no_answer' FROM questions WHERE coalesce(trim(answer, ' '), '') = ''",
    "q_bank_split": "SELECT id, 1 + sum(n) OVER (PARTITION BY source ORDER BY id ROWS UNBOUNDED PRECEDING) AS bank FROM (SELECT id, source, CASE WHEN num < lag(num) OVER (PARTITION BY source ORDER BY id) THEN 1 ELSE 0 END AS n FROM questions)",
    "q_question_rows": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), i AS (SELECT doc_id, line, pos, sum(regexp_matches(line, '^\s*\d{1,4}\s*[、.．]')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS item FROM l) SELECT doc_id, item, md5(string_agg(line, '' ORDER BY pos)) AS h FROM i WHERE item > 0 GROUP BY ALL",
    "q_inline_answer": r"SELECT doc_id, answer, count(*) AS n FROM (SELECT doc_id, regexp_extract(regexp_replace(line, '[\s：:，,]+$', ''), '([A-D]{1,4})$', 1) AS answer FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)) WHERE answer <> '' GROUP BY ALL",
    "q_bank_views": "SELECT trim(domain, ' ') AS domain, count(*) AS n FROM questions WHERE NOT needs_review AND trim(domain, ' ') <> '' GROUP BY ALL",
    "q_insert_if_absent": "SELECT question_id AS id, id AS ord, choice FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY id) AS r FROM attempts WHERE question_id IS NOT NULL) WHERE r = 1 AND question_id NOT IN (SELECT id FROM questions)",
    "q_missing_vectors": "SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "q_manifest_check": "SELECT * FROM (SELECT 'questions' AS asset, 1200 AS expected, (SELECT count(*) FROM questions) AS found UNION ALL SELECT 'kb_chunks', 600, (SELECT count(*) FROM kb_chunks) UNION ALL SELECT 'topics', 10, (SELECT count(*) FROM topics) UNION ALL SELECT 'publishers', 12, (SELECT count(*) FROM publishers) UNION ALL SELECT 'region', 6, (SELECT count(*) FROM region)) WHERE found <> expected",
}
QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
