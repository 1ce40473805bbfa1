"""Queries over attempts, review cards, chat signals, requests and event windows, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mulberry.functions import text as T
from mulberry.operators import learner, memory, metrics, schedule
from mulberry.operators.learner import uniform_sample, weighted_sample
from mulberry.plans.sql import TOKENS
from mulberry.sources.tables import table
from mulberry.streaming import windows

NOW = 1_760_000_000.0
SEED = 11


def _attempts(spark, d):
    return table(spark, d, "attempts")


def _signals(spark, d):
    return table(spark, d, "question_signals")


def q_topic_accuracy(spark, d):
    return learner.topic_accuracy(_attempts(spark, d))


def q_ask_signals(spark, d):
    return learner.ask_signals(_signals(spark, d))


def q_elo_replay(spark, d):
    return learner.replay(_attempts(spark, d).where("domain is not null"), "domain")


def q_streaks(spark, d):
    return learner.streaks(_attempts(spark, d).where("domain is not null"), "domain")


def q_beta_mastery(spark, d):
    told = _attempts(spark, d).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("c"))
    c, wrong = F.col("c"), F.col("n") - F.col("c")
    return told.select("question_id", learner.mastery(c, wrong).alias("mastery"), F.round(learner.probability_below(c + 1, wrong + 1, 0.6), 6).alias("p_below"))


def q_confidence(spark, d):
    told = learner.topic_accuracy(_attempts(spark, d))
    c = learner.confidence(F.col("correct") + 1, F.col("attempts") - F.col("correct") + 1)
    return told.select("domain", F.round(c, 4).alias("confidence"), T.confidence_label(c).alias("label"))


def q_forgetting(spark, d):
    last = _attempts(spark, d).groupBy("question_id").agg(F.max("answered_at").alias("at"))
    days = (F.lit(NOW) - F.col("at")) / 86400.0
    s = F.round(learner.memory_strength(days), 6)
    return last.select("question_id", s.alias("strength"), (s <= 0.5).alias("due"))


def _profile(spark, d):
    return learner.topic_profile(_attempts(spark, d), _signals(spark, d), NOW, table(spark, d, "topics"))


def q_topic_profile(spark, d):
    p = _profile(spark, d)
    return p.select("*", learner.topic_status(p).alias("status"))


def q_profile_totals(spark, d):
    told = learner.topic_accuracy(_attempts(spark, d)).agg(F.sum("attempts").alias("attempts"), F.sum("correct").alias("correct"))
    return told.select("attempts", "correct", F.when(F.col("attempts") > 0, F.round(F.col("correct") / F.col("attempts"), 4)).alias("accuracy"))


def q_topic_weights(spark, d):
    return learner.topic_weights(table(spark, d, "topics"), _profile(spark, d), q_elo_replay(spark, d))


def q_weighted_pick(spark, d):
    return weighted_sample(table(spark, d, "part"), "p_partkey", "p_retailprice", 50, SEED).select("p_partkey", F.round("draw", 9).alias("draw"))


def q_uniform_pick(spark, d):
    return uniform_sample(table(spark, d, "part"), "p_partkey", 50, SEED).select("p_partkey")


def q_available_pool(spark, d):
    return learner.available_pool(table(spark, d, "questions"), _attempts(spark, d)).select("id")


def q_latest_wrong(spark, d):
    return learner.latest_wrong(_attempts(spark, d))


def q_recent_wrong(spark, d):
    return learner.recent_wrong(_attempts(spark, d), 50)


def q_attempted(spark, d):
    return _attempts(spark, d).groupBy("question_id").agg(F.max(F.col("correct").cast("int")).alias("ever_right"))


def q_fsrs_cards(spark, d):
    told = schedule.cards(_attempts(spark, d))
    return told.select("question_id", "state", "step", F.round("stability", 4).alias("stability"), F.round("difficulty", 4).alias("difficulty"), F.round("due", 2).alias("due"), "last_review", "reps", "lapses")


def q_due_cards(spark, d):
    return schedule.due_cards(table(spark, d, "review_cards"), NOW, 20).select("question_id", "due")


def q_card_counts(spark, d):
    due = F.col("due") <= NOW
    return table(spark, d, "review_cards").groupBy("state").agg(F.count(F.lit(1)).alias("cards"), F.count_if(due).alias("due"), F.sum("lapses").alias("lapses"))


def q_next_due(spark, d):
    """Due cards whose question is still available, in the order of due."""
    pool = learner.available_pool(table(spark, d, "questions"), _attempts(spark, d)).select(F.col("id").alias("question_id"))
    return table(spark, d, "review_cards").where(F.col("due") <= NOW).join(pool, "question_id", "left_semi").orderBy("due", "question_id").limit(20).select("question_id", "due")


def q_stratified_head(spark, d):
    """The first three questions of each topic."""
    w = Window.partitionBy("domain").orderBy("id")
    return table(spark, d, "questions").where("domain is not null").select("id", "domain", F.row_number().over(w).alias("n")).where("n <= 3")


def _rounds(spark, d):
    return _signals(spark, d).select("id", "thread_id", "question", F.concat(F.lit("答："), "question").alias("answer"), "intent", "created_at")


def q_threads(spark, d):
    return memory.threads(_rounds(spark, d))


def q_history(spark, d):
    return memory.messages(_rounds(spark, d), 9)


def q_short_context(spark, d):
    return memory.newest(_rounds(spark, d), 5).select("thread_id", "id", "age")


def q_memory_topk(spark, d):
    """For every question whose id is divisible by 100 the three rounds of its thread that share most of its tokens."""
    told = _signals(spark, d).where("thread_id is not null").select("id", "thread_id", F.array_distinct(T.tokens(F.coalesce("question", F.lit("")))).alias("t"))
    asked = told.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("thread_id").alias("query_thread"), F.explode("t").alias("term"))
    words = told.select("id", "thread_id", F.explode("t").alias("term"))
    shared = asked.join(words, (F.col("query_thread") == F.col("thread_id")) & (asked.term == words.term)).where("query_id <> id")
    scored = shared.groupBy("query_id", "query_thread", "id", "thread_id").agg(F.count(F.lit(1)).alias("score"))
    return memory.thread_matches(scored, 3).select("query_id", "id", "score", "rank")


def q_signals_by_intent(spark, d):
    named = F.when(F.col("intent") == "", "unknown").otherwise(F.col("intent"))
    return _signals(spark, d).where("intent is not null").groupBy(named.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _requests(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), "value")


def q_metrics_summary(spark, d):
    return metrics.request_summary(_requests(spark, d))


def q_pctl_rule1(spark, d):
    return metrics.percentile_rows(_requests(spark, d), "value", [0.5, 0.95, 0.99], metrics.rule_capped, 4)


def q_pctl_rule2(spark, d):
    return metrics.percentile_rows(_requests(spark, d), "value", [0.5, 0.9, 0.95], metrics.rule_inner, 4)


def q_structure_metrics(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    titled = F.coalesce("text", F.lit("")).rlike("^[^\n。，]{1,30}\n")
    return table(spark, d, "kb_chunks").groupBy("kind").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("source", "page").alias("parents"), F.round(F.avg(n), 6).alias("mean"), F.max(n).alias("longest"), F.round(100.0 * F.avg(titled.cast("int")), 6).alias("titled"), F.round(1 - F.count_distinct(F.md5("text")) / F.count(F.lit(1)), 6).alias("duplicates")
    )


def q_topic_kind_histogram(spark, d):
    return table(spark, d, "kb_chunks").groupBy("domain", "kind").agg(F.count(F.lit(1)).alias("n"))


def q_props_json(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"))


def q_rate_limit_fixed(spark, d):
    events = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return windows.denied(events, "user_id", F.col("t"), "t", 3, 86400)


def q_ttl_cache(spark, d):
    """Lookups of each user that a cache of a day answers."""
    events = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return windows.cache_hits(events, "user_id", "t", 86400)


def q_tumbling(spark, d):
    told = windows.tumbling_counts(table(spark, d, "events").select("ts", "event_type"), "ts", "event_type", "1 day")
    return told.withColumn("start", F.col("start").cast("timestamp_ntz"))


def q_session(spark, d):
    told = windows.sessions(table(spark, d, "events").select("ts", "user_id"), "ts", "user_id", "24 hours")
    return told.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


_ELO = "w AS (SELECT domain, row_number() OVER o AS i, count(*) OVER o AS n, sum(correct::INT) OVER o AS c, correct::INT AS ok FROM attempts WHERE domain IS NOT NULL WINDOW o AS (PARTITION BY domain ORDER BY answered_at, id ROWS UNBOUNDED PRECEDING)), e AS (SELECT domain, 0::BIGINT AS i, 1500.0::DOUBLE AS r FROM (SELECT DISTINCT domain FROM w) UNION ALL SELECT w.domain, w.i, e.r + 32 * (w.ok - 1 / (1 + pow(10.0, ((1500 + (w.c / w.n - 0.5) * 800) - e.r) / 400))) FROM e JOIN w ON w.domain = e.domain AND w.i = e.i + 1), elo AS (SELECT domain, round(arg_max(r, i), 4) AS elo FROM e GROUP BY domain)"
_TAIL = "list_sum(list_transform(range((c + 1)::BIGINT, (n + 2)::BIGINT), lambda j: exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * ln(0.6) + (n + 1 - j) * ln(0.4))))"
_PROFILE = (
    "a AS (SELECT domain, count(*) AS attempts, count_if(correct) AS correct, max(answered_at) AS last_at FROM attempts WHERE domain IS NOT NULL GROUP BY domain), s AS (SELECT domain, count(*) AS asks FROM question_signals WHERE domain IN (SELECT domain FROM topics) GROUP BY domain), "
    "b AS (SELECT coalesce(a.domain, s.domain) AS domain, coalesce(attempts, 0) AS attempts, coalesce(correct, 0) AS correct, coalesce(asks, 0) AS asks, last_at FROM a FULL JOIN s ON a.domain = s.domain), "
    f"p AS (SELECT domain, attempts, correct, asks, round((correct + 1) / (attempts + 2), 4) AS mastery, CASE WHEN attempts > 0 THEN round(least({_TAIL.replace('(c +', '(correct +').replace('n + ', 'attempts + ').replace('(n', '(attempts')}, 1), 6) END AS p_below, "
    f"CASE WHEN attempts > 0 THEN round(CASE WHEN {NOW} <= last_at THEN 1 ELSE pow(2, -(({NOW} - last_at) / 86400) / 7) END, 6) ELSE 1 END AS memory_strength, attempts < 2 AS insufficient FROM b), "
    "f AS (SELECT *, NOT insufficient AND coalesce(p_below, 0) > 0.7 AS weak, asks >= 3 AND insufficient AS ask_unverified, NOT insufficient AND memory_strength <= 0.5 AS due_for_review FROM p)"
)
_W = schedule.WEIGHTS
# the published formulas again, an answer a step
_FSRS = (
    "WITH RECURSIVE a AS (SELECT question_id AS q, row_number() OVER (PARTITION BY question_id ORDER BY answered_at, id) AS i, CASE WHEN correct THEN 3 ELSE 1 END AS g, correct AS ok, answered_at AS t FROM attempts WHERE question_id IS NOT NULL AND answered_at IS NOT NULL AND correct IS NOT NULL), "
    f"c(q, i, state, step, s, d, due, t, reps, lapses) AS (SELECT q, i, 1, ok::INT, CASE WHEN ok THEN {_W[2]} ELSE {_W[0]} END::DOUBLE, greatest(1, least(10, {_W[4]} - exp({_W[5]} * (g - 1)) + 1))::DOUBLE, t + CASE WHEN ok THEN 600 ELSE 60 END, t, 1::BIGINT, (NOT ok)::BIGINT FROM a WHERE i = 1 "
    "UNION ALL SELECT q, i, CASE WHEN graduated THEN 2 WHEN state = 2 THEN 3 ELSE state END, CASE WHEN graduated THEN NULL WHEN state = 2 OR NOT ok THEN 0 ELSE step + 1 END, s2, d2, "
    "t + CASE WHEN graduated THEN greatest(1, round(s2)) * 86400 WHEN state = 1 AND NOT ok THEN 60 ELSE 600 END, t, reps + 1, lapses + (NOT ok)::BIGINT FROM ("
    "SELECT *, ok AND (state = 2 OR state = 3 OR step >= 1) AS graduated, greatest(0.001, CASE WHEN days < 1 THEN s * CASE WHEN ok THEN greatest(1, gain) ELSE gain END "
    f"WHEN ok THEN s * (1 + exp({_W[8]}) * (11 - d) * pow(s, -{_W[9]}) * (exp({_W[10]} * (1 - recall)) - 1)) ELSE least({_W[11]} * pow(d, -{_W[12]}) * (pow(s + 1, {_W[13]}) - 1) * exp({_W[14]} * (1 - recall)), s / exp({_W[17]} * {_W[18]})) END) AS s2, "
    f"greatest(1, least(10, {_W[7]} * ({_W[4]} - exp({_W[5]} * 3) + 1) + (1 - {_W[7]}) * (d - {_W[6]} * (g - 3) * (10 - d) / 9))) AS d2 FROM ("
    f"SELECT a.q, a.i, a.g, a.ok, a.t, c.state, c.step, c.s, c.d, c.reps, c.lapses, greatest(0, (a.t - c.t) / 86400) AS days, exp({_W[17]} * (a.g - 3 + {_W[18]})) * pow(c.s, -{_W[19]}) AS gain, pow(1 + (pow(0.9, -1 / {_W[20]}) - 1) * greatest(0, (a.t - c.t) / 86400) / c.s, -{_W[20]}) AS recall FROM c JOIN a ON a.q = c.q AND a.i = c.i + 1))) "
    "SELECT q AS question_id, state, step, round(s, 4) AS stability, round(d, 4) AS difficulty, round(due, 2) AS due, t AS last_review, reps, lapses FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY i DESC) = 1"
)
_DRAW = f"(('0x' || left(md5('{SEED}|' || p_partkey), 8))::BIGINT + 1) / 4294967296.0"

_LIMITED = "WITH RECURSIVE t AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), f AS (SELECT user_id, i, ts AS start, 1 AS n FROM t WHERE i = 1 UNION ALL SELECT t.user_id, t.i, CASE WHEN t.ts - f.start >= INTERVAL 1 DAY THEN t.ts ELSE f.start END, CASE WHEN t.ts - f.start >= INTERVAL 1 DAY THEN 1 ELSE f.n + 1 END FROM f JOIN t ON t.user_id = f.user_id AND t.i = f.i + 1) "

SQL = {
    "q_topic_accuracy": "SELECT domain, count(*) AS attempts, count_if(correct) AS correct, max(answered_at) AS last_at FROM attempts WHERE domain IS NOT NULL GROUP BY domain",
    "q_ask_signals": "SELECT domain, count(*) AS asks, max(created_at) AS last_ask FROM question_signals WHERE domain IS NOT NULL GROUP BY domain",
    "q_elo_replay": f"WITH RECURSIVE {_ELO} SELECT * FROM elo",
    "q_streaks": "WITH w AS (SELECT domain, correct, row_number() OVER (PARTITION BY domain ORDER BY answered_at, id) AS i, row_number() OVER (PARTITION BY domain, correct ORDER BY answered_at, id) AS j, count(*) OVER (PARTITION BY domain) AS n FROM attempts WHERE domain IS NOT NULL), r AS (SELECT domain, i - j AS g, count(*) AS k, max(i) AS e, max(n) AS n FROM w WHERE correct GROUP BY ALL) SELECT d.domain, coalesce(max(CASE WHEN e = n THEN k END), 0) AS streak, coalesce(max(k), 0) AS best_streak FROM (SELECT DISTINCT domain FROM w) d LEFT JOIN r USING (domain) GROUP BY d.domain",
    "q_beta_mastery": f"WITH t AS (SELECT question_id, count(*) AS n, count_if(correct) AS c FROM attempts GROUP BY question_id) SELECT question_id, round((c + 1) / (n + 2), 4) AS mastery, round(least({_TAIL}, 1), 6) AS p_below FROM t",
    "q_confidence": "WITH RECURSIVE t AS (SELECT domain, count(*) AS n, count_if(correct) AS c FROM attempts WHERE domain IS NOT NULL GROUP BY domain), b(domain, n, c, p, lo, hi, i) AS (SELECT domain, n, c, p::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0 FROM t, (VALUES (0.05), (0.95)) v(p) "
    "UNION ALL SELECT domain, n, c, p, CASE WHEN f < p THEN m ELSE lo END, CASE WHEN f < p THEN hi ELSE m END, i + 1 FROM (SELECT *, 1 - list_sum(list_transform(range(0, (c + 1)::BIGINT), lambda j: exp(lgamma(n + 2) - lgamma(j + 1) - lgamma(n + 2 - j) + j * ln(m) + (n + 1 - j) * ln(1 - m)))) AS f FROM (SELECT *, (lo + hi) / 2 AS m FROM b WHERE i < 40))), "
    "q AS (SELECT domain, 1 - max((lo + hi) / 2) FILTER (p > 0.5) + max((lo + hi) / 2) FILTER (p < 0.5) AS c FROM b WHERE i = 40 GROUP BY domain) SELECT domain, round(greatest(least(c, 1), 0), 4) AS confidence, CASE WHEN c < 0.5 THEN 'low' WHEN c < 0.8 THEN 'medium' ELSE 'high' END AS label FROM q",
    "q_fsrs_cards": _FSRS,
    "q_forgetting": f"WITH t AS (SELECT question_id, ({NOW} - max(answered_at)) / 86400 AS days FROM attempts GROUP BY question_id), s AS (SELECT question_id, round(CASE WHEN days <= 0 THEN 1 ELSE pow(2, -days / 7) END, 6) AS strength FROM t) SELECT *, strength <= 0.5 AS due FROM s",
    "q_topic_profile": f"WITH {_PROFILE} SELECT *, CASE WHEN weak THEN 'weak' WHEN ask_unverified THEN 'ask_unverified' WHEN insufficient THEN 'insufficient' WHEN due_for_review THEN 'due' ELSE 'normal' END AS status FROM f",
    "q_profile_totals": "SELECT count(*) AS attempts, count_if(correct) AS correct, round(count_if(correct) / count(*), 4) AS accuracy FROM attempts WHERE domain IS NOT NULL",
    "q_topic_weights": f"WITH RECURSIVE {_ELO}, {_PROFILE}, t AS (SELECT t.domain, CASE WHEN f.attempts IS NULL THEN 0.5 ELSE greatest(0.1, (2000 - coalesce(elo, 1500)) / 2000) * CASE WHEN weak THEN 1.8 ELSE 1 END * CASE WHEN due_for_review THEN 1.3 ELSE 1 END END AS b, coalesce(asks, 0) >= 3 AND (coalesce(insufficient, true) OR coalesce(weak, false)) AS k FROM (SELECT DISTINCT domain FROM topics) t LEFT JOIN f USING (domain) LEFT JOIN elo USING (domain)), u AS (SELECT domain, CASE WHEN k THEN greatest(b, 0.5) * 1.5 ELSE b END AS w FROM t) SELECT domain, round(w, 6) AS weight, round(w / sum(w) OVER (), 6) AS share FROM u",
    "q_weighted_pick": f"SELECT p_partkey, round(draw, 9) AS draw FROM (SELECT p_partkey, -ln({_DRAW}) / p_retailprice AS draw FROM part WHERE p_retailprice > 0) ORDER BY part.draw, p_partkey LIMIT 50".replace("part.draw", "2"),
    "q_uniform_pick": f"SELECT p_partkey FROM part ORDER BY md5('{SEED}|' || p_partkey), p_partkey LIMIT 50",
    "q_available_pool": "WITH p AS (SELECT id FROM questions WHERE coalesce(answer, '') <> '' AND NOT coalesce(needs_review, false) AND coalesce(trim(dup_of, ' '), '') = ''), f AS (SELECT id FROM p WHERE id NOT IN (SELECT question_id FROM attempts WHERE correct AND question_id IS NOT NULL)) SELECT id FROM f UNION ALL SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM f)",
    "q_latest_wrong": "SELECT question_id, choice, answered_at FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS r FROM attempts WHERE NOT correct) WHERE r = 1",
    "q_recent_wrong": "WITH l AS (SELECT * FROM attempts WHERE NOT correct ORDER BY answered_at DESC, id DESC LIMIT 150), f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY answered_at DESC, id DESC) AS r FROM l) SELECT question_id, choice, answered_at FROM f WHERE r = 1 ORDER BY answered_at DESC, id DESC LIMIT 50",
    "q_attempted": "SELECT question_id, max(correct::INT) AS ever_right FROM attempts GROUP BY question_id",
    "q_due_cards": f"SELECT question_id, due FROM review_cards WHERE due <= {NOW} ORDER BY due, question_id LIMIT 20",
    "q_card_counts": f"SELECT state, count(*) AS cards, count_if(due <= {NOW}) AS due, sum(lapses) AS lapses FROM review_cards GROUP BY state",
    "q_next_due": f"WITH p AS (SELECT id FROM questions WHERE coalesce(answer, '') <> '' AND NOT coalesce(needs_review, false) AND coalesce(trim(dup_of, ' '), '') = ''), f AS (SELECT id FROM p WHERE id NOT IN (SELECT question_id FROM attempts WHERE correct AND question_id IS NOT NULL)), g AS (SELECT id FROM f UNION ALL SELECT id FROM p WHERE NOT EXISTS (SELECT 1 FROM f)) SELECT question_id, due FROM review_cards WHERE due <= {NOW} AND question_id IN (SELECT id FROM g) ORDER BY due, question_id LIMIT 20",
    "q_stratified_head": "SELECT * FROM (SELECT id, domain, row_number() OVER (PARTITION BY domain ORDER BY id) AS n FROM questions WHERE domain IS NOT NULL) WHERE n <= 3",
    "q_threads": "SELECT thread_id, max(created_at) AS last_at, count(*) AS rounds FROM question_signals WHERE thread_id IS NOT NULL GROUP BY thread_id ORDER BY last_at DESC, thread_id LIMIT 20",
    "q_history": "WITH a AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, id DESC) AS age FROM question_signals WHERE thread_id IS NOT NULL), m AS (SELECT thread_id, 'user' AS role, question AS content, 2 * age AS n FROM a UNION ALL SELECT thread_id, 'assistant', '答：' || question, 2 * age - 1 FROM a) SELECT * FROM m WHERE n <= 9",
    "q_short_context": "SELECT * FROM (SELECT thread_id, id, row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, id DESC) AS age FROM question_signals WHERE thread_id IS NOT NULL) WHERE age <= 5",
    "q_memory_topk": f"WITH t AS (SELECT id, thread_id, unnest(list_distinct({TOKENS('question')})) AS term FROM question_signals WHERE thread_id IS NOT NULL), s AS (SELECT q.id AS query_id, w.id, count(*) AS score FROM t q JOIN t w ON q.thread_id = w.thread_id AND q.term = w.term WHERE q.id % 100 = 0 AND q.id <> w.id GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3",
    "q_signals_by_intent": "SELECT CASE WHEN intent = '' THEN 'unknown' ELSE intent END AS kind, count(*) AS n FROM question_signals WHERE intent IS NOT NULL GROUP BY ALL",
    "q_metrics_summary": "WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 500), s AS (SELECT list_sort(list(value) FILTER (value IS NOT NULL)) AS v, count(*) AS n, coalesce(avg(value), 0) AS m, coalesce(sum(value), 0) AS t FROM l) SELECT n AS requests, round(m, 6) AS mean, round(v[least(floor(len(v) * 0.95), len(v) - 1)::INT + 1], 1) AS p95, round(t, 4) AS total FROM s",
    "q_pctl_rule1": "WITH v AS (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL) SELECT share::DOUBLE AS share, round(v[least(floor(len(v) * share::DOUBLE), len(v) - 1)::INT + 1], 4) AS value FROM v, (VALUES (0.5), (0.95), (0.99)) s(share)",
    "q_pctl_rule2": "WITH v AS (SELECT list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL) SELECT share::DOUBLE AS share, round(v[floor((len(v) - 1) * share::DOUBLE)::INT + 1], 4) AS value FROM v, (VALUES (0.5), (0.9), (0.95)) s(share)",
    "q_structure_metrics": "SELECT kind, count(*) AS chunks, count(DISTINCT (source, page)) AS parents, round(avg(length(coalesce(text, ''))), 6) AS mean, max(length(coalesce(text, ''))) AS longest, round(100.0 * avg(regexp_matches(coalesce(text, ''), '^[^\\n。，]{1,30}\\n')::INT), 6) AS titled, round(1 - count(DISTINCT md5(text)) / count(*), 6) AS duplicates FROM kb_chunks GROUP BY kind",
    "q_topic_kind_histogram": "SELECT domain, kind, count(*) AS n FROM kb_chunks GROUP BY ALL",
    "q_props_json": "SELECT event_type, count(k) AS n, sum(k) AS total FROM (SELECT event_type, json_extract_string(props, '$.k')::INT AS k FROM events) GROUP BY event_type",
    "q_rate_limit_fixed": _LIMITED + "SELECT user_id, count(*) AS hits, count_if(n > 3) AS denied FROM f GROUP BY user_id",
    "q_ttl_cache": _LIMITED + "SELECT user_id, count(*) AS lookups, count_if(n > 1) AS hits FROM f GROUP BY user_id",
    "q_tumbling": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "q_session": "WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER o < INTERVAL 1 DAY THEN 0 ELSE 1 END AS f FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM l) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, s",
}
QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
