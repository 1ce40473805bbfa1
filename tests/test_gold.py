import pytest
from pyspark.sql import functions as F

from mulberry.config import DEFAULTS, Settings
from mulberry.operators import catalog, fusion, gold, learner, memory, metrics, questions, retrieve, tables

CHUNKS = "id string, domain string, source string, page int, text string, element string"
EVIDENCE = "case_id string, source string, page int, must_contain array<string>"


def chunks(spark):
    return spark.createDataFrame([("a", "t", "s", 1, "访问 控制\nRBAC", "text"), ("b", "t", "s", 1, "别的", "table"), ("c", "u", "s", 2, None, "text"), ("d", "u", None, None, "访问控制rbac", "text")], CHUNKS)


def evidence(spark):
    return spark.createDataFrame([("1", "s", 1, ["访问控制", "rbac"]), ("2", "s", 2, ["x"]), ("3", "z", 9, ["x"]), ("4", "s", 2, []), ("1", "s", 1, ["别的"])], EVIDENCE)


def test_evidence(spark):
    assert {tuple(r) for r in gold.relevant_parents(evidence(spark), chunks(spark)).collect()} == {("1", "a"), ("1", "b"), ("4", "c")}
    assert {r.case_id for r in gold.cases_on_tables(evidence(spark), chunks(spark)).collect()} == {"1"}
    assert gold.relevant_parents(evidence(spark).limit(0), chunks(spark)).count() == 0
    results = spark.createDataFrame([("1", 1, "RBAC"), ("1", 6, "访问控制 RBAC"), ("2", 1, None)], "case_id string, rank int, text string")
    assert {r.case_id: r.coverage for r in gold.keyword_coverage(results, evidence(spark)).collect()} == {"1": 0.5, "2": 0.0, "3": 0.0, "4": 0.0}


def test_contract(spark):
    cases = spark.createDataFrame([("1", "q", "t", "fact"), ("1", "q", "t", "fact"), ("2", " ", "t", "none"), ("3", "q", "v", None), ("5", "q", "t", "fact")], "id string, question string, topic string, kind string")
    topics = spark.createDataFrame([("t",), ("u",)], "domain string")
    got = {tuple(r) for r in gold.contract(cases, evidence(spark), chunks(spark), topics).collect()}
    assert got == {
        ("repeated_id", "1"), ("empty_question", "2"), ("unknown_topic", "3"), ("unknown_kind", "2"), ("unknown_kind", "3"), ("no_evidence", "5"), ("unresolved_evidence", "2"), ("unresolved_evidence", "3"), ("uncovered_topic", "u"),
    }


def test_cached_scores(spark):
    asked = spark.createDataFrame([("k",), ("m",)], "key string")
    cache = spark.createDataFrame([("k", 0.5)], "key string, score double")
    assert [r.key for r in gold.uncached(asked, cache).collect()] == ["m"]
    assert {r.key: r.score for r in gold.with_cached_scores(asked, cache, complete=False).collect()} == {"k": 0.5, "m": None}
    with pytest.raises(Exception, match="no score for the pair m"):
        gold.with_cached_scores(asked, cache).collect()


def test_vectors(spark):
    held = spark.createDataFrame([("a", "t", "s", 1, [1.0]), ("b", "t", "s", 1, [2.0])], "id string, domain string, source string, page int, vector array<double>")
    wanted = spark.createDataFrame([("x", "t", "s", 1), ("y", "t", "s", 2)], "id string, domain string, source string, page int")
    found, missing = gold.proxy_vectors(held, wanted)
    assert [(r.id, r.vector) for r in found.collect()] == [("x", [1.0])] and [r.id for r in missing.collect()] == ["y"]
    texts = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y"), ("d", None)], "id string, text string")
    old = spark.createDataFrame([("a", "m", [1.0]), ("b", "other", [9.0])], "id string, embedding_model string, vector array<double>")
    told = gold.reused_vectors(texts, old, "m", lambda t: t.select("id", F.array(F.lit(0.0)).alias("vector")))
    assert {r.id: r.vector for r in told.collect()} == {"a": [1.0], "b": [0.0], "c": [0.0], "d": [0.0]}
    cache = spark.createDataFrame([], "key string, vector array<double>")
    both, made = catalog.cached_or_made(texts, cache, lambda t: t.select("key", F.array(F.length(F.coalesce("text", F.lit(""))).cast("double")).alias("vector")), "m", 1)
    assert both.count() == 4 and made.count() == 3
    again, none = catalog.cached_or_made(texts, made, lambda t: t.select("key", F.array(F.lit(7.0)).alias("vector")), "m", 1)
    assert none.count() == 0 and sorted(r.vector[0] for r in again.collect()) == [0.0, 1.0, 1.0, 1.0]
    assert catalog.cached_or_made(texts, made, lambda t: t.select("key", F.array(F.lit(7.0)).alias("vector")), "n", 1)[1].count() == 3


def test_order_and_snippets(spark):
    df = spark.createDataFrame([("b", "t", "s", 2), ("a", "t", "s", 2), ("c", None, "s", 1), ("d", "t", "r", 9)], "id string, domain string, source string, page int")
    assert [r.id for r in gold.in_order(df).orderBy("position").collect()] == ["c", "d", "a", "b"]
    ranked = spark.createDataFrame([("q", 1, "s", 1), ("q", 2, "s", 7), ("q", 6, "s", 1)], "query_id string, rank int, source string, page int")
    assert {r.rank: r.snippet for r in gold.page_snippets(ranked, chunks(spark)).collect()} == {1: "别的", 2: ""}


def test_profile_of_simulated_students(spark):
    """Preset abilities come out of the profile: the weak are found, the strong aren't flagged, ratings are in order."""
    now = 1.8e9
    able = spark.createDataFrame([("弱", 0.1), ("中", 0.6), ("强", 0.95)], "domain string, ability double")
    attempts = learner.simulated_attempts(able, 40, 11, now)
    signals = spark.createDataFrame([("问", 1.0)] * 3, "domain string, created_at double")
    profile = learner.full_profile(attempts, signals, now)
    rows = {r.domain: r for r in profile.collect()}
    assert rows["弱"].weak and not rows["强"].weak and rows["强"].rating > rows["中"].rating > rows["弱"].rating
    assert rows["问"].attempts == 0 and rows["问"].rating == 1500.0 and rows["问"].accuracy is None and rows["问"].confidence is None and rows["问"].ask_unverified
    assert {tuple(r) for r in learner.flagged_topics(profile).collect()} >= {("weak", "弱"), ("ask_unverified", "问")}
    cards = spark.createDataFrame([(now - 1,), (now + 1,)], "due double")
    told = learner.summary(profile, cards, now).first()
    assert (told.total_attempts, told.due_cards, told.unverified_topics) == (120, 1, 1)
    assert attempts.count() == 120 and attempts.select("id").distinct().count() == 120


def test_reports(spark):
    empty = spark.createDataFrame([], "id long, intent string, route_ms double, retrieval_ms double, first_token_ms double, total_ms double, prompt_tokens int, completion_tokens int")
    row = metrics.request_report(empty).first()
    assert (row.requests, row.avg_total_ms, row.p95_total_ms, row.total_prompt_tokens) == (0, 0.0, None, 0)
    told = spark.createDataFrame([("k", "p", "t", "一二"), ("k", "p", "", "一二!"), ("k", "q", None, None), ("k", "q", "t", "一二三四")], "kind string, parent_id string, title string, text string")
    row = metrics.structure_report(told).first()
    assert (row.chunks, row.parents, row.children_per_parent, row.median, row.p90, row.longest, row.titled, row.duplicates) == (4, 2, 2.0, 2.5, 3, 4, 50.0, 25.0)


def test_settings():
    assert DEFAULTS.problems() == [] and DEFAULTS.checked() is DEFAULTS
    with pytest.raises(ValueError, match="k must be 1 or more; relevance_floor.*fixed_overlap"):
        Settings(k=0, relevance_floor=2.0, fixed_overlap=300).checked()


def test_manifest(spark):
    held = spark.createDataFrame([("chunks", "5"), ("model", '"m"')], "key string, value string")
    assert {tuple(r) for r in catalog.updated_manifest(held, {"chunks": 6, "new": "x"}).collect()} == {("chunks", "6"), ("model", '"m"'), ("new", '"x"')}


def test_page_tables(spark):
    cells = [["名", "值", "注"], ["甲", "1", "x"], ["乙", "2", "y"]]
    region = "".join("".join(r) for r in cells)
    rows = [([([0.0, 50.0, 9.0, 60.0], cells, region), ([0.0, 10.0, 9.0, 20.0], cells, region), ([0.0, 1.0, 9.0, 2.0], [["只"]], "只"), ([0.0, 70.0, 9.0, 80.0], cells, region * 3)], [([0.0, 40.0, 9.0, 48.0], "表二")])]
    df = spark.createDataFrame(rows, "tables array<struct<box:array<double>,rows:array<array<string>>,region:string>>, blocks array<struct<box:array<double>,text:string>>")
    row = df.select(tables.page_tables(F.col("tables"), F.col("blocks")).alias("t")).select("t", tables.page_text(F.lit(" 正文 "), F.col("t")).alias("p")).first()
    assert [(t.box[1], t.caption) for t in row.t] == [(10.0, None), (50.0, "表二")]
    assert row.p.startswith("正文\n\n【表格】\n| 名 | 值 | 注 |") and "\n\n【表格】表二\n| 名" in row.p


def test_rounds_and_questions(spark):
    row = spark.createDataFrame([("q", None, "i")], "q string, a string, i string").select(memory.round_text(F.col("q"), F.col("a"), F.col("i")).alias("t")).first()
    assert row.t == "意图: i\n用户: q\n助手: "
    made = spark.createDataFrame([("丙", "{}", "A", None, "t"), ("甲", "{}", "B", "", "t"), ("甲", "{}", "B", "", "t")], "stem string, options string, answer string, analysis string, domain string")
    assert sorted(r.id for r in questions.generated(made, 1000, "stem").collect()) == ["ai_1000", "ai_1001", "ai_1002"]
    assert questions.generated(made.limit(0), 1000, "stem").count() == 0
    bank = spark.createDataFrame([("a", "s", "t", "x", "{}", "A", "y")], "id string, source string, domain string, stem string, options string, answer string, analysis string")
    assert questions.redacted(bank).columns == ["id", "source", "domain", "stem", "options"]


CORPUS = "id string, domain string, source string, page int, title string, text string"


def test_search_blends_gates_and_keeps_order(spark):
    corpus = spark.createDataFrame([("a", "t", "s", 1, "风险评估", "风险评估的四个阶段"), ("b", "t", "s", 2, None, "风险评估过程"), ("c", "u", "s", 3, "", None), ("d", "u", "s", 9, "", "风险评估")], CORPUS)
    asked = spark.createDataFrame([(1, "风险评估", "t"), (2, "风险评估", None), (3, "", None), (4, "没有的词", None)], "query_id long, query string, topic string")
    got = retrieve.search(asked, corpus).collect()
    assert {r.id for r in got if r.query_id == 1} == {"a", "b"} and {r.id for r in got if r.query_id == 2} == {"a", "b", "d"}
    assert {r.query_id for r in got} == {1, 2} and not any(r.refused for r in got)
    plain = {(r.query_id, r.id): r["rank"] for r in retrieve.search(asked, corpus, scorer=None).collect()}
    lost = {(r.query_id, r.id): r["rank"] for r in retrieve.search(asked, corpus, scorer=lambda q, t: F.when(F.contains(t, F.lit("过程")), 1.0)).collect()}
    assert plain == lost  # a scorer that has no score for some candidate changes nothing
    near = lambda asks: asks.select("query_id", F.lit("d").alias("id"), F.when(F.col("query_id").startswith("1"), 0.4).otherwise(0.5).alias("score"), F.lit(1).alias("rank"))
    told = {r.query_id: r.refused for r in retrieve.search(asked, corpus, near).collect()}
    assert told[2] is False and told[1] is False  # d is of another topic than 1 asks for, so no dense score is shown there
    low = lambda asks: asks.select("query_id", F.lit("d").alias("id"), F.lit(0.4).alias("score"), F.lit(1).alias("rank"))
    assert {r.query_id: r.refused for r in retrieve.search(asked, corpus, low).collect()}[2] is True
    assert retrieve.search(asked.limit(0), corpus).count() == 0 and retrieve.search(asked, corpus.limit(0)).count() == 0


def test_variants_and_context(spark):
    corpus = spark.createDataFrame([("a", "t", "s", 1, "", "密码学基础"), ("b", "t", "s", 5, "", "对称加密算法")], CORPUS)
    asked = spark.createDataFrame([(1, "密码学", None, ["对称加密", " ", "密码学", "基础", "算法"], [("s", 3)])], "query_id long, query string, topic string, variants array<string>, context array<struct<source:string,page:int>>")
    assert [(r.variant, r.query) for r in retrieve.asks(asked).orderBy("variant").collect()] == [(0, "密码学"), (1, "对称加密"), (2, "基础")]
    scores = {r.id: r.score for r in retrieve.search(asked, corpus, scorer=None).collect()}
    # first in the query and in a variant: (2 + 1) / 21, and both pages are near the one shown before
    assert scores.keys() == {"a", "b"} and scores["a"] > scores["b"] > 1 / 21


def test_scatter(spark):
    told = spark.createDataFrame([(1, 0), (1, 1)], "query_id int, index int")
    scores = spark.createDataFrame([(1, 1, 0.7), (1, 9, 0.1)], "query_id int, index int, rerank double")
    assert {r["index"]: r.rerank for r in fusion.scattered(told, scores).collect()} == {0: 0.0, 1: 0.7}


def test_labels_by_words_and_by_a_labeller(spark):
    df = spark.createDataFrame([("a", "业务连续性 RTO RPO", '{"A": "x"}', None), ("b", "没有这些词", "坏", ""), ("c", None, None, None), ("d", "也没有", "{}", "")], "id string, stem string, options string, analysis string")
    topics = spark.createDataFrame([("业务连续性",), ("法律",)], "domain string")
    assert {r.id: r.topic for r in questions.labelled(df, topics).collect()} == {"a": "业务连续性", "b": None, "c": None, "d": None}
    said = lambda rest: rest.select("id", F.when(F.col("id") == "b", "法律").otherwise("别的").alias("topic"))
    assert {r.id: r.topic for r in questions.labelled(df, topics, said).collect()} == {"a": "业务连续性", "b": "法律", "c": None, "d": None}
    assert questions.labelled(df.limit(0), topics, said).count() == 0
