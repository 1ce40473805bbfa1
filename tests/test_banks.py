import json

import pytest
from pyspark.sql import functions as F

from mulberry.functions import text as T
from mulberry.operators import banks, ltr, rerank, tables
from mulberry.plans import bank_queries
from mulberry.sources import files


def test_key_and_analyses(spark):
    q = spark.createDataFrame([("a", "s", 1, "1、甲乙丙丁戊己庚辛壬癸子", None, ""), ("b", "s", 2, "别的题目", "A", "有"), ("c", "s", 3, "第三题", " ", None)], "id string, source string, num int, stem string, answer string, analysis string")
    key = spark.createDataFrame([("s", 1, "B", 1), ("s", 1, "C", 2), ("s", 2, "D", 1)], "source string, num int, answer string, ord int")
    assert {r.id: r.answer for r in banks.with_answer_key(q, key).collect()} == {"a": "C", "b": "A", "c": None}
    told = spark.createDataFrame([(1, "1、甲乙丙，丁戊己庚辛壬癸", "解", 1), (3, "不一样", "错", 1)], "num int, stem string, analysis string, ord int")
    filled, conflicts = banks.with_analyses(q, told)
    assert {r.id: r.analysis for r in filled.collect()} == {"a": "解", "b": "有", "c": None}
    assert [r.id for r in conflicts.collect()] == ["c"]
    merged = banks.merged_numbers(q.unionByName(q.limit(1).withColumn("id", F.lit("z"))))
    assert merged.where("num = 1").first().id == "a"


def test_validity_and_gold(spark):
    good = '{"A":"1","B":"2","C":"3","D":"4"}'
    rows = [(" A ", good, True), ("E", good, False), ("A", good.replace("4", "3"), False), ("A", "{}", False), ("A", "x", False)]
    df = spark.createDataFrame(rows, "a string, o string, want boolean")
    assert all(r.v == r.want for r in df.select("want", banks.is_valid(F.col("a"), F.col("o")).alias("v")).collect())
    cases = spark.createDataFrame([("1", "q", "t"), ("1", "", "x")], "id string, question string, topic string")
    topics = spark.createDataFrame([("t",), ("u",)], "domain string")
    assert {(r.problem, r["item"]) for r in banks.gold_problems(cases, topics).collect()} == {("repeated_id", "1"), ("empty_question", "1"), ("unknown_topic", "1"), ("uncovered_topic", "u")}


def test_citations_and_expansions(spark):
    df = spark.createDataFrame([("答\n【出处】《课件》第3页；《别的》第2页；乱写",)], "a string")
    pages = F.array(F.struct(F.lit("课件_V4.2").alias("source"), F.lit(3).alias("page")))
    row = df.select(banks.citations(F.col("a")).alias("c"), banks.supported(banks.citations(F.col("a")), pages).alias("s")).first()
    assert [(c.source, c.page) for c in row.c] == [("课件", 3), ("别的", 2)] and [c.source for c in row.s] == ["课件"]
    df = spark.createDataFrame([("IATF的信息保障技术框架有哪些",), ("没有缩写",), ("信息系统审计的CISA资格",), ("3GPP与BLP",)], "q string")
    assert [r.n for r in df.select(T.written_out(F.col("q")).alias("n")).collect()] == [["信息保障技"], [], ["信息系统审"], []]


def test_tables(spark):
    rows = [["a", "b", "c"], ["1", "2", "3"], ["4", "5", ""]]
    df = spark.createDataFrame([(rows, [["x"]], "a b c 1 2 3 4 5")], "r array<array<string>>, s array<array<string>>, t string")
    row = df.select(tables.is_meaningful(F.col("r")).alias("m"), tables.is_meaningful(F.col("s")).alias("n"), tables.filled_cells(F.col("r")).alias("f"), tables.coverage(F.col("r"), F.col("t")).alias("c")).first()
    assert row.m and not row.n and row.f == 8 and row.c == 1.0
    page = spark.createDataFrame([([([0.0, 0.0, 9.0, 9.0], "表1 名称"), ([0.0, 12.0, 9.0, 20.0], "表内"), ([0.0, 50.0, 9.0, 60.0], "正文")], [[0.0, 10.0, 10.0, 30.0]])], "b array<struct<box:array<double>,text:string>>, t array<array<double>>")
    row = page.select(tables.body_blocks(F.col("b"), F.col("t")).alias("o"), tables.caption(F.col("b"), F.col("t")[0]).alias("c")).first()
    assert [b.text for b in row.o] == ["表1 名称", "正文"] and row.c == "表1 名称"


def test_next_question(spark):
    q = spark.createDataFrame([("a", "t", "A", False, None), ("b", "u", "A", False, None)], "id string, domain string, answer string, needs_review boolean, dup_of string")
    none = spark.createDataFrame([], "question_id string, correct boolean")
    cards = spark.createDataFrame([("b", 5.0)], "question_id string, due double")
    weights = spark.createDataFrame([("t", 1.0), ("u", 0.0)], "domain string, weight double")
    assert banks.next_question(q, none, cards, weights, 10.0, 1).first().id == "b"
    assert banks.next_question(q, none, cards, weights, 1.0, 1).first().id == "a"
    assert banks.next_question(q.limit(0), none, cards, weights, 10.0, 1).count() == 0


def test_training_finds_the_feature_that_matters(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 3), i % 7 > 3) for i in range(210)], "x double, z double, label boolean")
    model = ltr.train(df, ["x", "z"])
    assert model["coef"][0] > 5 * abs(model["coef"][1])
    scored = df.select("label", rerank.logistic_score([F.col("x"), F.col("z")], model).alias("p"))
    assert scored.where("(p > 0.5) <> label").count() == 0
    assert ltr.train(df.where("label"), ["x"])["coef"] == [0.0]


def test_files(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "b总结.txt").write_text("一\f二")
    (tmp_path / "docs" / "c.txt").write_bytes(b"\xff\xfe\xff")
    pages = files.document_pages(spark, str(tmp_path / "docs"), lambda _, b: b.decode("utf-8").split("\f"), "*.txt")
    assert [(r.page, r.text) for r in files.document_order(pages).orderBy("doc_ord", "page").collect()] == [(1, None), (1, "一"), (2, "二")]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "a", "num": 1}, {"id": "b"}]))
    assert {(r.id, r.num) for r in files.json_rows(spark, str(tmp_path / "q.json"), "id string, num int").collect()} == {("a", 1), ("b", None)}
    df = spark.createDataFrame([("长" * 600, 1)], "stem string, n int")
    files.append_events(df, str(tmp_path / "e"), "attempts")
    files.append_events(df, str(tmp_path / "e"), "attempts")
    assert [len(r.stem) for r in spark.read.parquet(str(tmp_path / "e")).collect()] == [500, 500]
    files.append_vectors(spark.createDataFrame([("m", [1.0, 2.0])], "embedding_model string, vector array<double>"), str(tmp_path / "v"))
    assert spark.read.parquet(str(tmp_path / "v")).first().dim == 2
    files.write_rows(df, str(tmp_path / "j"), "json")
    assert files.json_rows(spark, str(tmp_path / "j"), "n int").count() == 1
    with pytest.raises(Exception, match="(?i)driver"):  # a wrong address isn't a missing table
        files.jdbc_table(spark, "jdbc:none:x", "t")


def test_sources_of_all_pages(spark, tmp_path):
    spark.createDataFrame([("t", "b", 1), ("t", "a", 7), ("t", "c", None), ("u", "d", 2)], "domain string, source string, page int").write.parquet(f"{tmp_path}/kb_chunks.parquet")
    assert {r.domain: r.sources for r in bank_queries.q_source_display(spark, str(tmp_path)).collect()} == {"t": "a、b、c", "u": "d"}
