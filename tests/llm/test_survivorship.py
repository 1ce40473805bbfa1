import datetime

import pytest
from pyspark.sql import functions as F

from mulberry.llm import survivorship as V

OPTIONS = '{"A": "1", "B": "2", "C": "3"}'
SCHEMA = "id string, source string, options string, answer string, analysis string, needs_review boolean, dup_of string, created_at timestamp_ntz"
NEW, OLD = datetime.datetime(2024, 1, 1), datetime.datetime(2020, 1, 1)


@pytest.mark.parametrize("answer,usable", [("A", True), (" Ａ．c ", True), ("A、B", True), ("A/B,C", True), ("AA", False), ("D", False), ("", False), (None, False), ("见解析", False), ("。", False), ("1", False)])
def test_answers(spark, answer, usable):
    df = spark.createDataFrame([(answer, OPTIONS)], "a string, o string")
    assert df.select(V.usable_answer(F.col("a"), F.col("o")).alias("u")).first().u is usable


@pytest.mark.parametrize("text,usable", [("本题考查。", True), ("　", False), ("略", False), ("解析：略", False), ("Ｎ／Ａ", False), ("-", False), (None, False), ("无关项要排除", True)])
def test_analyses(spark, text, usable):
    assert spark.createDataFrame([(text,)], "a string").select(V.usable_analysis(F.col("a")).alias("u")).first().u is usable


def test_fields_come_from_the_best_member(spark):
    publishers = spark.createDataFrame([("高", 5), ("低", 1), ("高", 4)], "publisher string, trust int")
    rows = [
        ("r", "低_1", OPTIONS, "A", "略", False, None, OLD),
        ("a", "高_1", OPTIONS, "B", "短解析", False, " r ", OLD),
        ("b", "高_1", OPTIONS, "C", "更长的解析", True, "a", NEW),
        ("c", "高_1", OPTIONS, "A.", "短解析", False, "r", None),
        ("x", "低_1", OPTIONS, "?", "无", False, "gone", OLD),
        ("y", "低_1", OPTIONS, "", None, None, "gone", None),
        ("l2", "低_1", OPTIONS, "A", "说明", None, "l1", OLD),
        ("l1", "低_1", OPTIONS, "B", "说明", None, "l2", NEW),
        ("s", "低_1", OPTIONS, "A", "说明", False, "s", OLD),
        ("o", "无_1", OPTIONS, "A", "说明", False, "  ", OLD),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.group_id, r.field): r.id for r in V.field_sources(df, publishers).collect()}
    assert got == {("r", "answer"): "a", ("r", "analysis"): "a", ("l1", "answer"): "l1", ("l1", "analysis"): "l1"}
    told = {r.group_id: r for r in V.survivors(df.selectExpr("*", "1 as rank", "2 as trust", "3 as group_id"), publishers).collect()}
    assert told["r"].members == 4 and told["r"].answer == "B" and told["gone"].answer is None and told["gone"].members == 2
    assert V.survivors(df.limit(0), publishers).count() == 0
