import pytest
from pyspark.sql import functions as F

from mulberry.functions import text as T
from mulberry.operators import questions


def value(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("v")).first().v


@pytest.mark.parametrize("text,want", [("第三级", "3级"), ("三级", "3级"), ("3级", "3级"), ("第十一级", "11级"), ("十五级", "15级"), ("二十级", "20级"), ("三十二级", "32级"), ("三个", "三个")])
def test_levels(spark, text, want):
    assert value(spark, T.level_numbers, text) == want


@pytest.mark.parametrize("text,want", [("BA", "AB"), ("C ", "C"), ("E", ""), ("a c", "AC")])
def test_choice(spark, text, want):
    assert value(spark, T.choice_letters, text) == want


def test_tokens_and_bigrams(spark):
    assert value(spark, T.tokens, "SQL注入 攻击，的") == ["sql", "注入", "攻击"]
    assert value(spark, T.word_tokens, "SQL注入攻击") == ["sql", "注入攻击"]
    assert value(spark, lambda c: T.with_bigrams(T.word_tokens(c)), "注入攻击") == ["注入攻击", "注入", "入攻", "攻击"]
    assert value(spark, T.tokens, "") == []


def test_clean_and_keys(spark):
    assert value(spark, T.clean_text, " a 　 b\n\n\n\nc\n ") == "a b\n\nc"
    assert value(spark, T.content_key, "风险A-é！") == "风险aé"
    assert value(spark, T.compact, "风险A-é！1") == "风险a1"
    assert value(spark, T.match_form, "（一） 二。") == "一二"
    assert value(spark, T.version_of, "课件_V4.2.1") == "V4.2.1"


@pytest.mark.parametrize("text,want", [("处置流程", "process"), ("BIA是啥", "acronym"), ("分为几类", "fact"), ("区别", "comparison"), ("什么是风险", "definition"), ("风险", "other")])
def test_intent(spark, text, want):
    assert value(spark, T.query_intent, text) == want


@pytest.mark.parametrize("kinds,want", [(None, False), ("none", False), ("all", True), ("process", True), ("fact", False)])
def test_gate(spark, kinds, want):
    assert value(spark, lambda c: T.learned_ranking_applies(c, kinds), "处置流程") is want


def test_rewrite_adds_only_what_is_missing(spark):
    assert value(spark, T.rewritten, " CRL 证书库 ") == "CRL 证书库 证书撤销列表 已撤销证书"
    assert value(spark, T.rewritten, "风险") == "风险"


def test_stable_ids(spark):
    told = spark.createDataFrame([("a", "b"), ("a", "b"), ("ab", "")], "x string, y string").select(T.stable_id("c", F.col("x"), F.col("y")).alias("i"))
    ids = [r.i for r in told.collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 22


def test_table_text(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]],)], "r array<array<string>>")
    assert df.select(T.markdown_table(F.col("r")).alias("m")).first().m == "| a | b |\n| --- | --- |\n| c |  |"
    assert value(spark, T.clean_cell, " 风 险") == "风险•" and value(spark, T.clean_cell, "a \xa0 b") == "a b"


def test_topic_words_and_files(spark):
    assert value(spark, questions.topic_by_words, "BCP 与 RTO") == "业务连续性"
    assert value(spark, questions.topic_by_words, "无关") is None
    assert value(spark, questions.topic_of_file, "03 安全支撑技术.pdf") == "信息安全支撑技术" and value(spark, questions.topic_of_file, "x") == "未分类"
    assert value(spark, questions.answer_at_end, "下列哪项？ABD ：") == "ABD"
