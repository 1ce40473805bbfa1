import os

import pytest
from pyspark.sql import functions as F

from mulberry.config import Settings
from mulberry.engine import Engine

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
NOW = 1.76e9


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, DATA)


def test_contexts(engine, spark):
    asked = spark.createDataFrame([(1, "风险评估", None)], "query_id long, query string, topic string")
    shown = engine.contexts(asked)
    assert 0 < shown.count() <= 5 and "text" in shown.columns
    assert engine.sources(shown).count() == 1


def test_questions(engine, spark):
    one = engine.next_question(NOW, 3)
    assert one.count() == 1 and "answer" not in one.columns and one.collect() == engine.next_question(NOW, 3).collect()
    topic = engine.topics().where("domain is not null").orderBy("domain").first().domain
    assert engine.next_question(NOW, 3, topic).where(F.col("domain") != topic).count() == 0
    made = lambda t: spark.createDataFrame([("ai_1", "AI生成", t, "题", "{}")], "id string, source string, domain string, stem string, options string")
    assert engine.next_question(NOW, 3, "没有的领域").count() == 0
    assert [r.id for r in engine.next_question(NOW, 3, "没有的领域", made).collect()] == ["ai_1"]
    known = engine.tables["questions"].where("answer rlike '^[A-D]$'").orderBy("id").first()
    answers = spark.createDataFrame([(known.id, known.answer), ("nobody", "A")], "question_id string, choice string")
    got = {r.question_id: r for r in engine.graded(answers).collect()}
    assert got[known.id].correct is True and got[known.id].answer == known.answer and got["nobody"].correct is None
    assert all(len(r.text) <= 300 and r["rank"] <= 2 for r in engine.related(answers).collect())


def test_statistics_and_views(engine, spark):
    told = engine.statistics(NOW)
    assert told["totals"].first().total_attempts == engine.tables["attempts"].where("domain is not null").count()
    assert told["topics"].count() == engine.profile(NOW).count() and {r.flag for r in told["flags"].collect()} <= {"weak", "review_due", "ask_unverified"}
    assert engine.due(NOW, 5).count() <= 5 and engine.threads(3).count() <= 3
    assert spark.sql("SELECT count(*) FROM questions").first()[0] == engine.tables["questions"].count()


def test_wrong_settings_are_told(spark):
    with pytest.raises(ValueError):
        Engine(spark, DATA, Settings(k=0))
