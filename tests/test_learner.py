import math

import pytest
from pyspark.sql import functions as F

from mulberry.operators import learner, metrics, schedule
from mulberry.plans import learner_queries

ATTEMPTS = "id bigint, question_id string, domain string, choice string, correct boolean, answered_at double"


def attempts(spark, marks, domain="t"):
    return spark.createDataFrame([(i, f"q{i}", domain, "A", ok, float(i)) for i, ok in enumerate(marks)], ATTEMPTS)


@pytest.mark.parametrize("marks,want", [([True], 1529.0909), ([False], 1470.9091)])
def test_first_answer(spark, marks, want):
    assert learner.replay(attempts(spark, marks), "domain").first().elo == want


def slow_elo(marks):
    r, c = 1500.0, 0
    for n, ok in enumerate(marks, 1):
        c += ok
        r += 32 * (ok - 1 / (1 + 10 ** ((1500 + (c / n - 0.5) * 800 - r) / 400)))
    return round(r, 4)


def test_replay_by_window_equals_whole_replay(spark):
    marks = [(i * i + i // 7) % 5 < 3 for i in range(2500)]
    df = attempts(spark, marks)
    assert abs(learner.replay(df, "domain", window=1500).first().elo - slow_elo(marks)) < 1e-3
    assert learner.replay(df, "domain").first().elo == slow_elo(marks)


def test_replay_folds_every_attempt_of_a_long_key(spark):
    marks = [True] * 25_000
    df = attempts(spark, marks).union(attempts(spark, [False, True], "u"))
    assert {r.domain: r.elo for r in learner.replay(df.orderBy(F.desc("id")), "domain").collect()} == {"t": slow_elo(marks), "u": slow_elo([False, True])}


@pytest.mark.parametrize("marks,want", [("1101110", (0, 3)), ("0111", (3, 3)), ("000", (0, 0)), ("1", (1, 1)), ("1111", (4, 4))])
@pytest.mark.parametrize("span", [1.0, 2.0, 3.0, 100.0])
def test_streaks(spark, marks, want, span):
    row = learner.streaks(attempts(spark, [m == "1" for m in marks]), "domain", span).first()
    assert (row.streak, row.best_streak) == want


@pytest.mark.parametrize("a,b,want", [(1, 3, 0.936), (2, 2, 0.648), (2, 3, 0.8208), (2, 4, 0.91296)])
def test_probability_below(spark, a, b, want):
    got = spark.range(1).select(learner.probability_below(F.lit(a), F.lit(b), 0.6).alias("p")).first().p
    assert abs(got - want) < 1e-9


def test_large_counts_agree_with_the_tail(spark):
    row = spark.range(1).select(learner.probability_below(F.lit(700), F.lit(500), 0.6).alias("p"), learner.binomial_tail(F.lit(700.0), F.lit(500.0), 0.6).alias("q")).first()
    assert abs(row.p - row.q) < 1e-7


def test_strength_and_confidence(spark):
    row = spark.range(1).select(*[learner.memory_strength(F.lit(d)).alias(f"d{int(d)}") for d in (-1.0, 7.0, 14.0)], learner.confidence(F.lit(1), F.lit(1)).alias("c"), learner.confidence(F.lit(60), F.lit(40)).alias("w")).first()
    assert (row[0], row[1], row[2]) == (1.0, 0.5, 0.25) and abs(row.c - 0.1) < 1e-6 and 0.8 < row.w < 0.9


@pytest.mark.parametrize("a,b,want", [(30, 30, 0.7892), (60, 40, 0.8396), (29, 30, None), (1, 500, None), (9000, 4000, None)])
def test_confidence_is_exact_at_every_size(spark, a, b, want):
    got = spark.range(1).select(learner.confidence(F.lit(a), F.lit(b)).alias("c")).first().c
    n = a + b - 1
    log_c = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) for j in range(n + 1)]

    def quantile(p):
        low, high = 0.0, 1.0
        for _ in range(40):
            x = (low + high) / 2
            below = sum(math.exp(log_c[j] + j * math.log(x) + (n - j) * math.log1p(-x)) for j in range(a, n + 1))
            low, high = (x, high) if below < p else (low, x)
        return low

    assert abs(got - (1 - quantile(0.95) + quantile(0.05))) < 1e-7 and want in (None, round(got, 4))


def test_profile_and_weights(spark):
    signals = spark.createDataFrame([(1, "t", "q", "问", "", 1.0)] * 3 + [(4, "t", "q", None, "", 1.0)], "id bigint, thread_id string, question string, domain string, intent string, created_at double")
    topics = spark.createDataFrame([("t",), ("问",), ("空",)], "domain string")
    df = attempts(spark, [False, False, False])
    profile = learner.topic_profile(df, signals, now=7 * 86400.0 + 2, topics=topics)
    told = {r.domain: r for r in profile.collect()}
    assert told["t"].weak and told["t"].due_for_review and told["t"].memory_strength == 0.5
    assert told["问"].ask_unverified and told["问"].attempts == 0
    elo = spark.createDataFrame([("t", 1400.0)], "domain string, elo double")
    weights = {r.domain: r.weight for r in learner.topic_weights(topics, profile, elo).collect()}
    assert weights == {"t": 0.702, "问": 0.75, "空": 0.5}


def test_pool_falls_back_to_all(spark):
    q = spark.createDataFrame([("q0", "A", False, None), ("q1", "", False, None), ("q2", "B", True, None), ("q3", "B", False, " ")], "id string, answer string, needs_review boolean, dup_of string")
    assert {r.id for r in learner.available_pool(q, attempts(spark, [True])).collect()} == {"q3"}
    right = spark.createDataFrame([(1, "q0", "t", "A", True, 1.0), (2, "q3", "t", "A", True, 1.0)], ATTEMPTS)
    assert {r.id for r in learner.available_pool(q, right).collect()} == {"q0", "q3"}


def test_order_statistics(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)] + [(None,)], "v double")
    assert metrics.order_statistics(df, "v", [0.95], metrics.rule_capped) == {0.95: 19.0}
    assert metrics.order_statistics(df, "v", [0.95], metrics.rule_inner) == {0.95: 18.0}
    assert metrics.order_statistics(df.limit(0), "v", [0.5]) == {0.5: None}


def test_order_statistics_in_bins(spark, monkeypatch):
    monkeypatch.setattr(metrics, "FEW", 10)
    values = [float((i * 7919) % 1000) ** 2 for i in range(1000)] + [5.0] * 300
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = sorted(values)
    assert metrics.order_statistics(df, "v", [0.0, 0.1, 0.5, 0.99]) == {p: want[min(int(1300 * p), 1299)] for p in (0.0, 0.1, 0.5, 0.99)}


def test_cards_order_and_growth(spark):
    day = 86400.0
    good = [schedule.review(None, True, 0.0)]
    for n in range(1, 5):
        good.append(schedule.review(good[-1], True, n * 4 * day))
    assert all(a["stability"] <= b["stability"] for a, b in zip(good, good[1:])) and good[-1]["stability"] > 2.3 and good[-1]["reps"] == 5
    wrong = schedule.review(None, False, 0.0)
    assert wrong["due"] <= 3600 and wrong["lapses"] == 1 and schedule.review(good[-1], False, 30 * day)["stability"] < good[-1]["stability"]
    df = spark.createDataFrame([(2, "q", True, 10.0), (1, "q", False, 5.0), (3, "r", True, 1.0)], "id bigint, question_id string, correct boolean, answered_at double")
    told = {r.question_id: r for r in schedule.cards(df).collect()}
    assert told["q"].reps == 2 and told["q"].lapses == 1 and told["q"].last_review == 10.0 and math.isclose(told["r"].stability, schedule.WEIGHTS[2])
    assert [r.question_id for r in schedule.due_cards(schedule.cards(df), 1e12, 1).collect()] == ["r"]


def test_mastery_has_the_questions_with_many_attempts(spark, tmp_path):
    marks = [True] * 250 + [False] * 200
    rows = [(i, "hot", "t", "A", ok, float(i)) for i, ok in enumerate(marks)] + [(900, "one", "t", "A", True, 1.0)]
    spark.createDataFrame(rows, ATTEMPTS).write.parquet(f"{tmp_path}/attempts.parquet")
    told = {r.question_id: r for r in learner_queries.q_beta_mastery(spark, str(tmp_path)).collect()}
    tail = sum(math.comb(451, j) * 0.6**j * 0.4 ** (451 - j) for j in range(251, 452))
    assert told["hot"].mastery == 0.5553 and abs(told["hot"].p_below - tail) < 2e-6 and set(told) == {"hot", "one"}
