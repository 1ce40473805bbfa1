"""Learner analytics over answered questions: mastery, Elo, streaks, forgetting, topic profiles and weights.

``now`` and ``seed`` are always parameters. Attempts have the columns id, question_id, domain, choice, correct,
answered_at (epoch seconds). Order-dependent values replay each topic's attempts in the order of time, then id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mulberry.config import DEFAULTS, Settings


def topic_accuracy(attempts: DataFrame) -> DataFrame:
    """``domain``, ``attempts``, ``correct``, ``last_at``; attempts without a topic don't count."""
    return attempts.where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("correct").alias("correct"), F.max("answered_at").alias("last_at"))


def ask_signals(signals: DataFrame) -> DataFrame:
    """``domain``, ``asks``, ``last_ask``; signals without a topic don't count."""
    return signals.where("domain is not null").groupBy("domain").agg(F.count(F.lit(1)).alias("asks"), F.max("created_at").alias("last_ask"))


def replay(attempts: DataFrame, by: str, settings: Settings = DEFAULTS, window: int | None = None) -> DataFrame:
    """``by``, ``elo`` after replaying all attempts of a key.

    An answer is played against 1500 + (accuracy so far, this answer included, - 0.5) * 800. Rows are sorted within
    partitions by key and time and folded as they stream by, so a task holds one batch and one rating, however many
    attempts a key has. Every attempt is folded; ``window`` has no effect, it is kept for callers that name it.
    """
    start, k = settings.elo_start, settings.elo_k
    kind = attempts.schema[by].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, r, n, c = None, start, 0, 0
        for rows in batches:
            done = []
            for key, ok in zip(rows["key"], rows["ok"].tolist()):
                if n == 0 or key != now:
                    if n:
                        done.append((now, r))
                    now, r, n, c = key, start, 0, 0
                n, c = n + 1, c + ok
                opponent = 1500.0 + (c / n - 0.5) * 800.0
                r += k * (ok - 1 / (1 + 10.0 ** ((opponent - r) / 400.0)))
            yield pd.DataFrame(done, columns=["key", "elo"])
        if n:
            yield pd.DataFrame([(now, r)], columns=["key", "elo"])

    told = attempts.select(F.col(by).alias("key"), "answered_at", "id", F.col("correct").cast("int").alias("ok"))
    ratings = told.repartition("key").sortWithinPartitions("key", "answered_at", "id").select("key", "ok").mapInPandas(fold, f"key {kind}, elo double")
    return ratings.select(F.col("key").alias(by), F.round("elo", 4).alias("elo"))


def streaks(attempts: DataFrame, by: str, span: float = 86400.0) -> DataFrame:
    """``by``, ``streak`` (of correct answers at the end), ``best_streak``.

    Each span of time is summed up by itself (length, runs at both ends, best run), then the sums of a key are put
    together in order, so no task sees all attempts of a key.
    """
    part = [by, "__span"]
    order = ("answered_at", "id")
    told = attempts.select(by, "correct", *order, F.floor(F.col("answered_at") / span).alias("__span"))
    all_, same = Window.partitionBy(*part).orderBy(*order), Window.partitionBy(*part, "correct").orderBy(*order)
    ranked = told.select(*part, "correct", F.row_number().over(all_).alias("at"), F.row_number().over(same).alias("of"))
    runs = ranked.where("correct").groupBy(*part, (F.col("at") - F.col("of")).alias("island")).agg(F.count(F.lit(1)).alias("run"), F.min("at").alias("a"), F.max("at").alias("b"))
    size = told.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    held = size.join(runs, part, "left").groupBy(*part, "n").agg(
        F.coalesce(F.max(F.when(F.col("a") == 1, F.col("run"))), F.lit(0)).alias("first"), F.coalesce(F.max(F.when(F.col("b") == F.col("n"), F.col("run"))), F.lit(0)).alias("last"), F.coalesce(F.max("run"), F.lit(0)).alias("best")
    )
    sums = held.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("__span", "n", "first", "last", "best"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("now"), F.lit(0).cast("long").alias("best"))
    join = lambda s, x: F.struct(F.when(x["last"] == x["n"], s["now"] + x["n"]).otherwise(x["last"]).alias("now"), F.greatest(s["best"], x["best"], s["now"] + x["first"]).alias("best"))
    out = sums.select(by, F.aggregate("spans", zero, join).alias("s"))
    return out.select(by, F.col("s.now").alias("streak"), F.col("s.best").alias("best_streak"))


def mastery(correct: Column, wrong: Column) -> Column:
    """The mean of the Beta posterior with a uniform prior."""
    return F.round((correct + 1) / (correct + wrong + 2), 4)


def ln_gamma(x: Column) -> Column:
    """ln Γ(x) for x >= 1 by Stirling's series, shifted up by 8 (error below 1e-12)."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + i)
    return series - shift


def probability_below(a: Column, b: Column, x: float) -> Column:
    """P(θ < x) of Beta(a, b), by the continued fraction of its distribution at every size; null where a or b isn't above 0."""

    def below(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([_beta_below(p, q, x) if p > 0 and q > 0 else None for p, q in zip(xs, ys)], dtype="float64")

    return F.pandas_udf(below, "double")(a.cast("double"), b.cast("double"))


def binomial_tail(a: Column, b: Column, x: float) -> Column:
    """P(θ < x) of Beta(a, b) for whole a, b as the exact binomial tail; the cost grows with a + b."""
    n = a + b - 1
    term = lambda j: F.exp(ln_gamma(n + 1.0) - ln_gamma(j + 1.0) - ln_gamma(n - j + 1.0) + j * F.log(F.lit(x)) + (n - j) * F.log(F.lit(1 - x)))
    return F.least(F.aggregate(F.sequence(a.cast("int"), n.cast("int")), F.lit(0.0), lambda acc, j: acc + term(j)), F.lit(1.0))


def memory_strength(days: Column, half_life: float = DEFAULTS.half_life_days) -> Column:
    """2^(-days/half-life); 1 for no time."""
    return F.when(days <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -days / half_life))


def _beta_below(a: float, b: float, x: float) -> float:
    """P(θ < x) of Beta(a, b) by the continued fraction of the incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_below(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h, m = d, 0
    while True:
        m += 1
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + k * d, 1 + k / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14 or m > 1_000_000:
            return front * h


def confidence(a: Column, b: Column, tail: float = 0.05, steps: int = 40) -> Column:
    """1 minus the width of the central 90 % interval of Beta(a, b), by bisection of its distribution at every size."""

    def quantile(p: float, x: float, y: float) -> float:
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if _beta_below(x, y, mid) < p else (low, mid)
        return (low + high) / 2

    def sure(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([min(1.0, max(0.0, 1 - quantile(1 - tail, x, y) + quantile(tail, x, y))) if x > 0 and y > 0 else None for x, y in zip(xs, ys)], dtype="float64")

    return F.pandas_udf(sure, "double")(a.cast("double"), b.cast("double"))


def topic_profile(attempts: DataFrame, signals: DataFrame, now: float, topics: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per topic with attempts or asks (ask-only topics must be in ``topics``, if given): counts, mastery,
    P(θ < 0.6), memory strength and the flags weak, insufficient, ask_unverified and due_for_review."""
    asks = ask_signals(signals)
    if topics is not None:
        asks = asks.join(topics.select("domain").distinct(), "domain", "left_semi")
    both = topic_accuracy(attempts).join(asks, "domain", "full_outer")
    n, c = F.coalesce("attempts", F.lit(0)), F.coalesce("correct", F.lit(0))
    wrong = n - c
    days = (F.lit(now) - F.col("last_at")) / 86400.0
    below = F.when(n > 0, F.round(probability_below(c + 1, wrong + 1, settings.weak_threshold), 6))
    strength = F.when(n > 0, F.round(memory_strength(days, settings.half_life_days), 6)).otherwise(1.0)
    told = both.select(
        "domain", n.alias("attempts"), c.alias("correct"), F.coalesce("asks", F.lit(0)).alias("asks"), mastery(c, wrong).alias("mastery"), below.alias("p_below"), strength.alias("memory_strength"),
        (n < 2).alias("insufficient"),
    )
    return told.select(
        "*",
        (~F.col("insufficient") & (F.coalesce("p_below", F.lit(0.0)) > settings.weak_probability)).alias("weak"),
        ((F.col("asks") >= settings.ask_min) & F.col("insufficient")).alias("ask_unverified"),
        (~F.col("insufficient") & (F.col("memory_strength") <= settings.due_strength)).alias("due_for_review"),
    )


def full_profile(attempts: DataFrame, signals: DataFrame, now: float, topics: DataFrame | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """topic_profile with ``accuracy``, ``confidence``, ``last_seen_days``, ``rating``, ``streak`` and ``best_streak``. Topics without
    attempts have the first rating, no streak and no accuracy, confidence or last day."""
    named = attempts.where("domain is not null")
    told = topic_profile(attempts, signals, now, topics, settings).join(replay(named, "domain", settings), "domain", "left").join(streaks(named, "domain"), "domain", "left")
    last = topic_accuracy(attempts).select("domain", F.round((F.lit(now) - F.col("last_at")) / 86400.0, 6).alias("last_seen_days"))
    wrong = F.col("attempts") - F.col("correct")
    return told.join(last, "domain", "left").select(
        *[c for c in told.columns if c not in ("elo", "streak", "best_streak")],
        F.when(F.col("attempts") > 0, F.round(F.col("correct") / F.col("attempts"), 4)).alias("accuracy"),
        F.when(F.col("attempts") > 0, F.round(confidence(F.col("correct") + 1, wrong + 1), 4)).alias("confidence"),
        "last_seen_days",
        F.round(F.coalesce("elo", F.lit(settings.elo_start)), 1).alias("rating"),
        F.coalesce("streak", F.lit(0)).alias("streak"),
        F.coalesce("best_streak", F.lit(0)).alias("best_streak"),
    )


def flagged_topics(profile: DataFrame) -> DataFrame:
    """``flag``, ``domain``: topics that are weak, due for review (and practised enough to tell) or only asked about."""
    flags = {"weak": F.col("weak"), "review_due": ~F.col("insufficient") & F.col("due_for_review"), "ask_unverified": F.col("ask_unverified")}
    return profile.select("domain", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()]))).alias("flag")).select("flag", "domain")


def summary(profile: DataFrame, cards: DataFrame, now: float) -> DataFrame:
    """One row: attempts, accuracy over all, topics by flag, and cards that are due."""
    totals = profile.agg(
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("total_attempts"), F.coalesce(F.sum("correct"), F.lit(0)).alias("total_correct"), F.count_if("weak").alias("weak_topics"),
        F.count_if(~F.col("insufficient") & F.col("due_for_review")).alias("due_topics"), F.count_if("ask_unverified").alias("unverified_topics"),
    )
    due = cards.agg(F.count_if(F.col("due") <= now).alias("due_cards"))
    accuracy = F.when(F.col("total_attempts") > 0, F.round(F.col("total_correct") / F.col("total_attempts"), 4))
    return totals.crossJoin(F.broadcast(due)).withColumn("total_accuracy", accuracy).drop("total_correct")  # one row each


def simulated_attempts(abilities: DataFrame, per_topic: int, seed: int, now: float) -> DataFrame:
    """Attempts of a student who answers a topic right with the chance ``ability``: one a day, the last a day before ``now``. The
    draws are hashes of seed, topic and number. abilities: domain, ability."""
    told = abilities.select("domain", "ability", F.explode(F.sequence(F.lit(1), F.lit(per_topic))).alias("k"))
    name = F.concat_ws("|", "domain", F.col("k").cast("string"))
    return told.select(
        F.xxhash64(name).alias("id"), F.concat(F.lit("sim_"), name).alias("question_id"), "domain", F.lit("A").alias("choice"),
        (uniform(name, seed) <= F.col("ability")).alias("correct"), (F.lit(now) - (per_topic + 1 - F.col("k")) * 86400.0).alias("answered_at"),
    )


def topic_status(profile: DataFrame) -> Column:
    """The first that holds: weak, ask_unverified, insufficient, due, normal."""
    return F.when(profile.weak, "weak").when(profile.ask_unverified, "ask_unverified").when(profile.insufficient, "insufficient").when(profile.due_for_review, "due").otherwise("normal")


def topic_weights(topics: DataFrame, profile: DataFrame, elo: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``domain``, ``weight``, ``share``: how often a topic should be practised. profile: see topic_profile; elo: domain, elo.

    A topic never seen weighs 0.5; else the gap to 2000 (0.1 at least), times 1.8 where weak, 1.3 where due; three or more
    asks on a topic that is weak or little practised weigh 0.5 at least, times the bonus.
    """
    told = topics.select("domain").distinct().join(profile, "domain", "left").join(elo, "domain", "left")
    rating = F.coalesce("elo", F.lit(settings.elo_start))
    gap = F.greatest(F.lit(0.1), (2000 - rating) / 2000)
    base = F.when(F.col("attempts").isNull(), 0.5).otherwise(gap * F.when(F.col("weak"), 1.8).otherwise(1.0) * F.when(F.col("due_for_review"), 1.3).otherwise(1.0))
    asked = (F.coalesce("asks", F.lit(0)) >= settings.ask_min) & (F.coalesce("insufficient", F.lit(True)) | F.coalesce("weak", F.lit(False)))
    weight = F.when(asked, F.greatest(base, F.lit(0.5)) * settings.ask_bonus).otherwise(base)
    out = told.select("domain", weight.alias("w"))
    total = out.agg(F.sum("w").alias("t"))
    return out.crossJoin(F.broadcast(total)).select("domain", F.round("w", 6).alias("weight"), F.round(F.col("w") / F.col("t"), 6).alias("share"))


def uniform(key: Column, seed: int) -> Column:
    """A number above 0 and up to 1 from the hash of seed and key, the same in any engine with md5."""
    return (F.conv(F.left(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), F.lit(8)), 16, 10).cast("double") + 1) / 4294967296.0


def weighted_sample(df: DataFrame, key: str, weight: str, k: int, seed: int) -> DataFrame:
    """k rows drawn without replacement, with chances by weight; rows with no weight are never drawn."""
    return df.where(F.col(weight) > 0).withColumn("draw", -F.log(uniform(F.col(key), seed)) / F.col(weight)).orderBy("draw", key).limit(k)


def uniform_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    return df.withColumn("draw", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).orderBy("draw", key).limit(k)


def available_pool(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Questions with an answer, without review flag or dup_of, and never answered right; all of them if none is left."""
    pool = questions.where((F.coalesce("answer", F.lit("")) != "") & ~F.coalesce("needs_review", F.lit(False)) & (F.coalesce(F.trim("dup_of"), F.lit("")) == ""))
    right = attempts.where("correct").select(F.col("question_id").alias("id")).distinct()
    fresh = pool.join(right, "id", "left_anti")
    some = fresh.limit(1).agg(F.count(F.lit(1)).alias("some"))
    return fresh.unionByName(pool.crossJoin(F.broadcast(some)).where("some = 0").drop("some"))


def latest_wrong(attempts: DataFrame) -> DataFrame:
    """``question_id``, ``choice``, ``answered_at`` of the last wrong answer to each question."""
    return attempts.where("not correct").groupBy("question_id").agg(F.max(F.struct("answered_at", "id", "choice")).alias("x")).select("question_id", "x.choice", "x.answered_at")


def recent_wrong(attempts: DataFrame, n: int) -> DataFrame:
    """Up to n different questions answered wrong, from the newest 3n wrong answers, newest first."""
    last = attempts.where("not correct").orderBy(F.col("answered_at").desc(), F.col("id").desc()).limit(3 * n)
    w = Window.partitionBy("question_id").orderBy(F.col("answered_at").desc(), F.col("id").desc())
    return last.withColumn("__n", F.row_number().over(w)).where("__n = 1").orderBy(F.col("answered_at").desc(), F.col("id").desc()).limit(n).select("question_id", "choice", "answered_at")
