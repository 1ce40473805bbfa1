"""Structured Streaming: tumbling counts, sessions, rate limits and running topic state, each with a batch twin.

Streams need TIMESTAMP event times: columns without zone are cast first. Late rows beyond the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mulberry.config import DEFAULTS
from mulberry.operators import schedule


def event_time(df: DataFrame, column: str) -> DataFrame:
    """The column as TIMESTAMP, as watermarks need it; epoch seconds are accepted too."""
    c = F.timestamp_seconds(F.col(column)) if dict(df.dtypes)[column] in ("double", "bigint") else F.col(column).cast("timestamp")
    return df.withColumn(column, c)


def tumbling_counts(events: DataFrame, time: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``start``, by, ``n`` for windows of equal width; streaming or batch."""
    told = event_time(events, time).withWatermark(time, late)
    return told.groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, time: str, by: str, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """by, ``start``, ``end`` (gap included), ``n`` of sessions; streaming or batch."""
    told = event_time(events, time).withWatermark(time, late)
    return told.groupBy(F.session_window(time, gap), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def denied(events: DataFrame, by: str, order: Column, micros: str, limit: int, seconds: int) -> DataFrame:
    """by, ``hits``, ``denied``: a window starts with a key's first hit and again with the first hit after it ended; hits
    beyond ``limit`` in a window are denied. micros: event time in microseconds (a null one doesn't count); order: further order of
    hits of one time, which changes no count.

    Rows are sorted within partitions by key and time and folded as they stream by, so a task holds one batch and two
    numbers, however many hits a key has.
    """
    width = seconds * 1_000_000
    kind = events.schema[by].dataType.simpleString()

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, start, n, hits, over = None, 0, 0, 0, 0
        for rows in batches:
            done = []
            for key, t in zip(rows["k"], rows["t"].tolist()):
                if hits == 0 or key != now:
                    if hits:
                        done.append((now, hits, over))
                    now, start, n, hits, over = key, t, 0, 0, 0
                if t - start >= width:
                    start, n = t, 0
                n, hits = n + 1, hits + 1
                over += n > limit
            yield pd.DataFrame(done, columns=["k", "hits", "denied"])
        if hits:
            yield pd.DataFrame([(now, hits, over)], columns=["k", "hits", "denied"])

    told = events.select(F.col(by).alias("k"), F.col(micros).alias("t")).where("k is not null and t is not null")
    folded = told.repartition("k").sortWithinPartitions("k", "t").mapInPandas(fold, f"k {kind}, hits bigint, denied bigint")
    return folded.select(F.col("k").alias(by), "hits", "denied")


def cache_hits(lookups: DataFrame, by: str, micros: str, seconds: int) -> DataFrame:
    """by, ``lookups``, ``hits`` of a cache whose entries live for ``seconds`` from when they were written: a lookup without a live
    entry writes one, every other hits. The same fold as a limit of one hit a window."""
    return denied(lookups, by, F.col(micros), micros, 1, seconds).select(by, F.col("hits").alias("lookups"), F.col("denied").alias("hits"))


def _expire(state: GroupState, at_ms: int) -> None:
    """Let a state end once the watermark has passed ``at_ms``."""
    state.setTimeoutTimestamp(max(at_ms, state.getCurrentWatermarkMs()) + 1)


def rate_limit_stream(events: DataFrame, by: str, time: str, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The same as a stream: by, ``time``, ``allowed`` for every hit. State per key: window start and count, until the watermark
    has passed the window's end."""

    def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values("t")
        out = []
        for t in rows["t"]:
            if n == 0 or t - start >= seconds * 1_000_000:
                start, n = int(t), 0
            n += 1
            out.append(n <= limit)
        state.update((start, n))
        _expire(state, start // 1000 + seconds * 1000)
        yield pd.DataFrame({"k": key[0], "t": rows["t"].to_numpy(), "allowed": out})

    # a millisecond later, as the first watermark is the epoch and what lies on it counts as late
    told = event_time(events, time).withColumn("__time", F.col(time) + F.expr("INTERVAL 1 MILLISECOND")).withWatermark("__time", late).select("__time", F.col(by).cast("string").alias("k"), F.unix_micros(F.col(time)).alias("t"))
    return told.groupBy("k").applyInPandasWithState(admit, "k string, t bigint, allowed boolean", "start bigint, n bigint", "append", GroupStateTimeout.EventTimeTimeout)


def cache_stream(lookups: DataFrame, by: str, time: str, seconds: int, late: str = "10 minutes") -> DataFrame:
    """by, ``time``, ``hit`` of every lookup: whether an entry of the key was live; entries end with their time to live."""
    return rate_limit_stream(lookups, by, time, 1, seconds, late).select("k", "t", (~F.col("allowed")).alias("hit"))


def running_topics(attempts: DataFrame) -> DataFrame:
    """The running count and number right of each topic as a stream: domain, ``attempts``, ``correct`` (update mode). One state a
    topic, of which a vocabulary has few; they don't end."""

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, c = state.get if state.exists else (0, 0)
        for rows in batches:
            n, c = n + len(rows), c + int(rows["correct"].sum())
        state.update((n, c))
        yield pd.DataFrame({"domain": [key[0]], "attempts": [n], "correct": [c]})

    told = attempts.where("domain is not null").select("domain", "correct")
    return told.groupBy("domain").applyInPandasWithState(add, "domain string, attempts bigint, correct bigint", "n bigint, c bigint", "update", GroupStateTimeout.NoTimeout)


def running_profiles(attempts: DataFrame, start: float = DEFAULTS.elo_start, k: float = DEFAULTS.elo_k) -> DataFrame:
    """Rating, streaks and mastery of each topic as a stream (update mode): domain, ``attempts``, ``correct``, ``elo``, ``streak``,
    ``best_streak``, ``mastery``. attempts: domain, id, correct, answered_at.

    Answers of one batch are put in order; an answer older than what its topic has seen is folded where it arrives, so the
    batch operators (replay, streaks) are the truth for late data. One state a topic; they don't end.
    """

    def add(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, c, r, now, best = state.get if state.exists else (0, 0, start, 0, 0)
        for ok in pd.concat(list(batches)).sort_values(["answered_at", "id"])["correct"].astype(int).tolist():
            n, c = n + 1, c + ok
            r += k * (ok - 1 / (1 + 10.0 ** ((1500.0 + (c / n - 0.5) * 800.0 - r) / 400.0)))
            now = now + 1 if ok else 0
            best = max(best, now)
        state.update((n, c, r, now, best))
        yield pd.DataFrame({"domain": [key[0]], "attempts": [n], "correct": [c], "elo": [r], "streak": [now], "best_streak": [best], "mastery": [round((c + 1) / (n + 2), 4)]})

    told = attempts.where("domain is not null and correct is not null and answered_at is not null").select("domain", "id", "correct", "answered_at")
    out = "domain string, attempts bigint, correct bigint, elo double, streak bigint, best_streak bigint, mastery double"
    return told.groupBy("domain").applyInPandasWithState(add, out, "n bigint, c bigint, r double, now bigint, best bigint", "update", GroupStateTimeout.NoTimeout)


def running_cards(attempts: DataFrame, late: str = "10 minutes", weights: Sequence[float] = schedule.WEIGHTS) -> DataFrame:
    """Review cards as a stream (append mode): question_id, ``event``, ``at``, ``due``, ``stability``, ``reps``. A row ``card`` after the answers of
    each batch, and a row ``due`` once the watermark has passed the card's due time, unless another answer came first.

    attempts: question_id, id, correct, answered_at (epoch seconds). The card stays in the state; its timer is the due time.
    """
    names = ("state", "step", "stability", "difficulty", "due", "last_review", "reps", "lapses")
    kept = "state int, step int, stability double, difficulty double, due double, last_review double, reps int, lapses int"

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        row = lambda card, event, at: pd.DataFrame({"question_id": [key[0]], "event": [event], "at": [at], "due": [card["due"]], "stability": [card["stability"]], "reps": [card["reps"]]}).astype({"reps": "int32"})
        card = dict(zip(names, state.get)) if state.exists else None
        if state.hasTimedOut:
            yield row(card, "due", card["due"])
            return
        if card is not None and card["step"] < 0:
            card["step"] = None
        for at, ok in pd.concat(list(batches)).sort_values(["answered_at", "id"])[["answered_at", "correct"]].itertuples(index=False):
            card = schedule.review(card, bool(ok), float(at), weights)
        state.update(tuple(-1 if card[n] is None else card[n] for n in names))
        _expire(state, int(card["due"] * 1000))
        yield row(card, "card", card["last_review"])

    told = attempts.where("question_id is not null and correct is not null and answered_at is not null").withColumn("__time", F.timestamp_seconds("answered_at")).withWatermark("__time", late)
    out = "question_id string, event string, at double, due double, stability double, reps int"
    return told.select("question_id", "id", "correct", "answered_at", "__time").groupBy("question_id").applyInPandasWithState(fold, out, kept, "append", GroupStateTimeout.EventTimeTimeout)


def run_available(stream: DataFrame, name: str, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table of the session's memory; for tests and small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
