"""Spaced repetition: the published FSRS-6 formulas, folded over each question's answers in order of time.

Only the ratings Again (wrong) and Good (right) occur. No fuzz, so the same answers give the same cards. The weights
are a parameter; the defaults are the published ones, from memory, and should be checked before use.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Default weights, learning steps in seconds.
WEIGHTS = (0.212, 1.2931, 2.3065, 8.2956, 6.4133, 0.8334, 3.0194, 0.001, 1.8722, 0.1666, 0.796, 1.4835, 0.0614, 0.2629, 1.6483, 0.6014, 1.8729, 0.5425, 0.0912, 0.0658, 0.1542)
LEARNING, RELEARNING = (60.0, 600.0), (600.0,)
RETENTION, DAY = 0.9, 86400.0
AGAIN, GOOD = 1, 3

CARD = "question_id string, state int, step int, stability double, difficulty double, due double, last_review double, reps int, lapses int"


def _difficulty0(w: Sequence[float], grade: int) -> float:
    return min(10.0, max(1.0, w[4] - math.exp(w[5] * (grade - 1)) + 1))


def review(card: dict | None, ok: bool, now: float, w: Sequence[float] = WEIGHTS) -> dict:
    """The card after one answer. States: 1 learning, 2 review, 3 relearning."""
    grade = GOOD if ok else AGAIN
    if card is None:
        new = {"state": 1, "step": 0, "stability": w[grade - 1], "difficulty": _difficulty0(w, grade), "reps": 0, "lapses": 0}
    else:
        days = max(0.0, (now - card["last_review"]) / DAY)
        s, d = card["stability"], card["difficulty"]
        factor = RETENTION ** (-1 / w[20]) - 1
        recall = (1 + factor * days / s) ** -w[20]
        if days < 1:
            gain = math.exp(w[17] * (grade - 3 + w[18])) * s ** -w[19]
            s2 = s * (max(gain, 1.0) if ok else gain)
        elif ok:
            s2 = s * (1 + math.exp(w[8]) * (11 - d) * s ** -w[9] * (math.exp(w[10] * (1 - recall)) - 1))
        else:
            s2 = min(w[11] * d ** -w[12] * ((s + 1) ** w[13] - 1) * math.exp(w[14] * (1 - recall)), s / math.exp(w[17] * w[18]))
        moved = d - w[6] * (grade - 3) * (10 - d) / 9
        d2 = w[7] * (w[4] - math.exp(w[5] * 3) + 1) + (1 - w[7]) * moved
        new = dict(card, stability=max(0.001, s2), difficulty=min(10.0, max(1.0, d2)))
    interval = max(1.0, round(new["stability"])) * DAY  # at a retention of 0.9 the interval is the stability
    steps = {1: LEARNING, 3: RELEARNING}.get(new["state"], ())
    if new["state"] == 2:
        if ok:
            due = now + interval
        else:
            new["state"], new["step"], due = 3, 0, now + RELEARNING[0]
    elif ok and new["step"] + 1 >= len(steps):
        new["state"], new["step"], due = 2, None, now + interval
    else:
        new["step"] = new["step"] + 1 if ok else 0
        due = now + steps[new["step"]]
    return new | {"due": due, "last_review": now, "reps": new["reps"] + 1, "lapses": new["lapses"] + (not ok)}


def cards(attempts: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """One card per question after all its answers, in the order of time, then id.

    Rows are sorted within partitions by question and time and folded as they stream by, so a task holds one batch
    and one card, however many answers a question has.
    """
    columns = [c.split()[0] for c in CARD.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, card = None, None
        for rows in batches:
            done = []
            for question, at, ok in zip(rows["question_id"], rows["answered_at"], rows["correct"]):
                if question != now:
                    if card is not None:
                        done.append({"question_id": now, **card})
                    now, card = question, None
                card = review(card, bool(ok), float(at), weights)
            yield pd.DataFrame(done, columns=columns).astype({"step": "Int32"})
        if card is not None:
            yield pd.DataFrame([{"question_id": now, **card}], columns=columns).astype({"step": "Int32"})

    told = attempts.where("question_id is not null and answered_at is not null and correct is not null").select("question_id", "id", "correct", "answered_at")
    return told.repartition("question_id").sortWithinPartitions("question_id", "answered_at", "id").mapInPandas(fold, CARD)


def due_cards(cards_: DataFrame, now: float, limit: int) -> DataFrame:
    """The cards that are due, the longest overdue first; ties by question."""
    return cards_.where(F.col("due") <= now).orderBy("due", "question_id").limit(limit)
