"""Subject areas of each document: one-versus-rest linear classifiers on hashed n-grams, trained on weak labels.

Chinese has no spaces, so the words are the character n-grams (2 to 4) of a clause. A question is cut into clauses;
each clause is a training case with the weak label of its record, and each clause is classified by itself, so a
second subject that takes only one clause isn't outvoted by the first. A clause that names a subject only to set
it aside ("... 不在本次范围内") counts for nothing. Thresholds are calibrated per area on held-out clauses.

Weak labels: the ``domain`` column where it is spelt as in the vocabulary (also several joined), and the topic in
the path ``<topic>_<version>`` of a courseware piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mulberry.llm.lookalikes import ScriptModel, without_number
from mulberry.llm.near_duplicates import mix
from mulberry.operators.records import trim_blank

BITS = 17
#: Bound of the labelled rows that are fetched for training, from questions and from courseware each.
TRAIN_ROWS = 6_000
# What sets a subject aside.
SET_ASIDE = re.compile(
    r"至于.*则|另行?处[理置]|另处行理|不在.{0,8}(?:范围|之列|讨论|考虑)|(?:与|和|跟|同).*[无没]关|^无关|不涉及|不(?:予|作|再)?(?:讨论|考虑|展开|赘述)|除外$|(?:排除|撇开|抛开)|不属于.{0,6}范围|暂不"
)
_CLAUSE = re.compile(r"[。；;，,？?！!：:（）()\n\r…]+")


def clauses(fold, stem: str | None) -> list[str]:
    """The clauses of a stem in the consistent form, without number and without clauses that set something aside; all
    numbers count alike."""
    if not stem:
        return []
    return [c for c in _CLAUSE.split(re.sub(r"\d+", "0", without_number(fold(stem)).lower())) if len(c) > 1 and not SET_ASIDE.search(c)]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts in a row, and the number of features of each text."""
    codes = np.frombuffer("\0\0\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes + 3)[: len(codes)]
    parts, owners = [], []
    key = codes
    for width in (2, 3, 4):
        if len(codes) < width:
            break
        key = mix(key[:-1] ^ (codes[width - 1 :] << np.uint64(32)), width)
        inside = codes[width - 1 :] > 0
        for i in range(width - 1):
            inside = inside & (codes[i : len(codes) - width + 1 + i] > 0)
        parts.append((key >> np.uint64(64 - BITS)).astype(np.int64)[inside])
        owners.append(owner[: len(inside)][inside])
    if not parts:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(parts)[order], np.bincount(owner, minlength=len(texts))


class SubjectModel:
    """Weights of one linear classifier per area, with its threshold."""

    def __init__(self, areas: list[str], weights: np.ndarray, bias: np.ndarray, thresholds: np.ndarray):
        self.areas, self.weights, self.bias, self.thresholds = areas, weights, bias, thresholds

    def scores(self, texts: list[str]) -> np.ndarray:
        features, sizes = hashed(texts)
        out = np.tile(self.bias, (len(texts), 1)).astype(np.float32)
        if len(features):
            full = np.flatnonzero(sizes)
            at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            out[full] += np.add.reduceat(self.weights[features], at, axis=0) / np.sqrt(sizes[full])[:, None]
        return out


def train(areas: list[str], texts: list[str], owner: np.ndarray, truth: np.ndarray, updates: int = 1500, rate: float = 0.5, batch: int = 256, seed: int = 7) -> SubjectModel:
    """Logistic loss, Adagrad. texts: clauses; owner: the record of each; truth: records by areas. A fifth of the
    records is held out: an area's threshold is the middle of those with the best F1 of its records."""
    k = len(areas)
    rng = np.random.default_rng(seed)
    held = rng.random(len(truth)) < 0.2
    used = np.flatnonzero(~held[owner])
    weights, squares = np.zeros((1 << BITS, k), np.float32), np.full((1 << BITS, k), 1e-3, np.float32)
    bias, bias_squares = np.full(k, -2.0), np.full(k, 1e-2)
    done = 0
    while done < updates and len(used):
        rng.shuffle(used)
        for i in range(0, len(used), batch):
            rows = used[i : i + batch]
            chosen = [texts[r] for r in rows]
            error = 1 / (1 + np.exp(-SubjectModel(areas, weights, bias, bias).scores(chosen))) - truth[owner[rows]]
            features, sizes = hashed(chosen)
            scaled = (error / np.sqrt(np.maximum(sizes, 1))[:, None])[np.repeat(np.arange(len(rows)), sizes)]
            seen, place = np.unique(features, return_inverse=True)
            g = np.stack([np.bincount(place, weights=scaled[:, c], minlength=len(seen)) for c in range(k)], axis=1) / batch
            squares[seen] += g * g
            weights[seen] -= rate * g / np.sqrt(squares[seen])
            g = error.mean(axis=0)
            bias_squares += g * g
            bias -= 0.1 * g / np.sqrt(bias_squares)
            done += 1
    model = SubjectModel(areas, weights, bias.astype(np.float32), np.zeros(k, np.float32))
    rows = np.flatnonzero(held[owner])
    best = np.full((len(truth), k), -9.0)
    np.maximum.at(best, owner[rows], model.scores([texts[r] for r in rows]))
    for c in range(k):
        right, s = truth[held, c] > 0, best[held, c]
        grid = np.linspace(-4, 3, 71)
        f1 = np.array([2 * (right & (s >= t)).sum() / max(1, right.sum() + (s >= t).sum()) for t in grid])
        model.thresholds[c] = grid[f1 >= f1.max() - 0.004].mean()
    return model


def _sampled(df: DataFrame, key: str, bound: int) -> list:
    """At most about ``bound`` rows, chosen by the hash of their key; all where there are no more."""
    share = bound / max(1, df.count())
    return (df if share >= 1 else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))).collect()


def fit_subjects(questions: DataFrame, courseware: DataFrame, topics: DataFrame, rows: int = TRAIN_ROWS) -> SubjectModel:
    """Train on at most ``rows`` labelled questions and as many courseware pieces."""
    areas = [r.domain for r in topics.where("domain is not null").select("domain").distinct().orderBy("domain").collect()]
    named = F.filter(F.transform(F.split("domain", "[、；;/，,]"), trim_blank), lambda d: d.isin(*areas))
    labelled = questions.select("id", "stem", named.alias("names")).where((F.size("names") > 0) & F.col("stem").isNotNull())
    cases = [(r.stem, r.names) for r in _sampled(labelled, "id", rows)]
    path = F.substring_index("source", "_", 1)
    pieces = courseware.where(path.isin(*areas) & F.col("text").isNotNull()).select("id", "text", path.alias("name"))
    cases += [(r.text, [r.name]) for r in _sampled(pieces, "id", rows)]
    fold = ScriptModel([]).fold
    number = {a: i for i, a in enumerate(areas)}
    texts: list[str] = []
    owner: list[int] = []
    truth = np.zeros((len(cases), len(areas)), np.float32)
    for i, (text, names) in enumerate(cases):
        truth[i, [number[n] for n in names]] = 1
        own = clauses(fold, text)
        texts += own
        owner += [i] * len(own)
    if not texts:
        return SubjectModel(areas, np.zeros((1 << BITS, len(areas)), np.float32), np.full(len(areas), -9.0, np.float32), np.zeros(len(areas), np.float32))
    return train(areas, texts, np.array(owner), truth)


def subject_areas(questions: DataFrame, model: SubjectModel) -> DataFrame:
    """``id``, ``domain``: one row per record and area that one of its clauses is about.

    A null, empty or blank stem has no area; repeated rows are classified alike. Works on the columns id and stem
    only; an empty table gives an empty result.
    """

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold = ScriptModel([]).fold
        names = np.array(model.areas, dtype=object)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                cut = [clauses(fold, s) for s in part["stem"]]
                owner = np.repeat(np.arange(len(part)), [len(c) for c in cut])
                flat = [c for own in cut for c in own]
                if not flat:
                    continue
                hit = model.scores(flat) >= model.thresholds
                clause, area = np.nonzero(hit)
                found = np.unique(owner[clause] * len(names) + area)
                yield pd.DataFrame({"id": part["id"].to_numpy()[found // len(names)], "domain": names[found % len(names)]})

    return questions.select(F.col("id").cast("string").alias("id"), F.col("stem").cast("string").alias("stem")).mapInPandas(classify, "id string, domain string")


def subject_shares(questions: DataFrame, areas: DataFrame) -> DataFrame:
    """``domain``, ``questions``, ``share`` (of all rows of the bank; shares may add up to more than 1)."""
    total = questions.agg(F.count(F.lit(1)).alias("n"))
    return areas.groupBy("domain").agg(F.count(F.lit(1)).alias("questions")).crossJoin(F.broadcast(total)).select("domain", "questions", F.round(F.col("questions") / F.col("n"), 6).alias("share"))
