"""Oversized texts cut at natural boundaries, with an overlap between consecutive pieces.

A text starts as atomic segments between all its boundaries (paragraph, line, sentence, clause, word, character
cluster). Adjacent segments wait in a heap by the strength of the boundary between them, then by their joint
size; the weakest boundary is merged first as long as the joint size plus the overlap fits. When nothing fits
any more, every piece takes the end of the piece before it as overlap, from the strongest boundary within reach.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 100
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, CLUSTER = 5, 4, 3, 2, 1, 0
_MARKS = (
    (PARAGRAPH, regex.compile(r"(?:\r\n|\r|\n)[ \t　]*(?:\r\n|\r|\n)\s*")),
    (LINE, regex.compile(r"\r\n|\r|\n| | ")),
    (SENTENCE, regex.compile(r"(?:[。！？!?；;…]+|\.(?=\s|$))[”’」』）)\]\"']*[ \t　]*")),
    (CLAUSE, regex.compile(r"[，,、：:][”’」』）)\"']*[ \t　]*")),
    (WORD, regex.compile(r"\s+|(?<=[\p{Han}])(?=[^\p{Han}\p{P}\s\p{M}])|(?<=[^\p{Han}\s])(?=\p{Han})")),
)
_CLUSTERS = regex.compile(r"\X")


def boundaries(text: str, longest: int) -> dict[int, int]:
    """Offset and strength of every boundary inside the text; stretches without any that are longer than
    ``longest`` are cut between character clusters."""
    strength: dict[int, int] = {}
    for level, mark in _MARKS:
        for m in mark.finditer(text):
            if 0 < m.end() < len(text) and level > strength.get(m.end(), -1):
                strength[m.end()] = level
    if "\r\n" in text:
        strength = {at: s for at, s in strength.items() if not (text[at - 1] == "\r" and text[at] == "\n")}
    edges = [0, *sorted(strength), len(text)]
    for a, b in zip(edges, edges[1:]):
        if b - a > longest:
            start = a
            for m in _CLUSTERS.finditer(text, a, b):
                while m.end() - start > longest:  # a cluster alone may be too long: then within it
                    at = m.start() if m.start() > start else start + longest
                    strength[at] = CLUSTER
                    start = at
    return strength


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Start, length and number of characters shared with the piece before, for each piece of the text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text), 0)] if text else []
    room = limit - overlap
    strength = boundaries(text, room)
    starts = [0, *sorted(strength)]
    n = len(starts)
    ends = [*starts[1:], len(text)]
    left, right, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
    heap = [(strength[ends[i]], ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if gone[i] or gone[j] or right[i] != j or ends[j] - starts[i] != size:
            continue
        if size > (limit if i == 0 else room):
            continue
        ends[i], gone[j], right[i] = ends[j], True, right[j]
        if right[j] < n:
            left[right[j]] = i
            heapq.heappush(heap, (strength[ends[i]], ends[right[i]] - starts[i], i, right[i]))
        if left[i] >= 0:
            k = left[i]
            heapq.heappush(heap, (strength[starts[i]], ends[i] - starts[k], k, i))
    pieces, marks = [], sorted(strength)
    for i in range(n):
        if gone[i]:
            continue
        start = starts[i]
        if pieces and overlap:
            start = _overlap_start(text, marks, strength, max(pieces[-1][0], starts[i] - overlap), starts[i])
        pieces.append((start, ends[i] - start, starts[i] - start))
    return pieces


def _overlap_start(text: str, marks: list[int], strength: dict[int, int], lowest: int, end: int) -> int:
    """Where the overlap starts: at the strongest boundary from ``lowest`` on, the earliest of equals; without any,
    at the first character cluster."""
    from bisect import bisect_left

    within = marks[bisect_left(marks, lowest) : bisect_left(marks, end)]
    if lowest == 0 and end:
        return 0
    if within:
        return max(within, key=lambda at: (min(strength[at], SENTENCE), -at))
    for m in _CLUSTERS.finditer(text, max(0, lowest - 40), end):
        if m.start() >= lowest:
            return m.start()
    return end


PIECES = "id string, piece int, start int, n_chars int, shared int, text string"


def pieces(df: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every text in order: ``id``, ``piece`` (from 0), ``start``, ``n_chars``, ``shared`` (characters in
    common with the piece before), ``text``.

    A text within the limit is one piece and never leaves the JVM; null and empty texts give no piece. Repeated ids
    give repeated pieces. A single very long text is cut in one task, in time n log n.
    """
    plain = df.select(F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    size = F.length("text")
    short = plain.where((size > 0) & (size <= limit)).select("id", F.lit(0).alias("piece"), F.lit(0).alias("start"), size.alias("n_chars"), F.lit(0).alias("shared"), "text")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, n, a, k, s, t[a : a + k]) for i, t in zip(batch["id"], batch["text"]) for n, (a, k, s) in enumerate(cut(t, limit, overlap))]
            yield pd.DataFrame(rows, columns=["id", "piece", "start", "n_chars", "shared", "text"])

    return short.unionByName(plain.where(size > limit).mapInPandas(split, PIECES))


def oversized(df: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``id`` of every text that had to be cut: those that have a second piece."""
    return pieces(df, key, text, limit, overlap).where("piece = 1").select("id")
