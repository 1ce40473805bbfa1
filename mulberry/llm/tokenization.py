"""Byte-level BPE encoding of whole texts by dynamic programming over prefixes.

For every prefix of a piece of text there is exactly one token that can end its encoding: the token t that is a
suffix of the prefix and goes with the last token of the prefix before t. The suffixes come from an automaton
over the vocabulary; whether two tokens may stand side by side is decided by undoing their merges (and kept in a
table). Following the back-pointers from the end gives exactly the ids that applying all merges in order gives.

The vocabulary file is read where the work is done; its folder is a parameter. Special tokens don't exist here, so
text that looks like one is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
# Fixed value: the published pattern that cuts a text into pieces before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT_PIECES, KEPT_PAIRS = 200_000, 2_000_000


class Encoder:
    """Encodes texts by one vocabulary of ranks (a token's id is the order of its merge)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.cut = regex.compile(PATTERN)
        self.automaton = ahocorasick.Automaton()
        for token, number in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (number, len(token)))
        self.automaton.make_automaton()
        self.joined: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}
        for token, number in sorted(ranks.items(), key=lambda x: x[1]):
            self.halves[number] = (number, number)
            for at in range(1, len(token)):
                a, b = ranks.get(token[:at]), ranks.get(token[at:])
                if a is not None and b is not None and a < number and b < number and self.stand(a, b):
                    self.halves[number] = (a, b)
                    self.joined[a, b] = number
                    break

    def stand(self, a: int, b: int) -> bool:
        """Whether the merges leave the tokens a and b side by side. The merges of both are undone from the last one;
        a merge across the border that came before the next one to undo would have taken place."""
        before = 1 << 30
        joined, halves = self.joined, self.halves
        while True:
            across = joined.get((a, b))
            if across is not None and across < before:
                return False
            if a > b:
                order = ((a, True), (b, False))
            else:
                order = ((b, False), (a, True))
            for token, on_left in order:
                half = halves[token][1 if on_left else 0]
                if half != token:
                    before = token if on_left else token + 1
                    if on_left:
                        a = half
                    else:
                        b = half
                    break
            else:
                return True

    def piece(self, text: str) -> list[int]:
        """The ids of one piece."""
        known = self.pieces.get(text)
        if known is not None:
            return known
        raw = text.encode("utf-8", "replace")
        whole = self.ranks.get(raw)
        if whole is not None:
            ids = [whole]
        else:
            pairs, stand = self.pairs, self.stand
            last, width = [-1] * len(raw), [0] * len(raw)
            for end, (token, size) in self.automaton.iter(raw.decode("latin-1")):
                if last[end] >= 0:
                    continue
                start = end - size
                if start >= 0:
                    key = last[start] << 20 | token
                    fits = pairs.get(key)
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            pairs.clear()
                        fits = pairs[key] = stand(last[start], token)
                    if not fits:
                        continue
                last[end], width[end] = token, size
            ids, at = [], len(raw) - 1
            while at >= 0:
                ids.append(last[at])
                at -= width[at]
            ids.reverse()
        if len(self.pieces) >= KEPT_PIECES:
            self.pieces.clear()
        if len(text) < 200:
            self.pieces[text] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a whole text; none for null and empty texts."""
        ids: list[int] = []
        for piece in self.cut.findall(text or ""):
            ids += self.piece(piece)
        return ids


@lru_cache(maxsize=2)
def encoder(folder: str = FOLDER, name: str = TOKENIZER) -> Encoder:
    """The encoder of a vocabulary file, built once for each Python worker."""
    with open(f"{folder}/{name}.tiktoken", "rb") as lines:
        return Encoder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row, without special tokens; null and empty texts give an empty
    array. Repeated rows are encoded each; further columns are not read."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(folder, name)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "ids": [coder.encode(t) for t in batch[text]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias(text)).mapInPandas(encode, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = FOLDER, name: str = TOKENIZER) -> DataFrame:
    """``key`` and ``n_tokens`` (0 for null and empty texts) of every row; the ids stay in the workers."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoder(folder, name)
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "n_tokens": [len(coder.encode(t)) for t in batch[text]]})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text).cast("string").alias(text)).mapInPandas(count, f"`{key}` {kind}, n_tokens int")
