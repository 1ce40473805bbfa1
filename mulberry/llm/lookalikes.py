"""One consistent form for text that looks the same on screen but is stored in different characters.

1. Compatibility normalization (NFKC) of everything but characters whose plain form looks different
   (circled, raised, lowered, squared signs and vulgar fractions).
2. Ignorable characters are deleted, every kind of blank becomes a space, hyphen kinds become one.
3. Each run of Latin, Greek and Cyrillic letters is a lattice: every letter may be read as any letter of
   its look-alike class. Viterbi finds the reading with the best character-bigram score, a change of
   script costs ``SWITCH``. The lattice depends on the classes alone, not on which member of a class was
   stored, so two runs that look the same always get the same reading.

The bigram counts come from the whole corpus and are bounded by the square of the fixed alphabet.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections.abc import Iterable
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.session import checkpointed

# Letters of other scripts that look like a Latin letter, and that letter.
LOOKALIKE = {
    **dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜЁЇ", "ABESIJKMHOPCTYXYGQWËÏ")),  # Cyrillic capitals
    **dict(zip("аеоруԁһіјӏԛѕԝхсүёї", "aeopydhijlqswxcyëï")),  # Cyrillic small letters
    **dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧͿϹ", "ABEZHIKMNOPTYXJC")),  # Greek capitals
    **dict(zip("ανορυιϲϳ", "avopuicj")),  # Greek small letters
    **dict(zip("ɑɡıօսհոԼՕՏ", "agiouhnLOS")),  # Latin and Armenian
}
# Characters that don't show, and signs that look like another.
IGNORABLE = "[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￰-￸\U0001bca0-\U0001bca3\U000e0000-\U000e0fff]"
HYPHENS = "[‐‑⁃˗]"
#: Compatibility forms that look different from their plain form.
VISIBLE_TAGS = ("<circle>", "<super>", "<sub>", "<square>", "<fraction>")
SWITCH = 8.0
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏɐ-ʯͰ-ϿЀ-ԯԱ-և]+")
_IGNORABLE, _HYPHENS, _BLANK = re.compile(IGNORABLE), re.compile(HYPHENS), re.compile(r"[^\S ]")
_NUMBER = re.compile(rf"^(?:\s|{IGNORABLE})*(?:[0-9０-９]{IGNORABLE}*){{1,5}}(?:\s|{IGNORABLE})*(?:[、,，:：)）]|[.．](?!\s*[0-9０-９]))(?:\s|{IGNORABLE})*")


def script(letter: str) -> str:
    """The script a letter belongs to, as one letter."""
    code = ord(letter)
    return "g" if 0x370 <= code < 0x400 else "c" if 0x400 <= code < 0x530 else "a" if 0x531 <= code < 0x590 else "l"


@cache
def _protected() -> re.Pattern:
    kept = (chr(c) for c in range(0x80, 0x1F300) if unicodedata.decomposition(chr(c)).startswith(VISIBLE_TAGS))
    return re.compile("([" + re.escape("".join(kept)) + "]+)")


@cache
def _classes() -> dict[str, tuple[str, ...]]:
    """Each letter of a look-alike class with the whole class, the Latin letter first."""
    classes: dict[str, list[str]] = {}
    for other, latin in LOOKALIKE.items():
        classes.setdefault(latin, [latin]).append(other)
    return {letter: tuple(members) for members in classes.values() for letter in members}


class ScriptModel:
    """Character bigrams (``^`` and ``$`` are the ends of a run), smoothed by single letters, with Viterbi decoding."""

    def __init__(self, counts: Iterable[tuple[str, int]]):
        self.counts = dict(counts)
        self.before: dict[str, int] = {}
        self.after: dict[str, int] = {}
        for pair, n in self.counts.items():
            self.before[pair[0]] = self.before.get(pair[0], 0) + n
            self.after[pair[1]] = self.after.get(pair[1], 0) + n
        self.total = sum(self.counts.values())
        self.readings: dict[str, str] = {}

    def score(self, a: str, b: str) -> float:
        alike = a in "^$" or b in "^$" or script(a) == script(b)
        single = (self.after.get(b, 0) + 0.01) / (self.total + 10)
        return math.log((self.counts.get(a + b, 0) + 10 * single) / (self.before.get(a, 0) + 10)) - (0.0 if alike else SWITCH)

    def read(self, run: str) -> str:
        """The best reading of a run of letters; ties go to the Latin letter, then the order of the class."""
        known = self.readings.get(run)
        if known is not None:
            return known
        classes = _classes()
        paths = [(0.0, "^")]
        ways: list[list[int]] = []
        for letter in [*run, "$"]:
            options = classes.get(letter, (letter,))
            step, back = [], []
            for option in options:
                best = max(range(len(paths)), key=lambda i: (paths[i][0] + self.score(paths[i][1], option), -i))
                step.append((paths[best][0] + self.score(paths[best][1], option), option))
                back.append(best)
            paths = step
            ways.append(back)
        at, out = 0, []
        for letter, back in zip(reversed([*run, "$"]), reversed(ways)):
            out.append(classes.get(letter, (letter,))[at])
            at = back[at]
        reading = "".join(reversed(out[1:]))
        if len(self.readings) > 200_000:
            self.readings.clear()
        self.readings[run] = reading
        return reading

    def fold(self, text: str | None) -> str | None:
        """The consistent form of a text (null stays null)."""
        if text is None:
            return None
        if text.isascii():
            return _BLANK.sub(" ", _LETTERS.sub(lambda m: self.read(m[0]), text))
        text = _IGNORABLE.sub("", text)
        text = unicodedata.normalize("NFC", "".join(p if i % 2 else unicodedata.normalize("NFKC", p) for i, p in enumerate(_protected().split(text))))
        text = _BLANK.sub(" ", _HYPHENS.sub("-", _IGNORABLE.sub("", text)))
        return _LETTERS.sub(lambda m: self.read(m[0]), text)


def without_number(stem: str | None) -> str:
    """The stem without the number printed before it; nothing for null."""
    return _NUMBER.sub("", stem or "", count=1).strip()


def option_texts(options: str | None) -> list[tuple[str, str]]:
    """Letter and text of each option in letter order; text that isn't a JSON object is one option without letter."""
    try:
        read = json.loads(options or "{}")
    except ValueError:
        read = None
    if not isinstance(read, dict):
        return [("", options or "")]
    return sorted((str(k).strip(), v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for k, v in read.items())


def script_model(df: DataFrame, *columns: str) -> ScriptModel:
    """Bigram counts over all letter runs of the columns. Only runs that can't be misread count: pure basic
    Latin, or runs of one other script that hold a letter without a Latin look-alike."""
    alone = "[" + "".join(sorted(set("БГДЖЗИЙЛПФЦЧШЩЪЫЬЭЮЯбвгджзийклмнптфцчшщъыьэюяΓΔΘΛΞΠΣΦΨΩβγδεζηθκλμξπσςτφχψω"))) + "]"
    runs = F.regexp_extract_all(F.concat_ws(" ", *[F.col(c) for c in columns]), F.lit("[A-Za-z]+|[Ѐ-ԯ]+|[Ͱ-Ͽ]+"), F.lit(0))
    words = df.select(F.explode(runs).alias("w")).where(F.col("w").rlike("^[A-Za-z]") | F.col("w").rlike(alone))
    ends = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length(ends) - 1), lambda i: F.substring(ends, i, F.lit(2)))).alias("pair"))
    return ScriptModel([(r.pair, r.n) for r in pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()])


FORMS = "stem string, options array<string>, raw_stem string, raw_options array<string>"


def question_forms(model: ScriptModel, stem: str = "stem", options: str = "options") -> Column:
    """Consistent and stored forms of a question: stem without its number, options as ``letter<TAB>text`` in
    letter order. Null stems and options count as empty."""
    counts = list(model.counts.items())
    held: list[ScriptModel] = []

    def forms(stems: pd.Series, texts: pd.Series) -> pd.DataFrame:
        held or held.append(ScriptModel(counts))
        fold = held[0].fold
        rows = []
        for s, o in zip(stems, texts):
            told = option_texts(o)
            rows.append((without_number(fold(s)), [f"{fold(k)}\t{fold(v)}" for k, v in told], without_number(s), [f"{k}\t{v}" for k, v in told]))
        return pd.DataFrame(rows, columns=["stem", "options", "raw_stem", "raw_options"])

    return F.pandas_udf(forms, FORMS)(F.col(stem), F.col(options))


def folded_questions(df: DataFrame) -> DataFrame:
    """``id``, ``stem`` and ``options`` (JSON, letters in order) of every question in the consistent form."""
    f = question_forms(script_model(df, "stem", "options"))
    told = df.select("id", f.alias("f"))
    entries = F.transform("f.options", lambda o: F.struct(F.substring_index(o, "\t", 1).alias("key"), F.regexp_replace(o, "^[^\t]*\t", "").alias("value")))
    return told.select("id", F.col("f.stem").alias("stem"), F.to_json(F.map_from_entries(entries)).alias("options"))


def lookalike_pairs(df: DataFrame) -> DataFrame:
    """``id_a``, ``id_b``: pairs of questions that look the same but differ in the characters stored.

    Equal consistent forms meet by a shuffle on their hash. Exact copies are put together first (one variant per
    stored form), variants of one look are paired, and only then are the copies listed, so a look that a third of
    all rows share costs no more than its result. Repeated ids are kept as they are; an empty table gives no pairs.
    """
    told = df.select("id", question_forms(script_model(df, "stem", "options")).alias("f"))
    look = F.md5(F.to_json(F.struct("f.stem", "f.options")))
    stored = F.md5(F.to_json(F.struct("f.raw_stem", "f.raw_options")))
    return variant_pairs(checkpointed(told.select("id", look.alias("look"), stored.alias("stored"))))


def variant_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of ids that share ``look`` but not ``stored``; rows: id, look, stored."""
    variants = rows.groupBy("look", "stored").agg(F.count(F.lit(1)).alias("n"))
    mixed = variants.groupBy("look").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("look")
    some = rows.join(mixed, "look", "left_semi")
    forms = variants.join(mixed, "look", "left_semi").select("look", "stored")
    other = forms.select("look", F.col("stored").alias("stored_b"))
    pairs = forms.withColumnRenamed("stored", "stored_a").join(other, "look").where("stored_a < stored_b").drop("look")
    a = some.select(F.col("stored").alias("stored_a"), F.col("id").alias("x"))
    b = some.select(F.col("stored").alias("stored_b"), F.col("id").alias("y"))
    met = pairs.join(a, "stored_a").join(b, "stored_b")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
