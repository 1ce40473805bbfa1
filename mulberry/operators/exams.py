"""Question banks out of running text: a line is a key, an option, a note, the start of a question, or goes on.

Lines are told apart by column expressions. What a line does depends on the question before it (a number starts a new
question only where the last one has two options), so the lines of a document are folded in order: rows are sorted within
partitions and stream by, a document is held until its last line, as its keys may stand at its end.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.functions import text as T

# The forms of key lines, runs of keys, options, notes and numbered lines.
KEY_LINE = r"^\s*(\d{1,3})\s*[\t.、,，:： ]\s*([A-D]{1,4})\s*$"
KEY_RUN = r"^\s*(?:\d{1,3}[A-D]{1,4}){2,}\s*$"
OPTION_LINE = r"^\s*([A-F])\s*[.．、]\s*(.*)$"
NOTE_LINE = r"^\s*(知识点|解析|考点|答案)\s*[：:]"
NUMBER_LINE = r"^\s*(\d{1,3})\s*[.．、\\]\s*"
ROW = "doc string, ord int, num int, stem string, options string, answer string, analysis string, needs_review boolean"


def exam_line(line: Column) -> Column:
    """key, keys, option, note, number or text."""
    kinds = (("key", KEY_LINE), ("keys", KEY_RUN), ("note", NOTE_LINE), ("option", OPTION_LINE), ("number", NUMBER_LINE))
    told = F.lit("text")
    for kind, form in reversed(kinds):
        told = F.when(line.rlike(form), kind).otherwise(told)
    return told


class _Document:
    """The questions of one document so far."""

    def __init__(self, name: str):
        self.name, self.keys, self.questions = name, {}, []

    def add(self, kind: str, line: str) -> None:
        now = self.questions[-1] if self.questions else None
        ready = now is None or len(now["options"]) >= 2
        if kind == "key" and ready or kind == "keys":
            self.keys |= {int(n): letters for n, letters in re.findall(r"(\d{1,3})\W*([A-D]{1,4})", line)}
        elif kind == "number" and ready:
            self.questions.append({"num": int(re.match(NUMBER_LINE, line)[1]), "stem": line, "options": {}, "notes": []})
        elif now is None:
            return
        elif kind == "note":
            now["notes"].append(line)
        elif kind == "option":
            letter, told = re.match(OPTION_LINE, line).groups()
            now["options"][letter] = told.strip()
        elif now["notes"]:
            now["notes"][-1] += line
        else:
            now["stem"] += line

    def rows(self) -> Iterator[tuple]:
        """The questions, one a number: the stems of those that repeat a number are appended to the first."""
        first: dict[int, dict] = {}
        for q in self.questions:
            at = re.search(r"\s*([A-D]{1,4})\s*$", q["stem"])
            q["answer"] = ""
            if at and len(q["options"]) >= 2:
                q["answer"], q["stem"] = at[1], q["stem"][: at.start()].rstrip("：: ，,")
            told = next((m[1] for n in q["notes"] if (m := re.match(r"\s*答案\s*[：:]\s*([A-D]{1,4})\s*$", n))), "")
            q["answer"] = q["answer"] or told or self.keys.get(q["num"], "")
            if q["num"] in first:
                first[q["num"]]["stem"] += q["stem"]
            else:
                first[q["num"]] = q
        for n, q in enumerate(first.values(), 1):
            notes = "\n".join(x for x in q["notes"] if not re.match(r"\s*答案", x))
            yield self.name, n, q["num"], q["stem"], json.dumps(q["options"], ensure_ascii=False, sort_keys=True), q["answer"], notes, q["answer"] == ""


def exam_questions(lines: DataFrame) -> DataFrame:
    """``doc``, ``ord``, ``num``, ``stem``, ``options`` (JSON), ``answer``, ``analysis``, ``needs_review`` of every question. lines: doc, at, line.

    Answers stand at the end of the stem, in a line 答案：, or in the keys of the document (the last one of a number counts);
    without any the question needs review. Blank lines don't count; a document without numbered lines has no questions.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            done: list[tuple] = []
            for doc, kind, line in zip(batch["doc"], batch["kind"], batch["line"]):
                if held is None or held.name != doc:
                    done += held.rows() if held else ()
                    held = _Document(doc)
                held.add(kind, line)
            yield pd.DataFrame(done, columns=[c.split()[0] for c in ROW.split(", ")])
        if held:
            yield pd.DataFrame(list(held.rows()), columns=[c.split()[0] for c in ROW.split(", ")])

    told = lines.select(F.col("doc").cast("string").alias("doc"), "at", T.strip(F.regexp_replace(F.coalesce("line", F.lit("")), r"[ \t\x{3000}]+", " ")).alias("line")).where("line <> '' and doc is not null")
    sorted_ = told.withColumn("kind", exam_line(F.col("line"))).repartition("doc").sortWithinPartitions("doc", "at")
    return sorted_.select("doc", "kind", "line").mapInPandas(fold, ROW)
