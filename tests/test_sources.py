import sqlite3

import pytest

from mulberry.operators import exams
from mulberry.sources import legacy

LINES = "doc string, at int, line string"


def parsed(spark, docs):
    rows = [(d, i, line) for d, text in docs.items() for i, line in enumerate(text.split("\n"))]
    return {(r.doc, r.num): r for r in exams.exam_questions(spark.createDataFrame(rows, LINES)).collect()}


def test_answers_in_the_stem_keys_and_notes(spark):
    got = parsed(spark, {
        "inline": "前言\n1. 甲是什么：C\nA. 一\nB. 二\nC. 三\n2、乙是\n什么\n2.5 倍\nA. 一\nB. 二\n答案：B\n解析：因为\n所以",
        "keys": "1. 题一\nA. 一\nB. 二\n2. 题二\nA. 一\nB. 二\n1 A\n2\tB\n2 D",
        "run": "7. 题七\nA. 一\nB. 二\n8. 题八\nA. 一\nB. 二\n7C8AB",
        "none": "没有题号\n也没有题",
    })
    assert (got["inline", 1].stem, got["inline", 1].answer, got["inline", 1].needs_review) == ("1. 甲是什么", "C", False)
    assert (got["inline", 2].stem, got["inline", 2].answer, got["inline", 2].analysis) == ("2、乙是什么2.5 倍", "B", "解析：因为所以")
    assert (got["keys", 1].answer, got["keys", 2].answer) == ("A", "D")  # the last key of a number counts
    assert (got["run", 7].answer, got["run", 8].answer) == ("C", "AB")
    assert not any(d == "none" for d, _ in got)


def test_repeated_numbers_and_edges(spark):
    got = parsed(spark, {"d": "1. 题\nA. 一\nB. 二\n1. 再题\nA. 三\nB. 四", "e": "", "f": "3. 没有选项"})
    assert got["d", 1].stem == "1. 题1. 再题" and got["d", 1].options == '{"A": "一", "B": "二"}' and got["d", 1].needs_review
    assert got["f", 3].options == "{}" and len(got) == 2
    empty = spark.createDataFrame([("d", 0, None), (None, 1, "1. 题")], LINES)
    assert exams.exam_questions(empty).count() == 0 and exams.exam_questions(empty.limit(0)).count() == 0


def test_old_database(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "old.db")
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE ai_questions (id TEXT, stem TEXT, options TEXT, answer TEXT, analysis TEXT, domain TEXT)")
    db.executemany("INSERT INTO ai_questions VALUES (?, ?, '{}', 'A', NULL, 't')", [(f"q{i}", f"题{i}") for i in range(25)])
    db.execute("CREATE TABLE attempts (question_id TEXT, question_source TEXT, domain TEXT, stem TEXT, choice TEXT, correct INTEGER, answered_at REAL)")
    db.execute("INSERT INTO attempts VALUES ('q1', 's', 't', 'x', 'A', 1, 1.5)")
    db.execute("CREATE TABLE conversations (thread_id TEXT, role TEXT, content TEXT, intent TEXT, created_at REAL)")
    db.commit()
    db.close()
    monkeypatch.setattr(legacy, "ROWS_A_PARTITION", 10)
    told = legacy.legacy_rows(spark, path)
    assert told.keys() == {"questions", "attempts", "conversations"}
    assert told["questions"].count() == 25 and told["questions"].first().analysis == "" and {r.source for r in told["questions"].collect()} == {"AI生成"}
    assert [(r.question_id, r.correct, r.answered_at) for r in told["attempts"].collect()] == [("q1", True, 1.5)]
    assert told["conversations"].count() == 0
    with pytest.raises(FileNotFoundError):
        legacy.sqlite_table(spark, str(tmp_path / "none.db"), "t", "a int")
