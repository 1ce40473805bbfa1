import difflib
import random

import pytest
from pyspark.sql import functions as F

from mulberry.operators import catalog, chunking, memory, questions

PAGES = "id string, domain string, source string, page int, kind string, text string"


def test_split_and_pack():
    assert chunking.split_long("短", 10) == ["短"]
    parts = chunking.split_long("一二三。四五六！七八九十一二三四五六七八九十。", 8)
    assert all(len(p) <= 8 for p in parts) and "".join(parts) == "一二三。四五六！七八九十一二三四五六七八九十。"
    title, units = chunking.semantic_units("标题\n- 一\n- 二\n正文。")
    assert title == "标题" and units == ["- 一", "- 二\n正文。"]
    children = chunking.pack_units(["甲" * 100, "乙" * 100, "丙" * 100], 210, 420, 1)
    assert children[0].startswith("甲") and all(len(c) <= 420 for c in children) and "乙" in children[0] and "乙" in children[1]


def test_tables_repeat_the_head():
    md = "\n".join(["| a | b |", "| --- | --- |", *[f"| {i} | x |" for i in range(30)]])
    parts = chunking.table_parts(md, 80)
    assert len(parts) > 1 and all(p.startswith("| a | b |") for p in parts) and all(len(p) <= 90 for p in parts)


def test_windows_snap():
    text = "字" * 290 + "。" + "字" * 400
    w = chunking.windows(text, 300, 100)
    assert w[0] == (0, 291) and w[1][0] == 191 and w[-1][1] == len(text)


def test_structured_chunks_carry_titles(spark):
    df = spark.createDataFrame([("p1", "d", "s_v4.2", 1, "pptx", "网络隔离"), ("p2", "d", "s_v4.2", 2, "pptx", "这是一段足够长的正文，用来检查标题。"), ("p3", "d", "s_v4.2", 3, "pptx", None), ("p4", "d", "t", 1, "pptx", "短")], PAGES)
    rows = chunking.structured_chunks(df).collect()
    assert [(r.title, r.version, r.element) for r in rows] == [("网络隔离", "v4.2", "text")]
    assert {r.id for r in chunking.structured_chunks(df).collect()} == {r.id for r in rows}


def test_repeated_lines(spark):
    df = spark.createDataFrame([(f"p{i}", "d", "s", i, "pptx", f"页眉\n正文{i}\n- {i} -\n") for i in range(4)], PAGES)
    assert {r.text.strip() for r in chunking.drop_repeated_lines(df).collect()} == {f"正文{i}" for i in range(4)}


def test_dedup_prefers_version_and_length(spark):
    df = spark.createDataFrame([("a", "d", "s_V4.1", 1, "pptx", "相同的内容文本"), ("b", "d", "s_V4.2", 1, "pptx", "相同的内容，文本"), ("c", "d", "s", 1, "pptx", "短")], PAGES)
    assert {r.id for r in chunking.deduplicated(df).collect()} == {"b", "c"}
    assert chunking.deduplicated(df.limit(0)).count() == 0


def test_banks_rows_and_failures(spark):
    rows = spark.createDataFrame([("s", i, n) for i, n in enumerate([1, 2, 3, 1, 2, 5, 4])], "source string, at int, num int")
    assert [r.bank for r in questions.banks(rows, "source", ["at"], "num").orderBy("at").collect()] == [1, 1, 1, 2, 2, 2, 3]
    text = spark.createDataFrame([("d", 0, "前言"), ("d", 1, "1、题"), ("d", 2, "续"), ("d", 3, "2. 题")], "doc string, at int, line string")
    assert {r.text for r in questions.continued_rows(text, "doc", "at", "line").collect()} == {"1、题续", "2. 题"}
    q = spark.createDataFrame([("a", "", "{}", None), ("b", "x", '{"A":"1","B":"2"}', "A")], "id string, stem string, options string, answer string")
    assert sorted(r.reason for r in questions.parse_failures(q).collect()) == ["empty_stem", "few_options", "no_answer"]


def test_similar_stems(spark):
    stem = "某公司计划改造审批平台的访问控制策略并复核全部账号权限，下列做法中正确的是哪一项？"
    q = spark.createDataFrame([("a", "d", stem), ("b", "d", "12、" + stem.replace("全部", "所有")), ("c", "e", stem), ("f", "d", "完全不同的题目内容，与上文没有关系。")], "id string, domain string, stem string")
    assert [(r.id_a, r.id_b) for r in questions.similar_stems(q).collect()] == [("a", "b")]


@pytest.mark.parametrize("block", [7, 2048])
def test_similar_stems_equal_brute_force(spark, block):
    rng = random.Random(3)
    letters = "安全管理访问控制风险评估审计密码网络系统"
    rows = []
    for g in range(25):
        base = "".join(rng.choice(letters) for _ in range(rng.choice([8, 12, 16, 30, 60, 230])))
        cut = rng.randrange(len(base))
        for v in (base, "新" + base, base[:cut] + "增" + base[cut:], base[1:] + "尾", base):
            rows.append((f"q{len(rows):03d}", "d" if g % 3 else None, v))
    first, stems = {}, {}
    for i, d, s in rows:
        first.setdefault((d, s), i)
        stems.setdefault(d, {}).setdefault(s, i)
    want = {(first[d, s], i, 1.0) for i, d, s in rows if first[d, s] != i}
    for held in stems.values():
        told = sorted((i, s) for s, i in held.items())
        for n, (i, a) in enumerate(told):
            for j, b in told[n + 1 :]:
                r = round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
                if r >= 0.85:
                    want.add((i, j, r))
    df = spark.createDataFrame(rows, "id string, domain string, stem string")
    got = [tuple(r) for r in questions.similar_stems(df, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_catalog(spark):
    held = spark.createDataFrame([("a", 1)], "id string, n int")
    batch = spark.createDataFrame([("a", 5), ("b", 3), ("b", 2)], "id string, n int")
    assert [tuple(r) for r in catalog.new_rows(batch, held, "id", "n").collect()] == [("b", 2)]
    assert [tuple(r) for r in catalog.manifest_problems({"t": held}, {"t": 1, "u": 2}).collect()] == [("u", 2, 0)]
    assert catalog.non_empty(held.limit(0), batch).count() == 3


def test_memory(spark):
    rounds = spark.createDataFrame([(i, "t", f"q{i}", f"a{i}", None, float(i)) for i in range(4)] + [(9, None, "x", "y", None, 9.0)], "id bigint, thread_id string, question string, answer string, intent string, created_at double")
    assert [tuple(r) for r in memory.threads(rounds).collect()] == [("t", 3.0, 4)]
    got = [r.content for r in memory.messages(rounds, 3).orderBy(F.col("n").desc()).collect()]
    assert got == ["a2", "q3", "a3"]


@pytest.mark.parametrize("line,title", [("第三章 访问控制模型及其在信息系统中的应用与发展综述第一节", True), ("2.1.3 访问控制", False), ("短标题", True), ("短句。", False), ("提示：", False), ("- 项目", False), ("（一）项目", False), ("二、项目", False), ("没有编号的一行文字超过了二十四个字所以不是标题而是正文内容", False), ("第一章" + "长" * 43, False), ("", False)])
def test_titles(line, title):
    assert chunking.looks_like_title(line) is title


def test_sentences_are_packed_and_long_ones_stand_alone():
    assert chunking.split_long("甲乙。丙丁！！戊", 20) == ["甲乙。丙丁！！戊"]
    assert chunking.split_long("甲乙。丙丁！！戊己", 6) == ["甲乙。丙丁！", "戊己"]
    assert chunking.split_long("甲。" + "长" * 7 + "。乙。", 5) == ["甲。", "长" * 5, "长长。", "乙。"]
    assert chunking.split_long("短。   \n\n " + "长" * 9, 8) == ["短。", "长" * 7, "长长"]  # the blank in front counts for the cut


def test_children_overlap_and_never_exceed_the_limit():
    units = [c * 100 + "。" for c in "甲乙丙丁"]
    assert chunking.pack_units(units, 220, 420, 1) == ["\n".join(units[a : a + 2]) for a in range(3)]
    assert chunking.pack_units(units, 220, 420, 0) == ["\n".join(units[:2]), "\n".join(units[2:])]
    # a short tail joins the child before it, and what is then too long is split
    assert chunking.pack_units([*units[:2], "尾。"], 203, 420, 0) == ["\n".join([*units[:2], "尾。"])]
    assert all(len(c) <= 205 for c in chunking.pack_units([*units[:2], "尾尾尾尾。"], 203, 205, 0))
    assert chunking.pack_units([], 220, 420, 1) == []
