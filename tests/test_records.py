from pyspark.sql import functions as F

from mulberry.operators import records as R

OPTIONS = '"{""A"": ""甲"", ""B"": ""乙""}"'


def line(options=OPTIONS, answer="A", review="false", stem="题"):
    return f"s_1,s,1,{stem},{options},{answer},略,,{review},,2024-01-01 00:00:00"


CASES = {
    1: (line(), None),
    2: (line(stem='"有""引号""，有,逗号\n有换行"'), None),
    3: (line(stem='有"引号'), "quoting"),
    4: (line(stem='"引号"外'), "quoting"),
    5: (line() + ',"没有结束', "quoting"),
    6: (line() + ",多", "column_count"),
    7: ("", "column_count"),
    8: (None, "column_count"),
    9: (line(options="{}"), "bad_options"),
    10: (line(options='"{""A"": ""甲""}"'), "bad_options"),
    11: (line(options="\"{'A': '甲', 'B': '乙'}\""), "bad_options"),
    12: (line(options='"{""A"": ""甲"", ""B"": null}"'), "bad_options"),
    13: (line(options='"{""A"": ""甲"", ""B"": "" 　""}"'), "bad_options"),
    14: (line(options='"{""A"": ""甲"", ""选B"": ""乙""}"'), "bad_options"),
    15: (line(options='"{""A"": ""甲"", ""B"": ""乙""} x"'), "bad_options"),
    16: (line(options='"{""A"": ""甲"", ""B"": ""乙"",}"'), "bad_options"),
    17: (line(options='"{""A"": ""a\\u4e00\\""\\\\n"", ""B"": ""\\u0020x""}"'), None),
    18: (line(options='"{""A"": ""a"", ""B"": ""\\u0020\\n""}"'), "bad_options"),
    19: (line(options='"{""A"": ""a"", ""A"": ""b""}"'), "bad_options"),
    20: (line(options='"[""甲"", ""乙""]"'), "bad_options"),
    21: (line(answer=" ba "), None),
    22: (line(answer=""), None),
    23: (line(answer="AA"), "bad_answer"),
    24: (line(answer="C"), "bad_answer"),
    25: (line(answer="Ａ"), "bad_answer"),
    26: (line(review="TRUE"), None),
    27: (line(review="0"), None),
    28: (line(review=""), "bad_needs_review"),
    29: (line(review="yes", answer="Z"), "bad_answer"),
    30: (line(stem="长" * 200_000), None),
    31: (line(stem='"' + '""' * 50_000 + '"'), None),
    32: (line(stem="\x01\x02"), None),
}


def test_reasons(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CASES.items()], "raw_id bigint, line string")
    got = {r.raw_id: r.reason for r in R.rejected_records(df).collect()}
    assert got == {k: v[1] for k, v in CASES.items() if v[1]}
    assert R.valid_records(df).count() == len(CASES) - len(got)


def test_all_errors_are_listed(spark):
    df = spark.createDataFrame([(1, line(options="{}", answer="?", review="?"))], "raw_id bigint, line string")
    assert R.rejected_records(df).first().errors == ["bad_options", "bad_answer", "bad_needs_review"]


def test_values_survive(spark):
    df = spark.createDataFrame([(1, line(stem='"a,""b""\x01\x02"'))], "raw_id bigint, line string")
    row = R.valid_records(df).first()
    assert row.stem == 'a,"b"\x01\x02' and row.num == 1 and row.needs_review is False and str(row.created_at).startswith("2024-01-01")


def test_empty_repeated_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x")], "raw_id bigint, line string").withColumn("fields", F.lit(0)).withColumn("errors", F.lit("e")).withColumn("reason", F.lit("r"))
    assert [tuple(r) for r in R.rejected_records(df).select("raw_id", "reason").collect()] == [(1, "column_count")] * 2
    assert R.rejected_records(df.limit(0)).count() == 0 and R.valid_records(df.limit(0)).count() == 0
    assert [tuple(r) for r in R.rejection_report(df).collect()] == [("column_count", 2)]
