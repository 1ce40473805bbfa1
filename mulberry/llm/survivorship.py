"""One surviving record per duplicate group, each field from the member best suited for it.

Groups are the ends of ``dup_of`` chains (graphs.chain_ends). Each field takes the best of a composite struct
(usable, review state, completeness, trust, time, id) in one aggregation over all rows; numbers are negated, so the
best is the smallest struct and a tie goes to the smaller id. Minima combine before the shuffle: a group that holds
a third of all rows sends one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.llm.graphs import chain_ends
from mulberry.operators.records import BLANK, trim_blank

FIELDS = ("answer", "analysis")
# Signs that don't count in an answer, and stand-ins for an analysis (letters and digits only, lower case).
ANSWER_SEPARATORS = r"[.。·、,;:/\\|&+_]"
STAND_INS = (
    "略", "从略", "解析略", "答案略", "详解略", "略解析", "无", "无解析", "暂无", "暂无解析", "暂缺", "缺", "暂略", "没有", "没有解析", "空", "待补充", "待补", "待完善", "待更新", "待定", "待录入", "待整理", "待续",
    "见教材", "见书", "见课本", "见讲义", "详见教材", "参见教材", "参考教材", "见解析", "见答案", "见上", "见上题", "同上", "解析", "解析无", "解析暂无", "解析待补充", "解析见教材", "na", "none", "null", "nil", "nan", "tbd", "todo", "no", "x", "0",
)
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def narrow(c: Column) -> Column:
    """Full-width forms of ASCII characters as ASCII."""
    return F.translate(c, _WIDE, _NARROW)


def plain_answer(answer: Column) -> Column:
    """The answer's letters: width, case, blanks, stops, slashes and separators aside."""
    return F.regexp_replace(F.upper(narrow(answer)), f"(?:{BLANK}|{ANSWER_SEPARATORS})+", "")


def usable_answer(answer: Column, options: Column) -> Column:
    """Whether the answer consists of different letters that are all keys of the record's options."""
    letters = F.split(plain_answer(answer), "")
    keys = F.transform(F.coalesce(F.json_object_keys(options), F.array().cast("array<string>")), lambda k: F.upper(narrow(trim_blank(k))))
    good = plain_answer(answer).rlike("^[A-Z]+$") & (F.size(F.array_distinct(letters)) == F.size(letters)) & (F.size(F.array_except(letters, keys)) == 0)
    return F.coalesce(good, F.lit(False))


def usable_analysis(analysis: Column) -> Column:
    """Whether the analysis is more than blanks, signs or a stand-in that says nothing."""
    told = F.lower(F.regexp_replace(narrow(analysis), r"[^\p{L}\p{N}]+", ""))
    return F.coalesce((told != "") & ~told.isin(*STAND_INS), F.lit(False))


def duplicate_groups(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that are tied together, with ``group_id``: those that point somewhere and those pointed at.

    Blanks around ``dup_of`` don't count, a blank one points nowhere; of several rows with one id the smallest
    pointer counts.
    """
    target = trim_blank(F.col("dup_of"))
    pointers = df.where(target != "").groupBy("id").agg(F.min(target).alias("next")).select(F.col("id").alias("node"), "next").where("node is not null")
    ends = chain_ends(pointers)
    named = ends.select("root").distinct().join(pointers.select("node"), F.col("root") == F.col("node"), "left_anti").select(F.col("root").alias("node"), "root")
    tied = ends.select("node", "root").unionByName(named)
    return df.join(tied, F.col("id") == F.col("node")).drop("node").withColumnRenamed("root", "group_id")


def _ranked(df: DataFrame, publishers: DataFrame) -> DataFrame:
    trust = publishers.groupBy(F.col("publisher").alias("__p")).agg(F.max("trust").alias("__trust"))
    held = df.join(trust, F.substring_index("source", "_", 1) == F.col("__p"), "left")
    created = F.col("created_at").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), created)
    review = F.when(~F.col("needs_review"), 0).otherwise(1)
    late = (-F.coalesce(F.col("__trust"), F.lit(-(10**6))), created.isNull(), -micros, F.col("id"))
    rank = lambda *own: F.struct(*[c.alias(f"k{i}") for i, c in enumerate((review, *own, *late))], F.col("id").alias("id"), F.col("answer").alias("answer"), F.col("analysis").alias("analysis"))
    return held.select(
        "group_id",
        "id",
        F.when(usable_answer(F.col("answer"), F.col("options")), rank()).alias("best_answer"),
        F.when(usable_analysis(F.col("analysis")), rank(-F.length(trim_blank(F.col("analysis"))))).alias("best_analysis"),
    )


def survivors(questions: DataFrame, publishers: DataFrame) -> DataFrame:
    """One row per group of two or more records: ``group_id``, ``members``, and for each field the value chosen and
    the member it comes from (null where no member has a usable value).

    A null ``needs_review`` counts as needing review, an unknown publisher as least trusted, a null time as earliest.
    """
    ranked = _ranked(duplicate_groups(questions.select("id", "source", "options", "answer", "analysis", "needs_review", "dup_of", "created_at")), publishers)
    once = ranked.groupBy("group_id").agg(
        F.count_distinct("id").alias("members"), F.min("best_answer").alias("best_answer"), F.min("best_analysis").alias("best_analysis")
    )
    b = lambda f, c: F.col(f"best_{f}.{c}")
    return once.where("members > 1").select(
        "group_id", "members", plain_answer(b("answer", "answer")).alias("answer"), b("answer", "id").alias("answer_from"),
        trim_blank(b("analysis", "analysis")).alias("analysis"), b("analysis", "id").alias("analysis_from"),
    )


def field_sources(questions: DataFrame, publishers: DataFrame) -> DataFrame:
    """``group_id``, ``field``, ``id``: the member of each group that supplies each field."""
    found = survivors(questions, publishers)
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_from").alias("id")) for f in FIELDS])
    return found.select("group_id", F.inline(each)).where("id is not null")
