"""Joins and checks that put a question bank together: keys, backfills, merges, validity, gold sets, next questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mulberry.functions import text as T
from mulberry.operators.learner import available_pool, uniform, uniform_sample


def with_answer_key(questions: DataFrame, key: DataFrame) -> DataFrame:
    """Answers from a key (source, num, answer, ord) where the question has none; of several keys the latest by ord counts."""
    last = key.groupBy("source", "num").agg(F.max_by("answer", "ord").alias("__key"))
    own = F.nullif(F.trim("answer"), F.lit(""))
    return questions.join(last, ["source", "num"], "left").withColumn("answer", F.coalesce(own, F.col("__key"))).drop("__key")


def with_analyses(questions: DataFrame, analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Analyses (num, stem, analysis, ord) for questions without, by number; the first ten characters of the stems must be alike.
    Also the questions whose number matched but whose stem didn't."""
    last = analyses.groupBy("num").agg(F.max_by(F.struct("stem", "analysis"), "ord").alias("__a"))
    told = questions.join(last, "num", "left")
    head = lambda c: F.left(T.match_form(F.coalesce(c, F.lit(""))), F.lit(10))
    same = head(F.col("stem")) == head(F.col("__a.stem"))
    filled = F.when((F.coalesce("analysis", F.lit("")) == "") & same, F.col("__a.analysis")).otherwise(F.col("analysis"))
    return told.withColumn("analysis", filled).drop("__a"), told.where(F.col("__a").isNotNull() & ~same).select("id", "num")


def merged_numbers(questions: DataFrame) -> DataFrame:
    """One row per source and number: the first id, the stems in order joined. Questions without number aren't repeats of one
    another and stay as they are, so no group grows with the rows that lack one."""
    told = questions.select("source", "num", "id", F.coalesce("stem", F.lit("")).alias("stem"))
    held = told.where("num is not null").groupBy("source", "num").agg(F.array_sort(F.collect_list(F.struct("id", "stem"))).alias("all"))
    merged = held.select("source", "num", F.col("all")[0]["id"].alias("id"), F.array_join(F.transform("all", lambda x: x["stem"]), "").alias("stem"))
    return merged.unionByName(told.where("num is null"))


def is_valid(answer: Column, options: Column) -> Column:
    """One answer A-D and four different non-empty options."""
    values = F.map_values(F.from_json(options, "map<string,string>"))
    full = F.filter(values, lambda v: F.trim(v) != "")
    return F.coalesce(T.strip(answer).rlike("^[ABCD]$") & (F.size(F.array_distinct(full)) == 4) & (F.size(values) == 4), F.lit(False))


def gold_problems(cases: DataFrame, topics: DataFrame) -> DataFrame:
    """``problem``, ``item`` rows of a gold set (id, question, topic): repeated ids, empty questions, unknown and uncovered topics."""
    row = lambda name, c: (F.lit(name).alias("problem"), F.col(c).cast("string").alias("item"))
    repeated = cases.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*row("repeated_id", "id"))
    empty = cases.where(F.coalesce(F.trim("question"), F.lit("")) == "").select(*row("empty_question", "id"))
    unknown = cases.join(topics.select(F.col("domain").alias("topic")), "topic", "left_anti").select(*row("unknown_topic", "id"))
    missing = topics.join(cases.select(F.col("topic").alias("domain")), "domain", "left_anti").select(*row("uncovered_topic", "domain"))
    return repeated.unionByName(empty).unionByName(unknown).unionByName(missing)


def citations(answer: Column) -> Column:
    """Array of (source, page) from a line 【出处】《file》第N页；..."""
    line = F.regexp_extract(answer, "【出处】([^\n]*)", 1)
    items = F.filter(F.split(line, "；"), lambda i: i.rlike("《[^》]+》第[0-9]+页"))
    return F.transform(items, lambda i: F.struct(F.regexp_extract(i, "《([^》]+)》", 1).alias("source"), F.regexp_extract(i, "第([0-9]+)页", 1).cast("int").alias("page")))


def supported(cited: Column, pages: Column) -> Column:
    """The citations whose page was shown: equal page, and one name ends with or holds the other. pages: array of (source, page)."""
    alike = lambda c, p: (c["page"] == p["page"]) & (F.contains(p["source"], c["source"]) | F.contains(c["source"], p["source"]))
    return F.filter(cited, lambda c: F.exists(pages, lambda p: alike(c, p)))


def next_question(questions: DataFrame, attempts: DataFrame, cards: DataFrame, weights: DataFrame, now: float, seed: int, due_limit: int = 20) -> DataFrame:
    """One row: a due card whose question is available (by chance among the first ``due_limit``), else a question of a topic
    drawn by weight, else nothing. weights: domain, weight."""
    pool = available_pool(questions, attempts)
    due = cards.where(F.col("due") <= now).select(F.col("question_id").alias("id"), "due").join(pool.select("id"), "id", "left_semi").orderBy("due", "id").limit(due_limit)
    first = uniform_sample(due.select("id"), "id", 1, seed).select("id", F.lit(0).alias("way"))
    told = pool.join(weights.where("weight > 0"), "domain")
    key = -F.log(uniform(F.col("domain"), seed)) / F.col("weight")
    topic = weights.where("weight > 0").join(pool.select("domain"), "domain", "left_semi").withColumn("k", key).orderBy("k", "domain").limit(1).select("domain")
    second = uniform_sample(told.join(topic, "domain", "left_semi").select("id"), "id", 1, seed).select("id", F.lit(1).alias("way"))
    return first.unionByName(second).orderBy("way").limit(1)
