"""The engine over one folder of tables: what a service asks for, as DataFrames. Nothing here computes by itself.

``now`` and ``seed`` are always given, so equal calls give equal rows. A model of any kind (embedding, scorer, generator) is passed in;
without one the offline stand-ins are used.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mulberry.config import DEFAULTS, Settings
from mulberry.functions import text as T
from mulberry.operators import banks, learner, memory, metrics, questions, retrieve, schedule
from mulberry.sources.tables import table

TABLES = ("questions", "kb_chunks", "attempts", "review_cards", "question_signals", "topics")
SNIPPET = 300


class Engine:
    """Tables of a folder (any may be replaced by a DataFrame of the same columns), registered as views."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULTS, **replaced: DataFrame):
        self.spark, self.settings = spark, settings.checked()
        self.tables = {n: replaced[n] if n in replaced else table(spark, folder, n, wide=n == "kb_chunks") for n in TABLES}
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)

    def corpus(self) -> DataFrame:
        """The chunks as search needs them: titles from the first line, the text that is indexed, pages as parents."""
        kb = self.tables["kb_chunks"]
        text = F.coalesce("text", F.lit(""))
        title = F.regexp_extract(text, "^([^\n。，]{1,30})\n", 1)
        return kb.select("id", "domain", "source", "page", "kind", title.alias("title"), text.alias("text"), T.embedding_text(F.col("domain"), title, text).alias("embedding_text"), F.concat_ws("|", "source", "page").alias("parent_id"))

    def contexts(self, asked: DataFrame, dense: retrieve.Recall | None = None, scorer: retrieve.Scorer | None = retrieve.shared_tokens, model: dict | None = None) -> DataFrame:
        """The chunks shown for each query (query_id, query, topic and, if there are any, variants and context), with their text and
        whether an answer should be refused."""
        found = retrieve.search(asked, self.corpus(), dense, scorer, model, settings=self.settings)
        return found.join(self.corpus().select("id", "source", "page", "domain", "text"), "id").select("query_id", "rank", "id", "source", "page", "domain", "text", "score", "refused")

    def sources(self, shown: DataFrame, most: int = 4) -> DataFrame:
        """The first sources of each query's contexts, as they stand beside an answer."""
        ranked = shown.groupBy("query_id", "source").agg(F.min("rank").alias("r")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "source"))).alias("s"))
        return ranked.select("query_id", F.array_join(F.slice(F.transform("s", lambda x: x["source"]), 1, most), "、").alias("sources"))

    def next_question(self, now: float, seed: int, topic: str | None = None, generate: Callable[[str], DataFrame] | None = None, least: int = 5) -> DataFrame:
        """One question without its answer: a due card, else one of a topic drawn by weight. Of a given topic, one that is available; where
        none is and ``generate`` is given, one of what it makes for the topic (columns of the bank)."""
        bank, attempts = self.tables["questions"], self.tables["attempts"]
        if topic is None:
            weights = learner.topic_weights(self.tables["topics"], self.profile(now), learner.replay(attempts.where("domain is not null"), "domain", self.settings), self.settings)
            picked = banks.next_question(bank, attempts, self.tables["review_cards"], weights.select("domain", "weight"), now, seed)
            return questions.redacted(bank.join(picked.select("id"), "id", "left_semi"))
        pool = learner.available_pool(bank.where(F.col("domain") == topic), attempts)
        some = pool.limit(least).count()
        if not some and generate is not None:
            pool = generate(topic)
        return questions.redacted(learner.uniform_sample(pool, "id", 1, seed))

    def graded(self, answers: DataFrame) -> DataFrame:
        """Answers (question_id, choice) with ``correct``, the ``answer`` and the ``analysis``; an unknown question has nulls."""
        told = questions.graded(answers, self.tables["questions"]).withColumnRenamed("right", "correct")
        return told.join(self.tables["questions"].select(F.col("id").alias("question_id"), "answer", "analysis"), "question_id", "left").select("question_id", "choice", "correct", "answer", "analysis")

    def related(self, answers: DataFrame, most: int = 2) -> DataFrame:
        """The chunks to read after an answer: the best of the question's topic for its stem, their beginning only."""
        asked = answers.select("question_id").distinct().join(self.tables["questions"].select(F.col("id").alias("question_id"), "stem", "domain"), "question_id")
        shown = self.contexts(asked.select(F.col("question_id").alias("query_id"), F.coalesce("stem", F.lit("")).alias("query"), F.col("domain").alias("topic")))
        return shown.where(F.col("rank") <= most).select(F.col("query_id").alias("question_id"), "rank", "source", "page", "domain", F.left("text", F.lit(SNIPPET)).alias("text"))

    def profile(self, now: float) -> DataFrame:
        return learner.topic_profile(self.tables["attempts"], self.tables["question_signals"], now, self.tables["topics"], self.settings)

    def statistics(self, now: float) -> dict[str, DataFrame]:
        """The parts of the summary: totals, the full row of each topic, topics by flag."""
        held = self.profile(now)
        full = learner.full_profile(self.tables["attempts"], self.tables["question_signals"], now, self.tables["topics"], self.settings)
        return {"totals": learner.summary(held, self.tables["review_cards"], now), "topics": full, "flags": learner.flagged_topics(held)}

    def due(self, now: float, limit: int = 20) -> DataFrame:
        return schedule.due_cards(self.tables["review_cards"], now, limit)

    def topics(self) -> DataFrame:
        """The topics of the bank, each once."""
        return self.tables["questions"].select(T.strip(F.col("domain")).alias("domain")).where("domain <> ''").distinct()

    def threads(self, limit: int = 20) -> DataFrame:
        return memory.threads(self.tables["question_signals"], limit)

    def history(self, rounds: DataFrame, last: int = 20) -> DataFrame:
        return memory.messages(rounds, last)

    def requests(self, log: DataFrame, last: int = 500) -> dict[str, DataFrame]:
        return {"report": metrics.request_report(log, last), "by_intent": metrics.requests_by_intent(log, last)}
