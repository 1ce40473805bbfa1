"""Databases of one file, read through the Python data source interface: ranges of row numbers are read in parallel."""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

ROWS_A_PARTITION = 200_000
#: What each old table becomes: the columns that are taken over, and what is added.
TABLES = {
    "questions": ("ai_questions", "id string, stem string, options string, answer string, analysis string, domain string"),
    "attempts": ("attempts", "question_id string, question_source string, domain string, stem string, choice string, correct long, answered_at double"),
    "conversations": ("conversations", "thread_id string, role string, content string, intent string, created_at double"),
    "metrics": ("metrics", "thread_id string, question string, intent string, route_ms double, retrieval_ms double, first_token_ms double, total_ms double, prompt_tokens long, completion_tokens long, created_at double"),
}


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.table = [f.name for f in schema.fields], options["path"], options["table"]

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[InputPartition]:
        db = self._open()
        low, high = db.execute(f'SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM "{self.table}"').fetchone()
        db.close()
        return [_Range(a, min(a + ROWS_A_PARTITION - 1, high)) for a in range(low, high + 1, ROWS_A_PARTITION)] or [_Range(0, -1)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        db = self._open()
        columns = ", ".join(f'"{n}"' for n in self.names)
        yield from db.execute(f'SELECT {columns} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))
        db.close()


class SqliteSource(DataSource):
    """Format ``sqlite_rows``: options path (a file that every executor sees) and table; the schema names the columns."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_rows"

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, dict(self.options))


def sqlite_table(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame | None:
    """A table of a file, or None where the file has no such table (older ones lack some). Whatever else is wrong is raised."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    there = db.execute("SELECT count(*) FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (name,)).fetchone()[0]
    db.close()
    if not there:
        return None
    spark.dataSource.register(SqliteSource)
    return spark.read.format("sqlite_rows").schema(schema).option("table", name).load(path)


def legacy_rows(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The rows of an old database in the shape of today's tables, by their names; tables that aren't there are left out."""
    found = {name: sqlite_table(spark, path, old, schema) for name, (old, schema) in TABLES.items()}
    out = {name: df for name, df in found.items() if df is not None}
    if "questions" in out:
        out["questions"] = out["questions"].withColumn("analysis", F.coalesce("analysis", F.lit(""))).withColumns({"source": F.lit("AI生成"), "num": F.lit(0), "needs_review": F.lit(False)})
    if "attempts" in out:
        out["attempts"] = out["attempts"].withColumn("correct", F.col("correct").cast("boolean"))
    return out
