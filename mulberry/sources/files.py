"""Sources and sinks besides Parquet tables: JSON arrays, folders of documents, JDBC tables, appended events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAGE = "path string, page int, text string, error string"
#: Parts of what databases say of a table that doesn't exist.
NO_TABLE = ("does not exist", "doesn't exist", "no such table", "not found", "unknown table", "invalid object name", "ora-00942")
#: Longest text kept of an event's columns.
EVENT_LIMITS = {"attempts": {"stem": 500}, "signals": {"question": 2000}, "metrics": {"question": 300}}


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array; missing fields are null."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def document_pages(spark: SparkSession, folder: str, extract: Callable[[str, bytes], list[str]], pattern: str = "*") -> DataFrame:
    """``path``, ``page`` (from 1), ``text`` of every document below a folder. ``extract`` turns a name and its bytes into the texts of
    its pages; it runs on the executors, a file at a time. A file it can't read gives one page with null text and what went
    wrong as ``error`` (null otherwise)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    rows += [(path, n, t, None) for n, t in enumerate(extract(path, bytes(content)), 1)]
                except Exception as e:  # noqa: BLE001
                    rows.append((path, 1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(read, PAGE)


def document_order(pages: DataFrame, summary: str = "总结") -> DataFrame:
    """Pages with ``doc_ord``: paths in order, summaries last; the number of files, not of pages, meets in one task."""
    paths = pages.select("path").distinct().withColumn("late", F.contains("path", F.lit(summary)).cast("int"))
    return pages.join(paths.select("path", F.row_number().over(Window.orderBy("late", "path")).alias("doc_ord")), "path")


def jdbc_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame | None:
    """A table of a database, or None where the database says that it doesn't exist (older ones lack some). Anything else, a
    wrong password or a network fault among it, is raised."""
    try:
        return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()
    except Exception as e:  # noqa: BLE001
        if any(part in str(e).lower() for part in NO_TABLE):
            return None
        raise


def append_events(df: DataFrame, path: str, kind: str) -> None:
    """Append events, their long texts cut to what is kept."""
    for column, most in EVENT_LIMITS.get(kind, {}).items():
        df = df.withColumn(column, F.left(F.col(column), F.lit(most)))
    df.write.mode("append").parquet(path)


def append_vectors(df: DataFrame, path: str) -> None:
    """Append vectors (columns embedding_model and vector among others), kept apart by model and dimension, so a change of the
    model never mixes with what is there."""
    df.withColumn("dim", F.size("vector")).write.mode("append").partitionBy("embedding_model", "dim").parquet(path)


def write_rows(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Replace what is at a path (parquet, json, csv or orc)."""
    df.write.mode("overwrite").format(form).save(path)
