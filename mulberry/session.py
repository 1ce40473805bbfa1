"""Session set-up shared by tests, the bench and applications."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "mulberry", **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on. Keyword arguments override any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": "8",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder the cluster names.

    The folder of ``spark.checkpoint.dir`` is used as it is. Only where neither it nor a checkpoint
    directory is set (tests on one machine) a temporary folder is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix=f"checkpoint-{os.getpid()}-"))
    return df.checkpoint(eager=True)


def merged(df: DataFrame) -> DataFrame:
    """Joins with these rows are merged by a shuffle, never broadcast.

    A checkpoint keeps its plan's estimate of its size, which takes an array for one element and a text for 20 bytes (and an
    exploded row for the row it came from); a whole table of texts or sets passes for small and goes through the driver.
    """
    return df.hint("merge")
