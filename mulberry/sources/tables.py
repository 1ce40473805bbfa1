"""Table access: Parquet tables of one directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str, wide: bool = False) -> DataFrame:
    """The Parquet table ``name`` of ``directory`` (one file or a folder of part files).

    wide: for plans with much work per row. A scan of fewer splits than there are cores (a file of one row group can't be
    split) is then dealt out to all cores; what has enough splits is read in place, without a shuffle.
    """
    df = spark.read.parquet(f"{directory}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if wide and df._jdf.queryExecution().toRdd().getNumPartitions() < cores:
        return df.repartition(cores)
    return df
