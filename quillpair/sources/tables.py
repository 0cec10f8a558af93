"""Readers of the parquet tables below a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``<folder>/<name>.parquet``: a file, or a folder of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over at least as many partitions as tasks run at once, for work that is dear by row.

    A table read in fewer partitions, as one small file, is dealt out again; larger ones stay.
    """
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= tasks else rows.repartition(tasks)
