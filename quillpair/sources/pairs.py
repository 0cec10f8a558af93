"""Pair tables: one row for two questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpair.sources.tables import read_table

COLUMNS = ["split", "id", "question1", "question2"]


def train_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``split, id, question1, question2, is_duplicate`` of the training pairs."""
    return read_table(spark, folder, "train").select(F.lit("train").alias("split"), "id", "question1", "question2", "is_duplicate")


def test_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation pairs, under the same names; their part is in ``split``."""
    return read_table(spark, folder, "test").select(F.lit("test").alias("split"), F.col("test_id").alias("id"), "question1", "question2")


def all_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Training pairs, then evaluation pairs."""
    return train_pairs(spark, folder).select(COLUMNS).unionByName(test_pairs(spark, folder))


def question_texts(pairs: DataFrame) -> DataFrame:
    """``text``: the questions of all pairs, one a row, repeats and nulls included."""
    return pairs.select(F.col("question1").alias("text")).unionByName(pairs.select(F.col("question2").alias("text")))
