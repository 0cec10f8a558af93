"""Normalised views and term counts over streams of pairs.

The normalisers and similarities are column functions, so they run on a stream
unchanged; what is here ties them to sources, watermarks and sinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillpair.functions.similarity import dice_ratio, jaccard_ratio
from quillpair.functions.text import view, words


def stream_pairs(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 8) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def similarity_stream(pairs: DataFrame, name: str = "tokenize") -> DataFrame:
    """``id, dice, jaccard`` of the words of a named view, for batch and stream alike."""
    change = view(name)
    rows = pairs.select("id", words(change(F.col("question1"))).alias("a"), words(change(F.col("question2"))).alias("b"))
    return rows.select("id", F.round(dice_ratio(F.col("a"), F.col("b")), 6).alias("dice"), F.round(jaccard_ratio(F.col("a"), F.col("b")), 6).alias("jaccard"))


def source_counts(pairs: DataFrame, time: str = "loaded_at", late: str = "3 days", width: str = "1 day") -> DataFrame:
    """Pairs by source and window; rows later than ``late`` are dropped by the watermark.  Null sources are a group.

    Rows without a time are in no window.  A watermark needs an instant, so times without
    a zone are taken in the session's and windows are given without one.
    """
    rows = pairs.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if pairs.isStreaming else rows
    counted = rows.groupBy(F.window(time, width).alias("w"), F.coalesce("source", F.lit("none")).alias("source")).agg(F.count("*").alias("pairs"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "source", "pairs")
