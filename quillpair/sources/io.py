"""Readers and writers of pair and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillpair.functions.vectors import unit
from quillpair.sources.shared import shuffles_removed

PAIR_SCHEMA = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("qid1", T.LongType()), T.StructField("qid2", T.LongType())]
    + [T.StructField("question1", T.StringType()), T.StructField("question2", T.StringType()), T.StructField("is_duplicate", T.IntegerType())]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, as_strings: bool = False, columns: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; ``as_strings`` reads every column as text, ``columns`` prunes the scan."""
    if as_strings:
        schema = T.StructType([T.StructField(f.name, T.StringType()) for f in schema])
    rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return rows.select(*columns) if columns else rows


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, line breaks kept."""
    rows.write.mode("overwrite").options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def preview(rows: DataFrame, key: str, n: int = 100) -> DataFrame:
    """The ``n`` rows of the smallest keys."""
    return rows.orderBy(key).limit(n)


def write_matrix(rows: DataFrame, path: str) -> None:
    """Feature matrix as parquet."""
    with shuffles_removed(rows.sparkSession):
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_matrix(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Feature matrix, only the named columns if any."""
    rows = spark.read.parquet(path)
    return rows.select(*columns) if columns else rows


def read_vectors(spark: SparkSession, path: str, normalised: bool = False) -> DataFrame:
    """Word vectors ``word, rank, vec``; at length 1 if ``normalised``."""
    table = spark.read.parquet(path)
    return table.withColumn("vec", unit(F.col("vec"))) if normalised else table


def write_json(rows: DataFrame, path: str) -> None:
    """JSON lines, as for a trial log."""
    rows.write.mode("overwrite").json(path)


def discover(spark: SparkSession, folder: str) -> list[str]:
    """Names, without endings, of the files and tables directly in a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted({s.getPath().getName().rsplit(".", 1)[0] for s in found if not s.getPath().getName().startswith(("_", "."))})


def choose(given: str, allowed: list[str]) -> list[str]:
    """A comma-separated choice among ``allowed``; unknown names raise."""
    names = [n.strip() for n in given.split(",") if n.strip()]
    unknown = [n for n in names if n not in allowed]
    if unknown or not names:
        raise ValueError(f"choose among {', '.join(allowed)}; got {given!r}")
    return names


def metric_name(prefix: str, mean: float, std: float) -> str:
    """File name that bears the loss of its content."""
    return f"{prefix}_{mean:f}_{std:f}"


def save_model(model, path: str) -> None:
    """A fitted model, with its configuration."""
    model.write().overwrite().save(path)


def load_model(kind, path: str):
    """The model saved at ``path``; ``kind`` is its class."""
    return kind.load(path)
