"""Tables written to the shared checkpoint folder to cut lineage.

Intermediate results that are read more than once, and the state of iterative
operators, are written as parquet below ``spark.checkpoint.dir``.  All executors
see that folder, so a lost executor loses nothing that was written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors.

    Taken from ``spark.checkpoint.dir``.  Where that is unset a temporary folder
    is used in local mode only; on a cluster the setting is required.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="quillpair-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go when the query ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and return the table read back.

    The table lives until :func:`drop_table`, or the end of the process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillpair-{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    table = spark.read.schema(df.schema).parquet(path)
    table._staged_at = path
    return table


def drop_table(df: DataFrame) -> None:
    """Remove a table made by :func:`stage_table` (no-op for other frames)."""
    path = getattr(df, "_staged_at", None)
    if path in _written:
        _remove(path, _written.pop(path))


def _remove(path: str, spark: SparkSession) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _drop_all() -> None:
    for path, spark in list(_written.items()):
        try:
            _remove(path, spark)
        except Exception:
            pass


def put_shared_file(spark: SparkSession, name: str, content: bytes) -> str:
    """Write a small file to the shared folder; returns its place."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(content))
    out.close()
    return target.toString()
