"""Makes the package importable on executors."""

from __future__ import annotations

import functools
import hashlib
import io
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from quillpair.sources.shared import put_shared_file

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send the package's modules to the workers of the session, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent.parent
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(path.relative_to(root.parent))), path.read_bytes())
    content = buffer.getvalue()
    name = f"quillpair-{hashlib.sha256(content).hexdigest()[:16]}.zip"
    spark.sparkContext.addPyFile(put_shared_file(spark, name, content))
    _shipped.add(app)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with the package sent ahead."""

    @functools.wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_package(spark)
        return query(spark, folder)

    return run
