"""Streams give what batches give."""

from pyspark.sql import functions as F

from quillpair.plans.queries import QUERIES
from quillpair.streaming import views


def test_similarity_stream_over_a_folder_of_files(spark, small_dir, tmp_path):
    """A table that is a folder of several files is read whole."""
    rows = spark.read.parquet(f"{small_dir}/train.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "train.parquet"))
    got = QUERIES["st_similarity"](spark, str(tmp_path))
    want = views.similarity_stream(rows)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_windowed_counts_close_behind_the_watermark(spark, small_dir, tmp_path):
    """In append mode a day comes out once the watermark has passed it; what comes out equals the batch's."""
    rows = spark.read.parquet(f"{small_dir}/train.parquet").select("id", "source", "loaded_at")
    for k, part in enumerate((rows.filter("id <= 200"), rows.filter("id > 200"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = views.stream_pairs(spark, str(tmp_path / "in/*"), rows.schema, per_trigger=1)
    counted = views.source_counts(stream, late="3650 days")
    run = counted.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    got, want = spark.table("counts"), views.source_counts(rows)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    late = views.source_counts(views.stream_pairs(spark, str(tmp_path / "in/*"), rows.schema), late="0 seconds", width="1 hour")
    run = late.writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    closed = spark.table("closed")
    last = rows.agg(F.max("loaded_at")).first()[0]
    assert 0 < closed.count() and closed.agg(F.max("start")).first()[0] < last
