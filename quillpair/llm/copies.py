"""Records that are the same but for case, spacing, punctuation and field order.

Canonical records are range-partitioned and sorted on the key's beginning, the whole
key's digest and the record's identifier; runs of equal keys lie side by side and one
pass compares full keys of neighbours.  Beginning and digest keep what is sampled for
the ranges short, however long the texts.  A run may be a third of all records: the
range partitioning takes the identifier too, so a long run is spread over many
partitions.  What joins
the parts of such a run is the first and the last key of each partition, two rows a
partition, which are the only rows that ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.sources.shared import drop_table, stage_table

#: All that is no letter, combining mark or number.
NOT_TEXT = r"[^\p{L}\p{M}\p{N}]+"
_SEPARATOR = "\u001f"  # a control character: never part of a canonical field
_RUNS = "part long, run long, id long, head long, edge string"


def canonical_record(fields: list[str]) -> F.Column:
    """Canonical key: fields in lower case without all but letters, marks and numbers, in sorted order.

    Null if any field is null or has nothing left.
    """
    plain = [F.regexp_replace(F.lower(c), NOT_TEXT, "") for c in fields]
    joined = F.array_join(F.sort_array(F.array(*plain)), _SEPARATOR)
    usable = F.lit(True)
    for c in plain:
        usable = usable & c.isNotNull() & (c != "")
    return F.when(usable, joined)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys within a partition, numbered; the keys of its first and last run stay with one row each."""
    part, run, head, last = TaskContext.get().partitionId(), -1, None, None
    for batch in batches:
        keys, ids = batch.column(0), batch.column(1)
        if not len(keys):
            continue
        new = np.ones(len(keys), bool)
        new[1:] = pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
        new[0] = last is None or keys[0].as_py() != last
        value = ids.to_numpy()
        number = run + np.cumsum(new)
        starts = np.flatnonzero(new)
        heads = np.concatenate([[head if head is not None else 0], value[starts]])
        at = heads[np.cumsum(new)]
        edge = [None] * len(keys)
        if run < 0:
            edge[0] = keys[0].as_py()  # the first run's key
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), part, np.int64)), pa.array(number.astype(np.int64)), pa.array(value), pa.array(at.astype(np.int64)), pa.array(edge, pa.string())],
            ["part", "run", "id", "head", "edge"],
        )
        run, head, last = int(number[-1]), int(at[-1]), keys[-1].as_py()
    if last is not None:  # a row of its own, without an identifier, for the last run's key
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([run]), pa.array([None], pa.int64()), pa.array([head]), pa.array([last])], ["part", "run", "id", "head", "edge"])


def collapse_copies(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(kept, id)`` for every usable record: the smallest identifier among its copies, and its own.

    Records with a null key, or a field that is null or has no letters, marks or
    numbers, are left out.  Rows that repeat an identifier are copies like any other.
    An empty table gives no rows; other columns are not read.
    """
    spark = records.sparkSession
    canon = records.select(canonical_record(fields).alias("k"), F.col(key).cast("long").alias("id")).filter("k IS NOT NULL AND id IS NOT NULL")
    canon = stage_table(canon, "canonical")  # read twice: to sample the ranges, and to be partitioned
    place = ["start", "digest", "id"]
    sorted_ = canon.withColumns({"start": F.left("k", F.lit(16)), "digest": F.unhex(F.md5("k"))}).repartitionByRange(*place).sortWithinPartitions(*place)
    runs = stage_table(sorted_.select("k", "id").mapInArrow(_scan, _RUNS), "runs")
    drop_table(canon)
    edges: dict[int, dict] = {}
    for r in runs.filter("edge IS NOT NULL").collect():  # two rows a partition
        part = edges.setdefault(r["part"], {})
        if r["id"] is not None:
            part["first"] = (r["edge"], r["head"])
        else:
            part["last"] = (r["edge"], r["head"], r["run"])
    moved, last_key, last_head = [], None, None
    for part in sorted(edges):
        first, last = edges[part]["first"], edges[part]["last"]
        goes_on = first[0] == last_key
        if goes_on:
            moved.append((part, last_head))
        if not (goes_on and last[2] == 0):
            last_head = last[1]
        last_key = last[0]
    real = runs.filter("id IS NOT NULL")
    if not moved:
        return real.select(F.col("head").alias("kept"), "id")
    fix = spark.createDataFrame(moved, "part long, true_head long").withColumn("run", F.lit(0).cast("long"))
    return real.join(F.broadcast(fix), ["part", "run"], "left").select(F.coalesce("true_head", "head").alias("kept"), "id")


def copy_counts(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(kept, copies)``: one row for each group of copies, with how many records it has."""
    return collapse_copies(records, key, fields).groupBy("kept").agg(F.count("*").alias("copies"))
