"""Frequency of every distinct term from compressed bitmaps of record identifiers.

Vertical layout.  Records are numbered; a chunk is 32,768 consecutive numbers.  For
each term and chunk there is one container: two-byte positions, or, for 2,048
records and more, a 4,096-byte bitmap, with the occurrences counted beside it.  A
container is about as small as its content: two bytes a record for rare terms, an
eighth of a byte a record for terms found everywhere.  The keys of a chunk's records
are kept beside the bitmaps, so a bitmap leads back to its records.

Containers are built in parallel, a batch of records at a time, and united by term and
chunk; the document frequency of a term is the sum of its containers' cardinalities.
Indexes of several tables are united in the same way: a table's name is part of the
chunk.

Scale: no container is longer than 4 KB and no more of them come together than a chunk
has batches, so a term found everywhere is spread over as many keys as there are
chunks.  Frequencies are combined before their shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.llm.terms import count_terms

CHUNK = 32_768
#: Most records of a container that are kept as positions; these stay shorter than a bitmap.
DENSE = 2_047
#: Stands for a null key.
NO_KEY = -(1 << 63)
_INDEX = "term string, part string, chunk long, container binary, occurrences long"


def pack(positions: np.ndarray) -> bytes:
    """Container of sorted distinct positions below ``CHUNK``."""
    if len(positions) <= DENSE:
        return positions.astype("<u2").tobytes()
    bits = np.zeros(CHUNK, np.uint8)
    bits[positions] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack(container: bytes) -> np.ndarray:
    """Sorted positions of a container."""
    if len(container) < CHUNK // 8:
        return np.frombuffer(container, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(container, np.uint8), bitorder="little"))


def _containers(texts: list[str | None], first: int, part: str, chunk: int) -> pa.RecordBatch:
    """A container for each term of consecutive records of one chunk, of which the first has position ``first``."""
    row, code, count, terms = count_terms(texts)
    order = np.argsort(code, kind="stable")  # rows stay sorted within a term
    row, code, count = row[order] + first, code[order], count[order]
    start = np.flatnonzero(np.diff(code, prepend=-1))
    end = np.append(start, len(code))[1:]
    low = row.astype("<u2").tobytes()
    packed = [low[2 * a : 2 * b] if b - a <= DENSE else pack(row[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
    sums = np.add.reduceat(count, start) if len(start) else np.empty(0, np.int64)
    return _index_rows(terms[code[start]], part, chunk, packed, sums)


def _index_rows(terms: list, part: str, chunk: int, containers: list[bytes], occurrences: np.ndarray | None) -> pa.RecordBatch:
    n = len(containers)
    counts = pa.nulls(n, pa.int64()) if occurrences is None else pa.array(occurrences.astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([part] * n, pa.string()), pa.array(np.full(n, chunk, np.int64)), pa.array(containers, pa.binary()), counts],
        ["term", "part", "chunk", "container", "occurrences"],
    )


def build_bitmaps(df: DataFrame, key: str, column: str, part: str = "") -> DataFrame:
    """Containers of ``column``: ``(term, part, chunk, container, occurrences)``, one for each term and batch of records.

    A row without a term holds the keys of a batch's records, in order, as 8-byte
    integers behind the position of the first.  Every row of ``df`` is a record of its
    own, repeated rows too; a null key is kept as the least integer.  Rows with a null or
    empty text hold no terms.  An empty table gives an empty index.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0)
            keys, texts = batch.column(1).fill_null(NO_KEY).to_numpy(zero_copy_only=False).astype("<i8"), batch.column(2).to_pylist()
            done = 0
            while done < len(texts):
                chunk, first = divmod(numbers[done].as_py(), CHUNK)  # numbers of a partition follow each other
                some = min(len(texts) - done, CHUNK - first)
                yield _containers(texts[done : done + some], first, part, chunk)
                yield _index_rows([None], part, chunk, [np.array([first], "<i8").tobytes() + keys[done : done + some].tobytes()], None)
                done += some

    return df.select(F.monotonically_increasing_id(), F.col(key).cast("long").alias("key"), column).mapInArrow(index, _INDEX)


def cardinality(container: F.Column) -> F.Column:
    """Records in a container."""
    size = F.octet_length(container)
    return F.when(size < CHUNK // 8, F.floor(size / 2)).otherwise(F.bitmap_count(container)).cast("long")


def merge_bitmaps(*indexes: DataFrame) -> DataFrame:
    """Union of indexes: containers of a term, part and chunk become one; rows of keys stay.

    Occurrences of a record that several containers hold add up.
    """

    @F.pandas_udf("binary")
    def unite(parts: pd.Series) -> pd.Series:
        return parts.map(lambda p: pack(np.unique(np.concatenate([unpack(x) for x in p]))))

    every = indexes[0]
    for other in indexes[1:]:
        every = every.unionByName(other)
    # at most one container for each batch of a chunk comes together here
    merged = every.filter("term IS NOT NULL").groupBy("term", "part", "chunk").agg(F.collect_list("container").alias("parts"), F.sum("occurrences").alias("occurrences"))
    alone = merged.filter(F.size("parts") == 1).withColumn("container", F.element_at("parts", 1))
    united = merged.filter(F.size("parts") > 1).withColumn("container", unite("parts"))
    names = ["term", "part", "chunk", "container", "occurrences"]
    return alone.select(names).unionByName(united.select(names)).unionByName(every.filter("term IS NULL").select(names))


def term_frequencies(index: DataFrame) -> DataFrame:
    """``(term, records, occurrences)`` of a merged index, by the cardinality of its containers."""
    return index.filter("term IS NOT NULL").groupBy("term").agg(F.sum(cardinality(F.col("container"))).alias("records"), F.sum("occurrences").alias("occurrences"))


def records_of(index: DataFrame, terms: DataFrame) -> DataFrame:
    """``(term, part, key)``: the records of each of ``terms`` (term), from its bitmaps and the keys beside them.

    Null keys come back as null.  Repeated terms count once.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk = batch.column(2).to_numpy() * CHUNK
            found = [unpack(c) for c in batch.column(3).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            number = np.concatenate([np.empty(0, np.int64), *found]) + chunk[at]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number)], ["term", "part", "number"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, chunk, raw in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                own = np.frombuffer(raw, "<i8")
                number = chunk * CHUNK + own[0] + np.arange(len(own) - 1)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(number), pa.string()), pa.array(number), pa.array(own[1:], mask=own[1:] == NO_KEY)], ["part", "number", "key"])

    wanted = index.filter("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi").select("term", "part", "chunk", "container")
    beside = index.filter("term IS NULL").select("term", "part", "chunk", "container").mapInArrow(keys, "part string, number long, key long")
    return wanted.mapInArrow(places, "term string, part string, number long").join(beside, ["part", "number"]).select("term", "part", "key")


def mark_terms(frequencies: DataFrame, records: int, rare_below: int = 3, common_part: int = 20) -> DataFrame:
    """Adds ``mark``: ``rare`` if in fewer than ``rare_below`` records, ``common`` if in more than one
    record of ``common_part``, else null.  A term that is both is rare."""
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") * common_part > F.lit(records), "common")
    return frequencies.withColumn("mark", mark)
