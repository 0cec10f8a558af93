"""Near-duplicate texts by vantage points over fingerprints.

Sets of terms get fingerprints and keys (:mod:`quillpair.llm.termsets`); near sets
share a key.  Every key has a vantage point of its own, a fingerprint of random bits, and
the fingerprints of a key are partitioned by their Hamming distance to it into shards.  A
set lives in the shard of its distance and visits the shards above that its reach
overlaps, so each pair within reach meets in one shard.  In a shard sets stand in cells
of one size and place of the key, and in a cell in the order of their distance to a second
vantage point: a set is only compared with the cells that its size and place allow, and
there, by the triangle inequality, with the sets that its reach leaves.  Of a shard too
large for one task those sets are taken out that no other one's size and place allow;
if it still is, it is partitioned again, by a vantage point taken from its sets, each pair
of parts in reach in a task of its own.  What is found is checked on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.llm.termsets import DEN, NUM, SHORT, common_terms, near, partners, reachable, set_keys, term_sets, within
from quillpair.sources.shared import drop_table, stage_table

#: Distances to a key's vantage point that make up a shard, and sets up to which a shard is compared within one task.
BAND, GROUP = 8, 60_000
_SECOND = np.uint64(0x9E3779B97F4A7C15)  # the second vantage point: any bits will do
_ENTRY = ("key", "cls", "fp", "n", "side", "home", "place")
_KINDS = {"a": pa.int64(), "b": pa.int64(), "key": pa.int64(), "cls": pa.int64(), "fp": pa.int64(), "n": pa.int32(), "side": pa.int8(), "home": pa.int8(), "place": pa.int32()}
FOUND = "a long, b long, key long, cls long, fp long, n int, side byte, home byte, place int"


def found_rows(columns: dict[str, np.ndarray], size: int) -> pa.RecordBatch:
    """Rows of ``FOUND``; columns that are not given are null."""
    return pa.RecordBatch.from_arrays([pa.array(columns[k].astype(t.to_pandas_dtype())) if k in columns else pa.nulls(size, t) for k, t in _KINDS.items()], list(_KINDS))


def _spans(low: np.ndarray, high: np.ndarray, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, position)`` of all positions from low to high of each row, in blocks of about ``block``."""
    width = np.maximum(high - low, 0)
    ends, start = np.cumsum(width), 0
    while start < len(width):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + block, side="right")))
        w = width[start:stop]
        row = np.repeat(np.arange(start, stop), w)
        yield row, np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w) + low[row]
        start = stop


def _compare(
    key: np.ndarray, cls: np.ndarray, fp: np.ndarray, n: np.ndarray, side: np.ndarray, home: np.ndarray, place: np.ndarray | None = None, block: int = 1_000_000
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different sets of one key within the fingerprints' bound that sizes and places allow, at least one at home; sets with sides only across them."""
    none = np.empty(0, np.int64)
    place = np.zeros(len(key), np.int64) if place is None else place
    _, code, count = np.unique(key, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[code] > 1)
    if not len(some):
        return none, none
    code, cls, u, n, side, home, place = code[some], cls[some], fp[some].view(np.uint64), n[some], side[some], home[some] == 1, place[some]
    before, far = np.where(place < 0, -1 - place, place), np.bitwise_count(u ^ _SECOND).astype(np.int64)
    order = np.lexsort((far, before, n, code))
    code, cls, u, n, side, home, place, before, far = (x[order] for x in (code, cls, u, n, side, home, place, before, far))
    # cells of one key, size and place
    fresh = np.r_[True, (np.diff(code) != 0) | (np.diff(n) != 0) | (np.diff(before) != 0)]
    cell, starts = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    sizes = n.max() + 1
    by_size, by_far = code[starts] * sizes + n[starts], cell * 65 + far
    low, high = partners(n, place, smaller=True)
    pairs = []
    # a set goes through the cells of sets that are not larger, down to its own
    for x, c in _spans(np.searchsorted(by_size, code * sizes + low), np.minimum(np.searchsorted(by_size, code * sizes + high, side="right"), cell + 1), block):
        m = n[starts[c]]
        allowed = before[starts[c]] <= reachable(n[x], place[x], m)
        x, c, m = x[allowed], c[allowed], m[allowed]
        reach = np.minimum(within(n[x], m), 64)
        first = np.searchsorted(by_far, c * 65 + np.maximum(far[x] - reach, 0))
        last = np.where(c == cell[x], x, np.searchsorted(by_far, c * 65 + np.minimum(far[x] + reach, 64), side="right"))
        for k, y in _spans(first, last, block):
            z = x[k]
            close = np.flatnonzero((np.bitwise_count(u[z] ^ u[y]) <= reach[k]) & (home[z] | home[y]))
            z, y = z[close], y[close]
            close = np.where(side[z] < 0, cls[z] != cls[y], side[z] != side[y])  # one set may stand on both sides
            z, y = z[close], y[close]
            swap = np.where(side[z] < 0, cls[z] > cls[y], side[z] > side[y])
            if len(z):
                pairs.append(np.unique(np.stack([np.where(swap, cls[y], cls[z]), np.where(swap, cls[z], cls[y])]), axis=1))
    if not pairs:
        return none, none
    pair = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return pair[0], pair[1]


def _scanner(limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the shards of a partition sorted by key; shards beyond ``limit`` pass through as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        passing = None  # the key of a shard that is passing through

        def through(rows: list[np.ndarray]) -> pa.RecordBatch:
            return found_rows(dict(zip(_ENTRY, rows, strict=True)), len(rows[0]))

        def compared(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            a, b = _compare(*rows)
            if len(a):
                yield found_rows({"a": a, "b": b}, len(a))

        for batch in batches:
            rows = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(len(_ENTRY))]
            if passing is not None:
                more = rows[0] == passing
                if more.any():
                    yield through([r[more] for r in rows])
                    rows = [r[~more] for r in rows]
                if not len(rows[0]):
                    continue
                passing = None
            if held is not None:
                rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)]
                held = None
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if len(rows[0]) - last > limit:
                passing = int(rows[0][-1])
                yield through([r[last:] for r in rows])
                rows = [r[:last] for r in rows]
            elif len(rows[0]) < 200_000:
                held = rows  # collect more: many shards at once are cheaper
                continue
            else:
                held = [r[last:] for r in rows]
                rows = [r[:last] for r in rows]
            if len(rows[0]):
                yield from compared(rows)
        if held is not None:
            last = int(np.searchsorted(held[0], held[0][-1]))
            if len(held[0]) - last > limit:
                yield through([r[last:] for r in held])
                held = [r[:last] for r in held]
            if len(held[0]):
                yield from compared(held)

    return run


def _scan(entries: DataFrame, limit: int) -> DataFrame:
    return entries.select(*_ENTRY).repartition("key").sortWithinPartitions("key").mapInArrow(_scanner(limit), FOUND)


def _banded(entries: DataFrame) -> DataFrame:
    """Entries in the shard of their distance to their key's vantage point, and in those above that their reach overlaps."""
    far = F.bit_count(F.col("fp").bitwiseXOR(F.xxhash64("key")))
    reach = F.least(F.floor(F.col("n") * 3 / 7), F.lit(64))
    placed = entries.select("key", "cls", "fp", "n", "side", "place", F.floor(far / BAND).cast("int").alias("first"), F.least(F.floor((far + reach) / BAND), F.lit(64 // BAND)).cast("int").alias("last"))
    visited = placed.withColumn("shard", F.explode(F.sequence("first", "last")))
    return visited.select(F.xxhash64("key", "shard").alias("key"), "cls", "fp", "n", "side", (F.col("shard") == F.col("first")).cast("byte").alias("home"), "place")


def _allowed(over: DataFrame) -> DataFrame:
    """Entries of large shards without those that no other one's size and place allow."""
    cell = ["key", "n", "place"]
    cells = over.groupBy(*cell).agg(F.count("*").alias("held"))
    m, q = F.col("m"), F.col("q")
    need = F.ceil((F.col("n") + m) * NUM / (NUM + DEN))
    short = (F.col("place") >= 0) & (F.col("n") - F.col("place") >= need) & (m - q >= need)
    long = (F.col("place") < 0) & (F.greatest("n", "m") > SHORT) & (-1 - F.col("place") <= 2 * F.col("n") + m - 3 * need) & (-1 - q <= 2 * m + F.col("n") - 3 * need)
    other = cells.select("key", F.col("n").alias("m"), F.col("place").alias("q"), F.col("held").alias("more"))
    same = (F.col("n") == m) & (F.col("place") == q)
    met = cells.join(other, "key").filter((short | long) & ~(same & (F.col("more") < 2)))
    return over.join(met.select(*cell).distinct(), cell, "left_semi").select(*_ENTRY)


def _parted(over: DataFrame, limit: int) -> DataFrame:
    """Entries of large shards, cut by distance to a vantage point and sent to all pairs of parts in reach."""
    # a shard with sides (0 and 1) only pairs unlike sides; of two sets under a key of neighbours one is long
    over = over.select(*_ENTRY).distinct().withColumn("lesser", (F.col("place") < 0) & (F.col("n") <= SHORT))
    points = over.groupBy("key").agg(F.min_by("fp", "cls").alias("point"), F.max("n").alias("most"))
    far = over.join(points, "key").withColumn("d", F.bit_count(F.col("fp").bitwiseXOR(F.col("point"))))
    sizes = far.groupBy("key", "lesser", "d").agg(F.ceil(F.count("*") / F.lit(max(1, limit // 4))).cast("int").alias("parts"))
    placed = far.join(sizes, ["key", "lesser", "d"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    other = sizes.select("key", F.col("lesser").alias("lesser2"), F.col("d").alias("d2"), F.col("parts").alias("parts2"))
    reach = F.floor(F.col("most") * 3 / 7)
    sent = placed.join(other, "key").filter((F.abs(F.col("d") - F.col("d2")) <= reach) & ~(F.col("lesser") & F.col("lesser2")))
    sent = sent.withColumn("part2", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    mine, theirs = ((F.col(f"lesser{k}").cast("long") * 65 + F.col(f"d{k}")) * 1_000_000 + F.col(f"part{k}") for k in ("", "2"))
    cell = F.xxhash64("key", F.least(mine, theirs), F.greatest(mine, theirs))
    plain = sent.filter(F.col("side") < 0).select(
        cell.alias("key"), "cls", "fp", "n", F.when(mine == theirs, -1).when(mine < theirs, 0).otherwise(1).cast("byte").alias("side"), "home", "place"
    )
    # with sides, an ordered pair of parts: side 0 in the first, side 1 in the second
    ordered = F.when(F.col("side") == 0, F.xxhash64("key", mine, theirs)).otherwise(F.xxhash64("key", theirs, mine))
    return plain.unionByName(sent.filter(F.col("side") >= 0).select(ordered.alias("key"), "cls", "fp", "n", "side", "home", "place"))


def candidate_pairs(entries: DataFrame, limit: int = GROUP) -> DataFrame:
    """Distinct pairs ``(a, b)`` of sets that share a key and whose fingerprints are within the bound."""
    found = stage_table(_scan(_banded(entries), limit), "found")
    pairs = found.filter("a IS NOT NULL").select("a", "b")
    if found.filter("a IS NULL").isEmpty():
        return pairs.distinct()
    again = stage_table(_scan(_allowed(found.filter("a IS NULL")), limit), "found-again")
    pairs = pairs.unionByName(again.filter("a IS NOT NULL").select("a", "b"))
    over = again.filter("a IS NULL")
    if not over.isEmpty():
        pairs = pairs.unionByName(_scan(_parted(over, limit), 1 << 62).select("a", "b"))
    return pairs.distinct()


def near_pairs(texts: DataFrame, key: str, text: str, limit: int = GROUP) -> DataFrame:
    """``(key_a, key_b)``, a < b: keys whose texts are near; texts with the same terms are.

    ``texts`` may repeat rows.  Null keys, null and empty texts and texts with fewer
    than three distinct terms have no pairs.  An empty table gives no rows.
    """
    rows = texts.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).filter("k IS NOT NULL AND t <> ''").distinct()
    sets = stage_table(term_sets(rows, ["k"], "t"), "term-sets")
    members = sets.filter("count IS NULL").select("k", "cls", "canon")
    pairs = candidate_pairs(set_keys(sets, common_terms(sets)), limit)
    same = members.groupBy("cls").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last")
    pairs = stage_table(pairs.unionByName(same.select(F.col("cls").alias("a"), F.col("cls").alias("b"))), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    chosen = stage_table(members.join(wanted.hint("shuffle_hash"), "cls", "left_semi"), "members")
    drop_table(sets)
    a = chosen.select(F.col("cls").alias("a"), F.col("k").alias("ka"), F.col("canon").alias("ca"))
    b = chosen.select(F.col("cls").alias("b"), F.col("k").alias("kb"), F.col("canon").alias("cb"))
    checked = pairs.join(a, "a").join(b, "b").filter((F.col("ka") != F.col("kb")) & near(F.col("ca"), F.col("cb")))
    return checked.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()
