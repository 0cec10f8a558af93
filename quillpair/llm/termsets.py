"""Term sets of texts: fingerprints and keys that no similar pair can miss.

Two sets are *near* if both have ``LEAST`` terms or more and they share at least
``NUM / DEN`` of the terms in either.

Fingerprint: 64 bits, each term flips the bit its hash names.  Sets that differ in x
terms have fingerprints that differ in at most x bits, so near sets of sizes m and n
differ in at most ``2 * floor((m + n) / (1 + t)) - m - n`` bits.

Keys: the terms of a set are put into one order for all sets, uncommon terms first by
hash, then common ones from the least common.  Of near sets

* sets of at most ``SHORT`` terms share one of the first n - ceil(t n) + 1 terms.  If
  it is uncommon, its own key is shared.  Else two common terms of the first
  n - ceil(t n) + 2 are shared, and the key of these two is.  (Three would reach deeper
  into the common terms, which stand together in texts of one make.)
* longer sets share at least 0.4 n - 1 of their pairs of neighbouring terms, as a term
  that only one of them has breaks up at most two pairs; hence one of the first
  0.6 n + 1 pairs is shared, and these are the keys (fewer for sets of at most ``SHORT``
  terms, which only need those shared with longer ones).

Places: of the keys that two near sets share, the first one tells how many terms the
sets can still share.  If it stands behind u terms that are not shared, a set of n terms
shares at most n - u, so sets whose keys stand too far behind for their sizes are not
compared under that key (:func:`partners`).  This is what bounds the work at keys of
common terms: most of their sets stand there because no uncommon term is shared, and few
are so near otherwise.  Two sets of at most ``SHORT`` terms meet at their short keys, so
keys of neighbours only bring together sets of which one is longer.

Which terms are common only steers the work; any choice gives the same result.  They
are counted over all texts; at most 2 * (mean terms) / ``COMMON_SHARE`` terms qualify,
which bounds what is sent to the workers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.llm.terms import split_terms

NUM, DEN, LEAST = 7, 10, 3
SHORT = 64
COMMON_SHARE = 1 / 2000
_REMEMBERED = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _class_of(canon: list[str]) -> np.ndarray:
    """63-bit hash of each set; equal hashes of different sets are told apart by the exact check."""
    return (np.array([xxhash.xxh3_64_intdigest(c) for c in canon], np.uint64) >> np.uint64(1)).view(np.int64)


def term_sets(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Rows of ``df`` with a usable text: ``keys``, ``cls``, ``canon``; and rows of counts with ``count`` set.

    ``canon`` is the sorted set of terms, ``cls`` its 63-bit hash.  Texts with fewer
    than ``LEAST`` terms are left out.  Count rows, one for each term that is common
    within a partition, have null keys, the term as ``canon`` and null ``cls``; a row
    with null ``canon`` has the number of texts.
    """
    source = df.select(*keys, text)
    fields = [f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keys]
    types = [pa.string() if source.schema[k].dataType.simpleString() == "string" else pa.int64() for k in keys]
    names = [*keys, "cls", "canon", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Counter(), 0
        for batch in batches:
            at, canon = [], []
            for k, t in enumerate(batch.column(len(keys)).to_pylist()):
                terms = set(split_terms(t))
                if len(terms) >= LEAST:
                    at.append(k)
                    canon.append(" ".join(sorted(terms)))
                    seen.update(terms)
            total += len(at)
            if len(seen) > _REMEMBERED:
                floor = max(2, total * COMMON_SHARE / 2)
                seen = Counter({w: c for w, c in seen.items() if c >= floor})
            cls = _class_of(canon)
            index = pa.array(at, pa.int64())
            columns = [batch.column(i).take(index).cast(types[i]) for i in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cls), pa.array(canon, pa.string()), pa.nulls(len(at), pa.int64())], names)
        common = [(w, c) for w, c in seen.items() if c >= max(2, total * COMMON_SHARE)] + [(None, total)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(len(common), t) for t in types), pa.nulls(len(common), pa.int64()), pa.array([w for w, _ in common], pa.string()), pa.array([c for _, c in common], pa.int64())], names
        )

    return source.mapInArrow(run, ", ".join([*fields, "cls long", "canon string", "count long"]))


def common_terms(*sets: DataFrame) -> dict[str, int]:
    """Rank of each common term, the least common first, from the count rows."""
    counts = sets[0].filter("count IS NOT NULL").select("canon", "count")
    for s in sets[1:]:
        counts = counts.unionByName(s.filter("count IS NOT NULL").select("canon", "count"))
    summed = counts.groupBy("canon").agg(F.sum("count").alias("n"))
    total = summed.filter("canon IS NULL").first()
    if total is None or not total["n"]:
        return {}
    rows = summed.filter(F.col("canon").isNotNull() & (F.col("n") >= max(2.0, total["n"] * COMMON_SHARE / 2))).collect()
    return {r["canon"]: k for k, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["canon"])))}


def within(m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Most bits in which fingerprints of near sets of sizes m and n differ; negative if no such sets are near."""
    s = m + n
    d = 2 * (DEN * s // (NUM + DEN)) - s
    return np.where(d >= np.abs(m - n), d, -1)


def radius(n: np.ndarray) -> np.ndarray:
    """Most bits between a set of n terms and any near set."""
    return n * (DEN - NUM) // NUM


def _unshared(n: np.ndarray, m: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Most places of a set of n terms before the first key that it shares with a near set of m terms."""
    need = -(-NUM * (n + m) // (NUM + DEN))
    # a pair of neighbours is broken by a term that only this set has (two pairs at most), or that only the other has (one)
    return np.where(long, 2 * n + m - 3 * need, n - need)


def partners(n: np.ndarray, place: np.ndarray, smaller: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Least and most terms of the sets that an entry of n terms at ``place`` may be near to; with ``smaller`` at most n."""
    long = place < 0
    low = np.where(long & (n <= SHORT), np.maximum(-(-NUM * n // DEN), SHORT + 1), -(-NUM * n // DEN))
    high = n if smaller else n * DEN // NUM
    return low, np.where(long, high, np.minimum(high, ((NUM + DEN) * (n - place) - NUM * n) // NUM))


def reachable(n: np.ndarray, place: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Last place, without its sign, at which a set of m terms may share its first key with an entry of n terms at ``place``; negative if none."""
    long = place < 0
    most = _unshared(m, n, long)
    return np.where(np.where(long, -1 - place, place) <= _unshared(n, m, long), most, -1)


def _distinct_rows(batch: pa.RecordBatch, seen: set[int]) -> list[str]:
    fresh = []
    for cls, canon in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if cls not in seen:
            seen.add(cls)
            fresh.append(canon)
    if len(seen) > 2 * _REMEMBERED:
        seen.clear()
    return fresh


def _keys_of(canon: list[str], rank: dict[str, int]) -> tuple[np.ndarray, ...]:
    """``(row, place, key)`` of the keys in order, and ``(n, fingerprint)`` of each set.

    ``place`` counts the terms before the key that are not shared if it is the first key shared: of
    two common terms all before the second but the first.  For pairs of neighbours it is -1 - the number of pairs before.
    """
    split = [c.split(" ") for c in canon]
    n = np.fromiter(map(len, split), np.int64, len(split))
    codes, terms = pd.factorize(np.array([t for s in split for t in s], dtype=object))
    hashed = np.array([xxhash.xxh3_64_intdigest(t) for t in terms], np.uint64)
    common = np.array([rank.get(t, -1) for t in terms], np.int64)
    order = np.where(common < 0, hashed >> np.uint64(1), (np.uint64(1) << np.uint64(63)) + common.astype(np.uint64))
    row = np.repeat(np.arange(len(split)), n)
    at = np.lexsort((order[codes], row))
    h, hot = hashed[codes][at], common[codes][at] >= 0
    ends = np.cumsum(n)
    place = np.arange(len(row)) - np.repeat(ends - n, n)
    bits = np.left_shift(np.uint64(1), h & np.uint64(63))
    fp = np.bitwise_xor.reduceat(bits, ends - n) if len(n) else np.empty(0, np.uint64)
    size = n[row]
    first = size - -(-NUM * size // DEN) + 1
    rows, places, keys = [], [], []

    def add(sel: np.ndarray, at: np.ndarray, key: np.ndarray) -> None:
        rows.append(row[sel])
        places.append(at)
        keys.append(key)

    short = size <= SHORT
    sel = np.flatnonzero(short & ~hot & (place < first))
    add(sel, place[sel], h[sel])
    reach = np.flatnonzero(short & hot & (place < first + 1))
    owner, hashes = row[reach], h[reach]
    for step in range(1, SHORT):  # pairs of common terms, which stand together, `step` places apart
        i = np.flatnonzero(owner[:-step] == owner[step:])
        if not len(i):
            break
        add(reach[i], place[reach[i]] + step - 1, hashes[i] * _MIX + hashes[i + step])
    long = size * DEN > NUM * SHORT
    other = np.where(short, SHORT + 1, -(-NUM * size // DEN))  # the size of near sets that leaves the most places
    sel = np.flatnonzero(long[:-1] & (row[:-1] == row[1:]) & ((NUM + DEN) * place[:-1] <= (2 * DEN - NUM) * size[:-1] - (2 * NUM - DEN) * other[:-1]))
    add(sel, -1 - place[sel], (h[sel] * _MIX + h[sel + 1]) ^ _MIX)
    return np.concatenate(rows), np.concatenate(places), np.concatenate(keys).view(np.int64), n, fp.view(np.int64)


def set_keys(sets: DataFrame, rank: dict[str, int], side: int = -1) -> DataFrame:
    """``(key, cls, place, n, fp, side)``: the keys of each distinct set, with its size and fingerprint."""
    shared = sets.sparkSession.sparkContext.broadcast(rank)
    names = ["key", "cls", "place", "n", "fp", "side"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            canon = _distinct_rows(batch, seen)
            if not canon:
                continue
            row, place, key, n, fp = _keys_of(canon, shared.value)
            cls = _class_of(canon)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(cls[row]), pa.array(place.astype(np.int32)), pa.array(n[row].astype(np.int32)), pa.array(fp[row]), pa.array(np.full(len(row), side, np.int8))], names
            )

    return sets.filter("count IS NULL").select("cls", "canon").mapInArrow(run, "key long, cls long, place int, n int, fp long, side byte")


def near(canon_a: F.Column, canon_b: F.Column) -> F.Column:
    """Whether two sets, as ``canon``, are near: the exact check."""
    a, b = F.split(canon_a, " "), F.split(canon_b, " ")
    both = F.size(F.array_intersect(a, b))
    return (canon_a == canon_b) | (both * (NUM + DEN) >= (F.size(a) + F.size(b)) * NUM)
