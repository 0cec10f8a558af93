"""Records of evaluation splits that also stand, exactly or almost, in the training split.

The questions of the evaluation splits become sequences of keys
(:mod:`quillpair.llm.termsets`), in the order of their terms, each key followed by a
symbol for the size of the set and the key's place.  Keys are spread over shards; each
shard builds a backward-searched index of its evaluation sequences and then streams the
training sequences through it.  A training key is searched with the range of symbols
that its own size and place allow behind it, so that only questions come out which can
still be near; these are compared by fingerprint, merged and checked on the whole term
sets.

Pairs of records are put together from near questions.  A question may stand in a
third of all records, so each training record is looked up by that of its two
questions which leads to fewer evaluation records, and its other question is only
compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.llm.fmindex import BackwardIndex
from quillpair.llm.neighbours import FOUND, _spans, candidate_pairs, found_rows
from quillpair.llm.termsets import common_terms, near, partners, reachable, set_keys, term_sets, within
from quillpair.sources.shared import drop_table, stage_table

#: Evaluation questions of one key up to which a shard searches it by itself.
GROUP = 20_000
_COLUMNS = ("key", "cls", "fp", "n", "place", "side")


class _Shard:
    """Index of evaluation rows: sequences of keys, each followed by a symbol for its set's size and its place."""

    def __init__(self, key: np.ndarray, cls: np.ndarray, fp: np.ndarray, n: np.ndarray, place: np.ndarray):
        self.document, first, owner = np.unique(cls, return_index=True, return_inverse=True)
        self.fp, self.n = fp[first].view(np.uint64), n[first]
        symbols = np.stack([key, (n << 32) + np.where(place < 0, -1 - place, place)], axis=1)
        self.index = BackwardIndex(symbols.ravel(), np.repeat(owner, 2))
        self.sizes = int(n.max(initial=0)) + 1
        self.held = np.unique(self.index.codes(key) * self.sizes + n)  # sizes of each key's sets

    def search(self, key: np.ndarray, cls: np.ndarray, fp: np.ndarray, n: np.ndarray, place: np.ndarray, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct ``(evaluation set, training set)`` within the fingerprints' bound, of those that sizes and places allow under a key."""
        code = self.index.codes(key)
        known = np.flatnonzero(code >= 0)
        code, cls, u, n, place = code[known], cls[known], fp[known].view(np.uint64), n[known], place[known]
        low, high = partners(n, place)
        base = code * self.sizes
        low, high = np.searchsorted(self.held, base + np.minimum(low, self.sizes)), np.searchsorted(self.held, base + np.minimum(high, self.sizes - 1), side="right")
        for x, at in _spans(low, high, block):
            m = self.held[at] % self.sizes
            most = reachable(n[x], place[x], m)
            x, m, most = x[most >= 0], m[most >= 0], most[most >= 0]
            for k, suffix in _spans(*self.index.followed(code[x], m << 32, (m << 32) + most), block):
                document, y = self.index.owner[suffix], x[k]
                close = np.bitwise_count(u[y] ^ self.fp[document]) <= within(n[y], m[k])
                if close.any():
                    pair = np.unique(np.stack([self.document[document[close]], cls[y[close]]]), axis=1)
                    yield pair[0], pair[1]


def _searcher(limit: int):
    """Index of the evaluation rows, which come first; training rows are streamed through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        shard = None
        large = np.empty(0, np.int64)

        def through(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            wide = np.isin(rows[0], large)
            if wide.any():
                yield found_rows(dict(zip(_COLUMNS, [r[wide] for r in rows], strict=True)), int(wide.sum()))

        for batch in batches:
            rows = [np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in range(5)]
            one = rows[1] >= 0
            rows[1] = rows[1] & ((1 << 63) - 1)
            rows.append(one.astype(np.int64))
            if not one.all():
                held.append([r[~one] for r in rows])
            rows = [r[one] for r in rows]
            if not len(rows[0]):
                continue
            if shard is None:
                zero = [np.concatenate([h[k] for h in held]) if held else np.empty(0, np.int64) for k in range(6)]
                values, count = np.unique(zero[0], return_counts=True)
                large = values[count > limit]
                yield from through(zero)
                keep = ~np.isin(zero[0], large)
                shard = _Shard(*(z[keep] for z in zero[:5]))
                held = []
            if len(large):
                yield from through(rows)
            for a, b in shard.search(*rows[:5]):
                yield found_rows({"a": a, "b": b}, len(a))

    return run


def candidate_links(evaluation: DataFrame, training: DataFrame, limit: int = GROUP) -> DataFrame:
    """Distinct ``(a, b)``: evaluation and training sets that share a key and are within the fingerprints' bound."""
    # classes are not negative: with the top bit set for evaluation sets, one long sorts them first
    low = F.lit(-(1 << 63))
    mark = F.when(F.col("side") == 0, F.col("cls").bitwiseOR(low)).otherwise(F.col("cls"))
    both = evaluation.unionByName(training).select("key", mark.alias("cls"), "fp", "n", "place")
    found = both.repartition("key").sortWithinPartitions("cls", "place", "key").mapInArrow(_searcher(limit), FOUND)
    found = stage_table(found, "links")
    pairs = found.filter("a IS NOT NULL").select("a", "b")
    over = found.filter("a IS NULL")
    if not over.isEmpty():
        pairs = pairs.unionByName(candidate_pairs(over, limit))
    return pairs.distinct()


def _pair_rows(df: DataFrame, key: str, fields: tuple[str, str]) -> DataFrame:
    """``(id, slot, t)``: the questions of each record, one a row."""
    first, second = (df.select(F.col(key).cast("long").alias("id"), F.lit(s).cast("long").alias("slot"), F.col(f).alias("t")) for s, f in enumerate(fields))
    return first.unionByName(second)


def _both_questions(rows: DataFrame) -> DataFrame:
    """``(id, c0, c1)`` of records with two usable questions; a record is one row of the source."""
    first = rows.filter("slot = 0").select("id", F.col("cls").alias("c0"))
    return first.join(rows.filter("slot = 1").select("id", F.col("cls").alias("c1")), "id")


def _sets_of_pairs(df: DataFrame, key: str, fields: tuple[str, str]) -> DataFrame:
    """``term_sets`` of both questions of each record, with ``id`` and ``slot``; read once for sets and records."""
    return stage_table(term_sets(_pair_rows(df.filter(F.col(key).isNotNull()), key, fields), ["id", "slot"], "t"), "pair-sets")


def overlapping_records(training: DataFrame, evaluation: DataFrame, train_key: str, eval_key: str, fields: tuple[str, str], limit: int = GROUP) -> DataFrame:
    """``(train_key, eval_key)`` of records whose questions match one to one, straight or crossed, each match near.

    Records with a null key, or with a question that is null, empty or of fewer than
    three distinct terms, match nothing.  Keys are unique in their table.  An empty
    table on either side gives no rows; other columns are not read.
    """
    t_sets, e_sets = _sets_of_pairs(training, train_key, fields), _sets_of_pairs(evaluation, eval_key, fields)
    rank = common_terms(t_sets, e_sets)
    links = stage_table(candidate_links(set_keys(e_sets, rank, 0), set_keys(t_sets, rank, 1), limit), "links")

    def texts_of(sets: DataFrame, side: str) -> DataFrame:
        return sets.filter("count IS NULL").select(F.col("cls").alias(side), F.col("canon").alias(f"{side}_canon")).join(links.select(side).distinct().hint("shuffle_hash"), side, "left_semi").distinct()

    # the exact check, on the whole sets of linked questions
    exact = links.join(texts_of(e_sets, "a"), "a").join(texts_of(t_sets, "b"), "b").filter(near(F.col("a_canon"), F.col("b_canon")))
    linked = stage_table(exact.select("a", "b").distinct(), "near-questions")

    def records(sets: DataFrame, side: str) -> DataFrame:
        rows = sets.filter("count IS NULL").select("id", "slot", "cls")
        return _both_questions(rows.join(linked.select(F.col(side).alias("cls")).distinct().hint("shuffle_hash"), "cls", "left_semi"))

    t_rows, e_rows = stage_table(records(t_sets, "b"), "t-rows"), stage_table(records(e_sets, "a"), "e-rows")
    drop_table(t_sets)
    drop_table(e_sets)
    # evaluation records that a training question leads to, in either slot
    in_slot = e_rows.select(F.col("c0").alias("a"), F.col("c1").alias("rest"), F.col("id").alias("e")).unionByName(
        e_rows.select(F.col("c1").alias("a"), F.col("c0").alias("rest"), F.col("id").alias("e"))
    )
    held = in_slot.groupBy("a").agg(F.count("*").alias("held"))
    leads = linked.join(held, "a").groupBy("b").agg(F.sum("held").alias("leads"))
    counted = (
        t_rows.join(leads.select(F.col("b").alias("c0"), F.col("leads").alias("l0")), "c0")
        .join(leads.select(F.col("b").alias("c1"), F.col("leads").alias("l1")), "c1")
        .select(
            F.col("id").alias("t"),
            F.when(F.col("l0") <= F.col("l1"), F.col("c0")).otherwise(F.col("c1")).alias("b"),
            F.when(F.col("l0") <= F.col("l1"), F.col("c1")).otherwise(F.col("c0")).alias("other"),
        )
    )
    reached = counted.join(linked, "b").join(in_slot, "a")
    checked = reached.join(linked.select(F.col("a").alias("rest"), F.col("b").alias("other")), ["rest", "other"], "left_semi")
    return checked.select(F.col("t").alias(train_key), F.col("e").alias(eval_key)).distinct()


def overlap_report(found: DataFrame, evaluation: DataFrame, eval_key: str, by: list[str]) -> DataFrame:
    """Per ``by`` (split, source, ...): evaluation records, those that overlap, their share and the matched pairs.

    Nulls in ``by`` are a group of their own.
    """
    hits = found.groupBy(eval_key).agg(F.count("*").alias("pairs"))
    joined = evaluation.select(eval_key, *by).join(hits, eval_key, "left")
    return joined.groupBy(*by).agg(
        F.count("*").alias("records"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("matched_pairs"), F.round(F.count("pairs") / F.count("*"), 6).alias("share")
    )
