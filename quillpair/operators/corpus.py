"""Aggregates over a corpus, lookups and the graph of questions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpair.functions.grams import word_pairs
from quillpair.functions.similarity import divide, equal_places
from quillpair.functions.text import STOP_WORDS, words
from quillpair.sources.pairs import question_texts
from quillpair.sources.shared import drop_table, stage_table


def token_counts(texts: DataFrame, column: str = "text", lower: bool = True) -> DataFrame:
    """``(token, n)``: occurrences of each word; null texts have none."""
    text = F.lower(column) if lower else F.col(column)
    return texts.select(F.explode(words(text)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def value_counts(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(text, n)``: rows of each text; null counts as the empty text."""
    return texts.select(F.coalesce(F.col(column), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("n"))


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """``(token, n, token_id)``: from 2 by falling count, then token; 0 is unknown, 1 padding.

    The counted tokens are sorted over ranges, so no task ranks the many tokens that occur
    once, or share a beginning; a place is the tokens of earlier ranges and the place within.
    """
    counts = stage_table(token_counts(texts, column, lower=False), "token-counts")  # read twice: to sample the ranges, and to be partitioned
    order = [F.desc("n"), F.asc("token")]
    sorted_ = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = sorted_.select("token", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed = stage_table(placed, "vocabulary")
    drop_table(counts)
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))  # a row for each range
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("token", "n", (F.col("before") + F.col("at") + 2).alias("token_id"))


def join_tokens(rows: DataFrame, table: DataFrame, value: str, head: int = 20_000) -> DataFrame:
    """``rows`` (token, ...) with ``value`` of ``table`` (token, n, value); null where the table lacks the token.

    Tokens with at least a ``1 / head`` of all occurrences ``n``, of which there are at
    most ``head``, are broadcast: a word found everywhere sends no rows to one task.
    """
    total = table.agg(F.sum("n")).first()[0] or 0
    frequent = F.col("n") >= max(1, math.ceil(total / head))
    known = rows.join(F.broadcast(table.filter(frequent).select("token", F.col(value).alias("_head"))), "token", "left")
    apart = F.concat(F.lit("\u0001"), F.monotonically_increasing_id().cast("string"))  # no token: spreads rows that look nothing up
    keyed = known.withColumn("_at", F.when(F.col("_head").isNotNull() | F.col("token").isNull(), apart).otherwise(F.col("token")))
    rare = table.filter(~frequent).select(F.col("token").alias("_at"), F.col(value).alias("_tail"))
    return keyed.join(rare, "_at", "left").withColumn(value, F.coalesce("_head", "_tail")).drop("_at", "_head", "_tail")


def numerize(texts: DataFrame, key: list[str], column: str, vocab: DataFrame, pad_to: int | None = None) -> DataFrame:
    """``key, ids``: ids of each text's words in order, unknown ones 0; padded on the right with 1 to ``pad_to``.

    Texts without words have an empty, or all padding, list.
    """
    placed = texts.select(*key, F.posexplode_outer(words(F.col(column))).alias("place", "token"))
    found = join_tokens(placed, stage_table(vocab.select("token", "n", "token_id"), "vocabulary"), "token_id")
    entry = F.when(F.col("place").isNotNull(), F.struct("place", F.coalesce("token_id", F.lit(0)).alias("id")))
    ids = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.id)
    if pad_to is not None:
        ids = F.concat(ids, F.array_repeat(F.lit(1).cast("long"), F.greatest(F.lit(pad_to) - F.size(ids), F.lit(0))))
    return found.groupBy(*key).agg(ids.alias("ids"))


def question_frequency(pairs: DataFrame) -> DataFrame:
    """``split, id, magic_q1_freq, magic_q2_freq``: rows, over both questions of all pairs, with the same text.

    Null counts as the empty text.
    """
    counts = value_counts(question_texts(pairs))
    rows = pairs.select("split", "id", F.coalesce("question1", F.lit("")).alias("q1"), F.coalesce("question2", F.lit("")).alias("q2"))
    one = counts.select(F.col("text").alias("q1"), F.col("n").alias("magic_q1_freq"))
    two = counts.select(F.col("text").alias("q2"), F.col("n").alias("magic_q2_freq"))
    return rows.join(one, "q1").join(two, "q2").select("split", "id", "magic_q1_freq", "magic_q2_freq")


def adjacency(pairs: DataFrame) -> DataFrame:
    """``(node, neighbour)``: distinct edges of the undirected graph of texts; null is the empty text."""
    q1, q2 = F.coalesce("question1", F.lit("")), F.coalesce("question2", F.lit(""))
    return pairs.select(q1.alias("node"), q2.alias("neighbour")).unionByName(pairs.select(q2.alias("node"), q1.alias("neighbour"))).distinct()


def neighbour_counts(pairs: DataFrame) -> DataFrame:
    """``(node, neighbours)``: distinct neighbours of each text."""
    return adjacency(pairs).groupBy("node").agg(F.count("*").alias("neighbours"))


def shared_neighbours(pairs: DataFrame) -> DataFrame:
    """``split, id, magic_intersect``: texts that are neighbours of both questions.

    A pair is looked up from its question with fewer neighbours: these are joined
    against the edges of the other question, so a question found everywhere is never
    expanded.  Texts are replaced by 128-bit hashes before the joins.
    """
    hashed = pairs.select("split", "id", *(F.md5(F.coalesce(q, F.lit(""))).alias(k) for q, k in (("question1", "a"), ("question2", "b"))))
    edges = hashed.select(F.col("a").alias("node"), F.col("b").alias("neighbour"))
    edges = edges.unionByName(edges.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))).distinct()
    degree = edges.groupBy("node").agg(F.count("*").alias("n"))
    distinct = hashed.select("a", "b").distinct()
    sized = distinct.join(degree.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(degree.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
    small = F.col("na") <= F.col("nb")
    asked = sized.select("a", "b", F.when(small, F.col("a")).otherwise(F.col("b")).alias("node"), F.when(small, F.col("b")).otherwise(F.col("a")).alias("other"))
    reached = asked.join(edges, "node").select("a", "b", "other", "neighbour")
    both = reached.join(edges.select(F.col("node").alias("other"), "neighbour"), ["other", "neighbour"], "left_semi")
    counts = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    return hashed.join(counts, ["a", "b"], "left").select("split", "id", F.coalesce("n", F.lit(0)).alias("magic_intersect"))


def token_weights(texts: DataFrame, column: str = "text", eps: int = 10_000, least: int = 2) -> DataFrame:
    """``(token, n, weight)``: 1 / (occurrences + eps), 0 below ``least`` occurrences; null texts count as ``nan``."""
    counts = token_counts(texts.select(F.coalesce(F.col(column), F.lit("nan")).alias("text")))
    return counts.select("token", "n", F.when(F.col("n") < least, 0.0).otherwise(1 / (F.col("n") + eps)).alias("weight"))


def word_shares(pairs: DataFrame, weights: DataFrame, compat: bool = True) -> DataFrame:
    """The shares of words of each pair.

    ``split, id`` and word_match, word_match_2root, tfidf_word_match, shared_count,
    stops1_ratio, stops2_ratio, shared_2gram, cosine, words_hamming, diff_stops_r.  All
    are 0 where a question has no word but stop words, and where a formula divides by
    0.  Null questions are the word ``nan``.  ``compat`` divides word_match by twice the
    first question's weight, as the feature is defined; else by both questions'.

    Weights are joined to distinct words of a pair and summed back, so neither the
    vocabulary nor a pair's words ever leave the executors.
    """
    stops = F.array(*map(F.lit, STOP_WORDS))
    text = lambda q: words(F.lower(F.coalesce(F.col(q), F.lit("nan"))))
    rows = pairs.select("split", "id", text("question1").alias("l1"), text("question2").alias("l2"))
    for k in ("1", "2"):
        rows = rows.withColumn(f"s{k}", F.array_distinct(f"l{k}"))
        rows = rows.withColumn(f"w{k}", F.array_except(f"s{k}", stops)).withColumn(f"st{k}", F.array_intersect(f"s{k}", stops))
    rows = rows.withColumn("shared", F.array_intersect("w1", "w2"))
    tokens = rows.select("split", "id", F.explode(F.array_union("w1", "w2")).alias("token"), "w1", "w2")
    marked = tokens.select("split", "id", "token", F.array_contains("w1", F.col("token")).alias("in1"), F.array_contains("w2", F.col("token")).alias("in2"))
    w = F.col("weight")
    sums = (
        join_tokens(marked, stage_table(weights, "weights"), "weight")
        .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        .groupBy("split", "id")
        .agg(
            F.sum(F.when(F.col("in1") & F.col("in2"), w).otherwise(0.0)).alias("both"), F.sum(F.when(F.col("in1"), w).otherwise(0.0)).alias("one"),
            F.sum(F.when(F.col("in2"), w).otherwise(0.0)).alias("two"), F.sum(F.when(F.col("in1") & F.col("in2"), w * w).otherwise(0.0)).alias("both2"),
            F.sum(F.when(F.col("in1"), w * w).otherwise(0.0)).alias("one2"), F.sum(F.when(F.col("in2"), w * w).otherwise(0.0)).alias("two2"),
        )
    )
    p1, p2 = word_pairs(F.col("l1")), word_pairs(F.col("l2"))
    local = rows.select(
        "split", "id", (F.size("w1") * F.size("w2") > 0).alias("usable"), F.size("shared").alias("n_shared"),
        F.size("w1").alias("n1"), F.size("w2").alias("n2"), F.size("st1").alias("t1"), F.size("st2").alias("t2"),
        divide(F.size(F.array_intersect(p1, p2)), F.size(p1) + F.size(p2)).alias("grams"), equal_places(F.col("l1"), F.col("l2")).alias("places"),
    )
    joined = local.join(sums, ["split", "id"], "left")
    match = divide(F.col("both"), F.col("one") * 2 if compat else F.col("one") + F.col("two"))
    r1, r2 = divide(F.col("t1"), F.col("n1")), divide(F.col("t2"), F.col("n2"))
    columns = {
        "word_match": match, "word_match_2root": F.sqrt(match), "tfidf_word_match": divide(F.col("n_shared"), F.col("n1") + F.col("n2") - F.col("n_shared")),
        "shared_count": F.col("n_shared").cast("double"), "stops1_ratio": r1, "stops2_ratio": r2, "shared_2gram": F.col("grams"),
        "cosine": divide(F.col("both2"), F.sqrt("one2") * F.sqrt("two2")), "words_hamming": F.col("places"), "diff_stops_r": r1 - r2,
    }
    return joined.select("split", "id", *(F.round(F.when(F.col("usable"), c).otherwise(0.0), 6).alias(n) for n, c in columns.items()))


def fold_losses(rows: DataFrame, fold: str, loss: Column) -> DataFrame:
    """``(mean, std)``: mean and population deviation, over folds, of the mean loss of a fold."""
    per = rows.groupBy(fold).agg(F.avg(loss).alias("loss"))
    return per.agg(F.avg("loss").alias("mean"), F.stddev_pop("loss").alias("std"))


def threshold_sweep(rows: DataFrame, value: str, label: str, prediction: str, steps: int) -> DataFrame:
    """``(i, rows, positives, mean_prediction)`` of rows with ``value`` above i, for i from 0 to ``steps`` - 1.

    A histogram of at most ``steps`` + 1 rows is summed from above; rows are not joined
    to thresholds.
    """
    spark = rows.sparkSession
    cell = F.least(F.ceil(F.col(value)).cast("long"), F.lit(steps))
    cells = rows.filter(F.col(value) > 0).groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.sum(label).alias("p"), F.sum(prediction).alias("s"), F.count(prediction).alias("k"))
    every = spark.range(steps).select(F.col("id").alias("i"), (F.col("id") + 1).alias("c")).join(F.broadcast(cells), "c", "left")
    above = Window.orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    return every.select("i", total("n").alias("rows"), total("p").alias("positives"), F.round(divide(F.sum("s").over(above), F.sum("k").over(above)), 6).alias("mean_prediction"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``(a, b, r)``: Pearson correlation of each pair of columns, 0 where undefined; one pass over the rows."""
    pairs = [(a, b) for a in columns for b in columns]
    one = rows.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    entries = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.coalesce(F.nanvl(F.col(f"{i}"), F.lit(0.0)), F.lit(0.0)), 6).alias("r")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(entries).alias("e")).select("e.a", "e.b", "e.r")


def weighted_votes(rows: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """``(key, vote)``: each key's value of the most weight, of ties the smallest; null values do not vote."""
    held = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.sum(weight).alias("_weight"))
    return held.groupBy(key).agg(F.min_by(value, F.struct((-F.col("_weight")).alias("w"), value)).alias("vote"))


def summary(rows: DataFrame, column: str) -> DataFrame:
    """``count, mean, std, min, q25, q50, q75, max`` of a column's values that are neither null nor NaN.

    Quartiles are exact, interpolated between neighbours; a partial aggregate holds the
    distinct values it has seen.
    """
    v = F.when(~F.isnan(F.col(column).cast("double")), F.col(column).cast("double"))
    return rows.agg(F.count(v).alias("count"), F.round(F.avg(v), 6).alias("mean"), F.round(F.stddev_samp(v), 6).alias("std"), F.min(v).alias("min"), *(F.round(F.percentile(v, q), 6).alias(n) for n, q in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))), F.max(v).alias("max"))
