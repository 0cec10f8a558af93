"""Operators on feature tables: joining, cleaning, symmetrising, selecting, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillpair.functions.numeric import no_gaps
from quillpair.functions.similarity import divide


def side_by_side(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """All tables' columns for each key in any of them; missing values are null.

    Keys are unique in each table and column names differ between tables.  The tables
    are stacked and gathered by key in one aggregation, so any number of them costs one
    shuffle; a chain of outer joins would shuffle for each.
    """
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return stacked.groupBy(*keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in stacked.columns if c not in keys))


def below_each_other(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables, repeats kept, columns by name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def clean(features: DataFrame, keys: list[str]) -> DataFrame:
    """Every feature as a double, with null, NaN, infinities and the largest doubles as 0."""
    return features.select(*keys, *(no_gaps(F.col(c)).alias(c) for c in features.columns if c not in keys))


def symmetrise(features: DataFrame, keys: list[str]) -> DataFrame:
    """Features of single questions replaced by their difference, maximum and minimum.

    Two columns belong together if they differ in ``q1`` and ``q2`` alone.  Columns that
    still name a question are dropped.
    """
    names = [c for c in features.columns if c not in keys]
    out: list[Column] = [F.col(c) for c in names if "q1" not in c and "q2" not in c]
    for c in names:
        other = c.replace("q1", "q2")
        if "q1" in c and "q2" not in c and other in names:
            a, b, plain = F.col(c), F.col(other), c
            out += [F.abs(a - b).alias(plain.replace("q1", "diff")), F.greatest(a, b).alias(plain.replace("q1", "max")), F.least(a, b).alias(plain.replace("q1", "min"))]
    return features.select(*keys, *out)


def best_features(importance: DataFrame, k: int) -> list[str]:
    """Names of the ``k`` features of the highest score; of equal scores the first name.  A list of column names, so small."""
    return [r["feature"] for r in importance.orderBy(F.desc("score"), "feature").limit(k).collect()]


def find_features(scores: DataFrame, part: str) -> DataFrame:
    """``(feature, score, rank)`` of the features whose name contains ``part``; rank 1 is the highest score, of equal ones the first name."""
    place = F.row_number().over(Window.orderBy(F.desc("score"), "feature"))  # a row for each column of a matrix
    return scores.select("feature", "score", place.alias("rank")).filter(F.col("feature").contains(part))


def bucket_flags(rows: DataFrame, column: str, cuts: int = 3) -> DataFrame:
    """``column`` replaced by flags for 0, 1, ... and ``cuts`` or more."""
    flags = {f"{column}_{i}": F.col(column) == i for i in range(cuts)} | {f"{column}_{cuts}": F.col(column) >= cuts}
    return rows.select(*(c for c in rows.columns if c != column), *(f.alias(n) for n, f in flags.items()))


def uncovered(rows: DataFrame, folds: DataFrame, key: str) -> DataFrame:
    """Keys of ``rows`` that no fold holds."""
    return rows.select(key).distinct().join(folds.select(key).distinct(), key, "left_anti")


def hold_out(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """``rows`` with ``held``: whether the key's hash falls into the last ``percent``; the same on every run."""
    return rows.withColumn("held", F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(100)) >= 100 - percent)


def stratified_folds(rows: DataFrame, key: str, label: str, folds: int = 8) -> DataFrame:
    """``(key, label, fold)``: rows of each label dealt to folds in the order of the key's md5.

    The order within a label is taken by hash ranges, counted first, so no task orders
    all rows of a label.
    """
    h = rows.select(key, label, F.md5(F.col(key).cast("string")).alias("h")).withColumn("range", F.substring("h", 1, 4))
    counts = h.groupBy(label, "range").agg(F.count("*").alias("n"))  # at most 65,536 rows a label
    before = counts.select(label, "range", (F.sum("n").over(Window.partitionBy(label).orderBy("range")) - F.col("n")).alias("before"))
    ranked = h.withColumn("r", F.row_number().over(Window.partitionBy(label, "range").orderBy("h", key)) - 1)
    joined = ranked.alias("x").join(before.alias("y"), (F.col(f"x.{label}").eqNullSafe(F.col(f"y.{label}"))) & (F.col("x.range") == F.col("y.range")))
    return joined.select(F.col(f"x.{key}").alias(key), F.col(f"x.{label}").alias(label), F.pmod(F.col("y.before") + F.col("x.r"), F.lit(folds)).cast("int").alias("fold"))


def scaled_ranks(scores: DataFrame, order: int = 1, by: list[str] = ()) -> DataFrame:
    """``score`` scaled to 0..1 within ``by``, largest first for ``order`` 1, to 3 decimals; 0 where all are equal."""
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each feature
    s = F.col("score") * order
    return scores.withColumn("score", F.round(divide(s - F.min(s).over(w), F.max(s).over(w) - F.min(s).over(w)), 3))


def correlation_scores(features: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """``(feature, score)``: F statistic of each feature's correlation with the label, in one pass."""
    named = [F.corr(F.col(c).cast("double"), F.col(label).cast("double")).alias(f"r{i}") for i, c in enumerate(columns)]
    one = features.filter(F.col(label).isNotNull()).agg(F.count("*").alias("n"), *named)
    r = lambda i: F.coalesce(F.nanvl(F.col(f"r{i}"), F.lit(0.0)), F.lit(0.0))
    f = lambda i: divide(r(i) * r(i), 1 - r(i) * r(i)) * (F.col("n") - 2)
    entries = F.array(*(F.struct(F.lit(c).alias("feature"), f(i).alias("score")) for i, c in enumerate(columns)))
    return one.select(F.explode(entries).alias("e")).select("e.feature", "e.score")
