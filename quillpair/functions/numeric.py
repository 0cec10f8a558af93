"""Scalar and row-wise numeric helpers, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillpair.functions.similarity import divide
from quillpair.functions.vectors import total


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.ln(divide(p, 1 - p))


def softmax(a: Column) -> Column:
    """Of an array; shifted by its maximum."""
    raised = F.zip_with(a, F.array_repeat(F.array_max(a), F.size(a)), lambda x, top: F.exp(x - top))
    return F.zip_with(raised, F.array_repeat(total(raised), F.size(a)), lambda x, s: divide(x, s))


def entropy(a: Column) -> Column:
    """Natural entropy of probabilities; zeros add nothing."""
    return -total(F.transform(a, lambda p: F.when(p > 0, p * F.ln(p)).otherwise(F.lit(0.0))))


def expected_class(a: Column) -> Column:
    """Expected one-based class of an array of probabilities."""
    return total(F.transform(a, lambda p, i: p * (i + 1)))


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == label).cast("int"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def finite_mean(a: Column, default: float | None = None) -> Column:
    """Mean of an array's finite values; ``default`` if there is none."""
    some = F.filter(a, finite)
    return F.when(F.size(some) > 0, total(some) / F.size(some)).otherwise(F.lit(default).cast("double"))


def majority(a: Column, weights: Column | None = None, default: float | None = None) -> Column:
    """Most frequent finite value of an array, by weight; of ties the smallest."""
    w = weights if weights is not None else F.transform(a, lambda x: F.lit(1.0))
    pairs = F.filter(F.arrays_zip(a.alias("x"), w.alias("w")), lambda p: finite(p.x))
    values = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p.x)))
    held = F.transform(values, lambda v: F.struct(total(F.transform(F.filter(pairs, lambda p: p.x == v), lambda p: p.w)).alias("n"), (-v).alias("o")))
    return F.when(F.size(values) > 0, -F.array_max(held).o).otherwise(F.lit(default).cast("double"))


def reweight(p: Column, before: float, after: float) -> Column:
    """Probability moved from a share of positives ``before`` to ``after``."""
    a, b = after / before, (1 - after) / (1 - before)
    return a * p / (a * p + b * (1 - p))


def log_loss(label: Column, p: Column, clip: float = 1e-15) -> Column:
    """Loss of one row."""
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return -(label * F.ln(q) + (1 - label) * F.ln(1 - q))


def no_gaps(x: Column) -> Column:
    """Null, NaN, infinities and the largest doubles as 0."""
    x = x.cast("double")
    return F.when(finite(x) & (F.abs(x) < 1.797e308), x).otherwise(F.lit(0.0))
