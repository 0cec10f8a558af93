"""Similarities of pairs of sets and sequences, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def divide(x: Column, y: Column, default: float = 0.0) -> Column:
    """x / y, and ``default`` where y is 0 or either is null."""
    return F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(float(default)))


def set_sizes(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Distinct items of a, of b, and of both."""
    return F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.size(F.array_intersect(a, b))


def jaccard_ratio(a: Column, b: Column) -> Column:
    """Shared distinct items among all; 0 for two empty arrays."""
    m, n, both = set_sizes(a, b)
    return divide(both, m + n - both)


def dice_ratio(a: Column, b: Column) -> Column:
    """Twice the shared distinct items, by the items of each; 0 for two empty arrays."""
    m, n, both = set_sizes(a, b)
    return divide(both * 2, m + n)


def equal_places(a: Column, b: Column) -> Column:
    """Places with the same token in both, by the longer length; 0 for two empty arrays."""
    k = F.least(F.size(a), F.size(b))
    same = F.filter(F.arrays_zip(F.slice(a, F.lit(1), k).alias("x"), F.slice(b, F.lit(1), k).alias("y")), lambda z: z.x == z.y)
    return divide(F.size(same), F.greatest(F.size(a), F.size(b)))
