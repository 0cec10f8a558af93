"""Distances and moments of numeric arrays, as column functions.

Arrays of a pair have one length.  Where a formula divides by 0 the value is 0, and
so it is for null arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillpair.functions.similarity import divide


def total(a: Column) -> Column:
    """Sum of an array."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    """Cosine similarity; the name is the feature's."""
    return divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _differences(a: Column, b: Column, power: int = 1) -> Column:
    def one(x: Column, y: Column) -> Column:
        d = F.abs(x.cast("double") - y.cast("double"))
        return d if power == 1 else d * d if power == 2 else d * d * d

    return total(F.zip_with(a, b, one))


def cityblock_distance(a: Column, b: Column) -> Column:
    return F.coalesce(_differences(a, b), F.lit(0.0))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.coalesce(F.sqrt(_differences(a, b, 2)), F.lit(0.0))


def minkowski_distance(a: Column, b: Column) -> Column:
    """Of order three."""
    return F.coalesce(F.cbrt(_differences(a, b, 3)), F.lit(0.0))


def braycurtis_distance(a: Column, b: Column) -> Column:
    return divide(_differences(a, b), total(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") + y.cast("double")))))


def canberra_distance(a: Column, b: Column) -> Column:
    def one(x: Column, y: Column) -> Column:
        x, y = x.cast("double"), y.cast("double")
        return divide(F.abs(x - y), F.abs(x) + F.abs(y))

    return F.coalesce(total(F.zip_with(a, b, one)), F.lit(0.0))


def jaccard_distance(a: Column, b: Column) -> Column:
    """Places that differ among places where either is not 0."""
    z = F.arrays_zip(a.alias("x"), b.alias("y"))
    some = F.filter(z, lambda p: (p.x != 0) | (p.y != 0))
    return divide(F.size(F.filter(some, lambda p: p.x != p.y)), F.size(some))


def _moments(a: Column, finish) -> Column:
    """One pass over the array for its sums of powers; ``finish`` gets n and the central moments 2 to 4."""

    def add(s: Column, x: Column) -> Column:
        x = x.cast("double")
        return F.struct((s.n + 1).alias("n"), (s.a + x).alias("a"), (s.b + x * x).alias("b"), (s.c + x * x * x).alias("c"), (s.d + x * x * x * x).alias("d"))

    def end(s: Column) -> Column:
        m, q, r, t = (divide(k, s.n) for k in (s.a, s.b, s.c, s.d))
        m2 = q - m * m
        # what is left of equal values is the rounding of their squares
        m2 = F.when(m2 > q * 1e-14, m2).otherwise(F.lit(0.0))
        return finish(m2, r - 3 * m * q + 2 * m * m * m, t - 4 * m * r + 6 * m * m * q - 3 * m * m * m * m)

    start = F.struct(*(F.lit(0.0).alias(k) for k in "nabcd"))
    return F.coalesce(F.aggregate(a, start, add, end), F.lit(0.0))


def skewness(a: Column) -> Column:
    """Of the population; 0 for equal values."""
    return _moments(a, lambda m2, m3, m4: divide(m3, m2 * F.sqrt(m2)))


def kurtosis(a: Column) -> Column:
    """Excess kurtosis of the population; 0 for equal values."""
    return _moments(a, lambda m2, m3, m4: F.when(m2 > 0, divide(m4, m2 * m2) - 3).otherwise(F.lit(0.0)))


def unit(a: Column) -> Column:
    """The array scaled to length 1; an array of zeros stays."""
    # the norm is paired with each item first: inside the outer lambda it would be computed for each
    norm = F.array_repeat(F.sqrt(dot(a, a)), F.size(a))
    return F.zip_with(a, norm, lambda x, n: divide(x.cast("double"), n))


DISTANCES = {
    "cosine": cosine_distance, "jaccard": jaccard_distance, "canberra": canberra_distance, "cityblock": cityblock_distance,
    "euclidean": euclidean_distance, "minkowski": minkowski_distance, "braycurtis": braycurtis_distance,
}
