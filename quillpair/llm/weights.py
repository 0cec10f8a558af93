"""How characteristic a term is of a record, against the whole collection.

Log-entropy weighting by two aggregations.  The first gives ``c``, the occurrences of a
term in a record; the second, over all records, gives per term the records ``d`` that
hold it, its occurrences ``g`` and ``s = sum(c * ln c)``.  From these

* entropy of the spread of a term's occurrences over records: ``ln g - s / g``,
* global weight: ``1 - entropy / ln N`` (1 for a term of one record, 0 for an even spread),
* log-entropy score: ``ln(1 + c) * global weight``,
* frequency score: ``c * ln(N / d)``.  It is ``c * ln N`` times the global weight of the
  term's records, each counted once: their entropy is ``ln d``, so the weight is
  ``1 - ln d / ln N``.

Scale: records are dealt out by key as texts, which are shorter than their postings, so
the first aggregation has no shuffle of its own; the second is combined before its
shuffle.  Postings are written once.  Postings of the most frequent
terms are scored beside a broadcast of their statistics: those in at least a
``1 / COMMON`` of all postings, hence at most ``COMMON`` terms, whatever the collection.
Of these only the best one of a record is kept.  The other postings are joined with the
statistics by term, and no such key has more than a ``1 / COMMON`` of the postings.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.sources.shared import stage_table

#: Most terms whose statistics are broadcast.
COMMON = 50_000
#: What stands between terms.
NOT_TERM = r"[^\p{L}\p{M}\p{N}]+"


def counted_terms(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """First aggregation, ``(key, term, c)``: occurrences of each term in the record's ``columns`` together.

    Null and empty texts have no terms, rows with a null key no record.
    """
    texts = F.lower(F.concat_ws("\n", *(F.col(c) for c in columns)))  # a line break keeps terms of different columns apart
    cut = df.select(F.col(key).alias("key"), texts.alias("t")).filter("key IS NOT NULL AND t <> ''").repartition("key")
    terms = cut.select("key", F.explode(F.split("t", NOT_TERM)).alias("term")).filter("term <> ''")
    return terms.groupBy("key", "term").agg(F.count("*").alias("c"))


def term_statistics(postings: DataFrame) -> DataFrame:
    """Second aggregation, per term: records ``d``, occurrences ``g`` and ``s``."""
    c = F.col("c")
    return postings.groupBy("term").agg(F.count("*").alias("d"), F.sum("c").alias("g"), F.sum(c * F.ln(c.cast("double"))).alias("s"))


def global_weight(records: int) -> F.Column:
    """One minus the normalised entropy of a term's spread, from ``g`` and ``s``."""
    spread = F.ln(F.col("g").cast("double")) - F.col("s") / F.col("g")
    return F.lit(1.0) - spread / F.lit(math.log(records) if records > 1 else 1.0)


def score(kind: str, records: int) -> F.Column:
    """``log_entropy`` or ``frequency`` score of a posting with ``c`` and the term's statistics, 6 decimals."""
    if kind == "frequency":
        return F.round(F.col("c") * F.ln(F.lit(float(records)) / F.col("d")), 6)
    if kind == "log_entropy":
        return F.round(F.log1p(F.col("c").cast("double")) * global_weight(records), 6)
    raise ValueError(f"unknown score {kind!r}")


def distinctive_terms(df: DataFrame, key: str, columns: list[str], kind: str = "log_entropy", min_records: int = 1) -> DataFrame:
    """The best scored term of each record: ``(key, term, c, d, score)``.

    Only terms in at least ``min_records`` records take part; records without one
    are left out.  Scores are rounded to 6 decimals; of equal scores the term first
    in code point order wins.  ``key`` has to be unique; rows with a null key are no
    records.  Null texts have no terms; an empty table gives no rows; other columns
    are not read.
    """
    records = df.filter(F.col(key).isNotNull()).count()
    postings = stage_table(counted_terms(df, key, columns), "postings")
    stats = stage_table(term_statistics(postings), "term-stats")
    total = stats.agg(F.coalesce(F.sum("d"), F.lit(0))).first()[0]
    least = max(min_records, math.ceil(total / COMMON), 1)
    common = F.broadcast(stats.filter(F.col("d") >= least))
    rare = stats.filter((F.col("d") < least) & (F.col("d") >= min_records))
    met = postings.join(common, "term").unionByName(postings.join(common, "term", "left_anti").join(rare, "term"))
    best = F.min(F.struct((-score(kind, records)).alias("o"), "term", "c", "d")).alias("b")
    return met.groupBy("key").agg(best).select(F.col("key").alias(key), "b.term", "b.c", "b.d", (-F.col("b.o")).alias("score"))
