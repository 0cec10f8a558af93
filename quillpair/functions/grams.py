"""Word and character n-grams as array columns.

``tokens`` of the functions is a column of arrays, not an expression: see ``GRAMS``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(c: Column) -> Column:
    """Code points of a text, blanks and line breaks too; none in null and empty texts."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("(?s)."), F.lit(0))


def bigrams(tokens: Column, join: str = "_", skip: int = 0) -> Column:
    """Pairs of tokens up to ``skip`` apart, in order; one token or none: the tokens."""
    n = F.size(tokens)
    at = F.sequence(F.lit(1), n - 1)
    if skip == 0:
        pairs = F.transform(at, lambda i: F.concat_ws(join, F.element_at(tokens, i), F.element_at(tokens, i + 1)))
    else:
        far = F.array(*(F.lit(k) for k in range(1, skip + 2)))
        pairs = F.flatten(
            F.transform(
                at,
                lambda i: F.transform(
                    F.filter(far, lambda k: i + k <= n), lambda k: F.concat_ws(join, F.element_at(tokens, i), F.element_at(tokens, i + k))
                ),
            )
        )
    return F.when(n > 1, pairs).otherwise(tokens)


def trigrams(tokens: Column, join: str = "_", skip: int = 0) -> Column:
    """Triples of tokens, each up to ``skip`` apart; two tokens or fewer: their bigrams."""
    n = F.size(tokens)
    at = F.sequence(F.lit(1), n - 2)
    if skip == 0:
        triples = F.transform(at, lambda i: F.concat_ws(join, F.element_at(tokens, i), F.element_at(tokens, i + 1), F.element_at(tokens, i + 2)))
    else:
        far = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(1, skip + 2) for b in range(1, skip + 2)))
        triples = F.flatten(
            F.transform(
                at,
                lambda i: F.transform(
                    F.filter(far, lambda k: i + k.a + k.b <= n),
                    lambda k: F.concat_ws(join, F.element_at(tokens, i), F.element_at(tokens, i + k.a), F.element_at(tokens, i + k.a + k.b)),
                ),
            )
        )
    return F.when(n > 2, triples).otherwise(bigrams(tokens, join, skip))


def word_pairs(tokens: Column) -> Column:
    """Distinct pairs of neighbouring tokens, as structs; none for fewer than two tokens."""
    n = F.size(tokens)
    zipped = F.arrays_zip(F.slice(tokens, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(tokens, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    return F.array_distinct(zipped)


#: The six kinds of grams, from columns of a text's words and of its characters.  The
#: arguments have to be columns, not expressions: the functions refer to them for each
#: item, and an expression would be evaluated as often.
GRAMS = {
    "unichars": lambda w, c: c,
    "bichars": lambda w, c: bigrams(c),
    "trichars": lambda w, c: trigrams(c),
    "uniwords": lambda w, c: w,
    "biwords": lambda w, c: bigrams(w),
    "triwords": lambda w, c: trigrams(w),
}
