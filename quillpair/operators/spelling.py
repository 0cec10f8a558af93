"""Correction of words against a ranked dictionary.

A word keeps itself if the dictionary has it; else it becomes the best ranked word one
edit away, else two edits away, else it stays.  Candidates meet by deletions: two
words within k edits share a form from which at most k letters were taken, so the join
is an equi-join on short strings and only its results are measured.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.functions.text import words

_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")


def one_edit(word: str) -> set[str]:
    """All words one deletion, swap of neighbours, replacement or insertion of a letter a to z away."""
    out = set()
    for i in range(len(word) + 1):
        left, right = word[:i], word[i:]
        out.update(left + c + right for c in _LETTERS)
        if right:
            out.add(left + right[1:])
            out.update(left + c + right[1:] for c in _LETTERS)
        if len(right) > 1:
            out.add(left + right[1] + right[0] + right[2:])
    return out


def one_edits(words_: DataFrame) -> DataFrame:
    """``(word, edit)``: the same for a table of words, distinct; the empty word has only insertions."""
    w, n = F.col("word"), F.length("word")
    letters = F.array(*map(F.lit, sorted(_LETTERS)))
    cut = lambda a, size: w.substr(a, size)
    end, one = F.lit(1 << 30), F.lit(1)
    places = F.when(n > 0, F.sequence(one, n)).otherwise(F.array().cast("array<int>"))
    made = F.concat(
        F.transform(places, lambda i: F.concat(cut(one, i - 1), cut(i + 1, end))),
        F.transform(F.filter(places, lambda i: i < n), lambda i: F.concat(cut(one, i - 1), cut(i + 1, one), cut(i, one), cut(i + 2, end))),
        F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(cut(one, i - 1), c, cut(i + 1, end))))),
        F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(letters, lambda c: F.concat(cut(one, i), c, cut(i + 1, end))))),
    )
    return words_.select("word").filter("word IS NOT NULL").distinct().select("word", F.explode(F.array_distinct(made)).alias("edit"))


def edits_between(a: str, b: str, most: int = 2) -> int:
    """Edits from a to b, swaps of neighbours being one, also with letters put in between; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    last: dict[str, int] = {}
    inf = len(a) + len(b)
    d = [[inf] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            i1, j1 = last.get(y, 0), match
            cost = 0 if x == y else 1
            if not cost:
                match = j
            put = inf if cost and y not in _LETTERS else cost
            d[i + 1][j + 1] = min(d[i][j] + put, d[i + 1][j] + (1 if y in _LETTERS else inf), d[i][j + 1] + 1, d[i1][j1] + (i - i1 - 1) + 1 + (j - j1 - 1))
        last[x] = i
    return min(d[-1][-1], most + 1)


def _shortened(word: str, most: int) -> set[str]:
    forms = {word}
    edge = {word}
    for _ in range(most):
        edge = {w[:i] + w[i + 1 :] for w in edge for i in range(len(w))}
        forms |= edge
    return forms


def _with_forms(words_: DataFrame, column: str, most: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["form"] = [list(_shortened(w, most)) for w in part[column]]
            yield part.explode("form")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words_.schema)
    return words_.mapInPandas(run, f"{schema}, form string")


def corrections(tokens: DataFrame, dictionary: DataFrame, most: int = 2) -> DataFrame:
    """``(token, correction)`` of each distinct token that the dictionary lacks and that has a correction.

    ``tokens``: token; ``dictionary``: word, rank (0 the best; of repeated words the best
    rank counts).  Tokens longer by more than ``most`` letters than the dictionary's longest
    word have no correction and are not looked up.
    """
    words_ = dictionary.filter("word IS NOT NULL").groupBy("word").agg(F.min("rank").alias("rank"))
    longest = (words_.agg(F.max(F.length("word"))).first()[0] or 0) + most
    unknown = tokens.filter((F.col("token") != "") & (F.length("token") <= longest)).select("token").distinct()
    unknown = unknown.join(words_.select(F.col("word").alias("token")), "token", "left_anti")
    met = _with_forms(unknown, "token", most).join(_with_forms(words_, "word", most), "form").select("token", "word", "rank").distinct()

    @F.pandas_udf("int")
    def gap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([edits_between(x, y, most) for x, y in zip(a, b, strict=True)], dtype="int32")

    near = met.withColumn("gap", gap("token", "word")).filter(F.col("gap") <= most)
    best = near.groupBy("token").agg(F.min_by("word", F.struct("gap", "rank", "word")).alias("correction"))
    return best


def correct_texts(texts: DataFrame, key: list[str], column: str, found: DataFrame) -> DataFrame:
    """``key, column`` with each word replaced by its correction; words without one stay.  Null and empty texts stay."""
    placed = texts.select(*key, F.col(column).isNull().alias("none"), F.posexplode_outer(words(F.col(column))).alias("place", "token"))
    joined = placed.join(found, "token", "left")
    entry = F.when(F.col("place").isNotNull(), F.struct("place", F.coalesce("correction", "token").alias("w")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.w), " ")
    return joined.groupBy(*key, "none").agg(text.alias(column)).select(*key, F.when(~F.col("none"), F.col(column)).alias(column))

