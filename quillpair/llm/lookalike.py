"""One consistent form for texts that look the same.

Compatibility decomposition, removal of default-ignorable characters, space kinds
mapped to the plain space, letters of other scripts mapped to the Latin letter of the
same shape, recomposition and, on request, full case folding.  Only texts with a
character beyond ASCII do any work, and each distinct value of a batch is done once.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillpair.sources.shared import stage_table

# Letters of the same shape as a Latin letter, by script.
_CYRILLIC = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X",
    "Ѕ": "S", "І": "I", "Ј": "J", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y", "Һ": "h", "Ѵ": "V", "Ӏ": "I",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "һ": "h", "ѵ": "v", "ү": "y", "ӏ": "l",
}
_GREEK = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "Ϲ": "C", "Ϳ": "J", "ο": "o", "ν": "v", "α": "a", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
}
_OTHER = {"օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ք": "p", "Տ": "S", "Օ": "O", "Լ": "L", "ɡ": "g", "ɑ": "a", "Ꭺ": "A", "Ꭼ": "E", "Ꮋ": "H", "Ꮯ": "C", "Ꭲ": "T", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꮤ": "W", "Ꮓ": "Z", "Ᏼ": "B"}

SAME_SHAPE = str.maketrans(_CYRILLIC | _GREEK | _OTHER)
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")
_SPACE = regex.compile(r"\p{Zs}")


def unify(text: str, fold_case: bool = True, same_shape: bool = True) -> str:
    """The consistent form of one text."""
    if not text.isascii():
        if same_shape:  # before the decomposition too, which turns some of these letters into others
            text = text.translate(SAME_SHAPE)
        text = unicodedata.normalize("NFKD", _IGNORABLE.sub("", text))
        text = _SPACE.sub(" ", _IGNORABLE.sub("", text))
        if same_shape:
            text = text.translate(SAME_SHAPE)
        text = unicodedata.normalize("NFC", text)
    if fold_case:
        text = unicodedata.normalize("NFC", text.casefold())
    return text


def unified(column: F.Column | str, fold_case: bool = True, same_shape: bool = True) -> F.Column:
    """``unify`` of a column; null stays null, empty stays empty."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        codes, values = pd.factorize(texts)
        done = pd.Series([unify(v, fold_case, same_shape) for v in values] + [None], dtype=object)
        return done.take(codes)  # a null has code -1, the last place

    return run(F.col(column) if isinstance(column, str) else column)


def unify_columns(df: DataFrame, columns: list[str], fold_case: bool = True) -> DataFrame:
    """``df`` with each of ``columns`` in its consistent form; all other columns stay."""
    return df.withColumns({c: unified(c, fold_case) for c in columns})


def same_looking_pairs(questions: DataFrame, key: str, text: str) -> DataFrame:
    """``(key_a, key_b)``, a < b, of texts that differ but look the same; case counts as a look.

    ``questions`` holds a text for each key, repeats allowed.  Null keys and null or
    empty texts are left out.  The join is on the whole unified text; texts that can have
    no partner take no part in it.
    """
    base = questions.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.col("k").isNotNull() & (F.col("t") != ""))
    # two ASCII texts that look the same are equal: one of a pair has another character, and only those are brought to a form
    plain = ~F.col("t").rlike(r"[^\x00-\x7F]")
    odd = stage_table(base.filter(~plain).distinct().withColumn("look", unified("t", fold_case=False)), "looks")
    met = base.filter(plain).join(odd.select(F.col("look").alias("t")).distinct(), "t", "left_semi").distinct().withColumn("look", F.col("t"))
    a, b = odd.alias("a"), odd.unionByName(met).alias("b")
    found = a.join(b, (F.col("a.look") == F.col("b.look")) & (F.col("a.t") != F.col("b.t")) & (F.col("a.k") != F.col("b.k")))
    return found.select(F.least("a.k", "b.k").alias(f"{key}_a"), F.greatest("a.k", "b.k").alias(f"{key}_b")).distinct()
