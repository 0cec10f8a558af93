"""Feature extractors: a pair table in, one row of numbers for each pair out.

Names of columns are the feature's with ``_`` for ``-``, as in
``{prefix}_{gram}_dice_ratio``; :func:`published_name` gives the hyphenated form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillpair.functions import edit
from quillpair.functions.grams import GRAMS, characters
from quillpair.functions.similarity import dice_ratio, divide, jaccard_ratio
from quillpair.functions.tagger import NOUNS, VERBS, of_class, tagged
from quillpair.functions.text import view, words

KEYS = ["split", "id"]
#: Question words looked for in both questions.
QUESTION_WORDS = ["how", "what", "which", "who", "where", "when", "why"]


def published_name(column: str) -> str:
    """The hyphenated name of a feature column."""
    for word in ("q1-len", "q2-len", "dice-ratio", "jaccard-ratio", "edit-seq-ratio", "edit-set-ratio", "fuzz-qratio", "fuzz-token-set-ratio", "noun-jaccard-ratio", "noun-dice-ratio", "verb-jaccard-ratio", "verb-dice-ratio"):
        if column.endswith(word.replace("-", "_")):
            return column[: -len(word)] + word
    return column


def with_view(pairs: DataFrame, name: str) -> DataFrame:
    """The pairs with both questions in a named view."""
    change = view(name)
    return pairs.withColumns({q: change(F.col(q)) for q in ("question1", "question2")})


def gram_features(pairs: DataFrame, prefix: str, grams: list[str] = tuple(GRAMS), edits: bool = True) -> DataFrame:
    """Lengths, dice and jaccard ratios, and with ``edits`` the two edit ratios, for each kind of grams.

    Null questions count as empty.  Lengths count repeats, the first two ratios do not.
    """
    sides = (("a", "question1"), ("b", "question2"))
    kinds = [k for k, used in ((words, any("words" in g for g in grams)), (characters, any("chars" in g for g in grams))) if used]
    split = pairs.select(*KEYS, *(f(F.col(q)).alias(f"{f.__name__}_{k}") for f in kinds for k, q in sides))
    arrays = {f"{g}_{k}": GRAMS[g](F.col(f"words_{k}"), F.col(f"characters_{k}")) for g in grams for k, _ in sides}
    rows = split.select(*KEYS, *(c.alias(n) for n, c in arrays.items()))
    out: dict[str, Column] = {}
    for g in grams:
        a, b, name = F.col(f"{g}_a"), F.col(f"{g}_b"), f"{prefix}_{g}"
        out[f"{name}_q1_len"], out[f"{name}_q2_len"] = F.size(a), F.size(b)
        out[f"{name}_dice_ratio"] = F.round(dice_ratio(a, b), 6)
        out[f"{name}_jaccard_ratio"] = F.round(jaccard_ratio(a, b), 6)
        if edits:
            out[f"{name}_edit_seq_ratio"] = F.round(edit.edit_seq_ratio(a, b), 6)
            out[f"{name}_edit_set_ratio"] = F.round(edit.edit_set_ratio(a, b), 6)
    return rows.select(*KEYS, *(c.alias(n) for n, c in out.items()))


def fuzzy_features(pairs: DataFrame, prefix: str) -> DataFrame:
    """Three similarities in percent; null questions count as empty and give 0."""
    a, b = (F.coalesce(F.col(q), F.lit("")) for q in ("question1", "question2"))
    return pairs.select(
        *KEYS, edit.fuzz_qratio(a, b).alias(f"{prefix}_fuzz_qratio"), edit.fuzz_token_set_ratio(a, b).alias(f"{prefix}_fuzz_token_set_ratio"),
        edit.fuzz_token_sort_ratio(a, b).alias(f"{prefix}_fuzz_token_sort_ratio"),
    )


def tag_features(pairs: DataFrame, prefix: str) -> DataFrame:
    """Jaccard and dice ratios of the nouns and of the verbs; null questions have none."""
    rows = pairs.select(*KEYS, tagged(words(F.col("question1"))).alias("a"), tagged(words(F.col("question2"))).alias("b"))
    out = {}
    for kind, tags in (("noun", NOUNS), ("verb", VERBS)):
        a, b = of_class(F.col("a"), tags), of_class(F.col("b"), tags)
        out[f"{prefix}_uniwords_{kind}_jaccard_ratio"] = F.round(jaccard_ratio(a, b), 6)
        out[f"{prefix}_uniwords_{kind}_dice_ratio"] = F.round(dice_ratio(a, b), 6)
    return rows.select(*KEYS, *(c.alias(n) for n, c in out.items()))


def length_features(pairs: DataFrame) -> DataFrame:
    """Characters, capitals, characters without blanks, words and mean word length of both questions, and differences.

    Null questions are the text ``nan``.  The mean of no words is 0.
    """
    out: dict[str, Column] = {}
    measures = {
        "len": F.length, "caps_count": lambda t: F.regexp_count(t, F.lit(r"\p{Lu}")), "len_char": lambda t: F.length(F.replace(t, F.lit(" "), F.lit(""))),
        "len_word": lambda t: F.size(words(t)),
    }
    text = {k: F.coalesce(F.col(q), F.lit("nan")) for k, q in (("1", "question1"), ("2", "question2"))}
    for name, measure in measures.items():
        both = [measure(text[k]).cast("int") for k in "12"]
        out |= {f"{name}_q{k}": c for k, c in zip("12", both, strict=True)}
        out[{"caps_count": "diff_caps"}.get(name, f"diff_{name}")] = both[0] - both[1]
    mean = [divide(measures["len_char"](text[k]), measures["len_word"](text[k])) for k in "12"]
    out |= {"avg_world_len1": F.round(mean[0], 6), "avg_world_len2": F.round(mean[1], 6), "diff_avg_word": F.round(mean[0] - mean[1], 6)}
    return pairs.select(*KEYS, *(c.alias(n) for n, c in out.items()))


def equality_features(pairs: DataFrame) -> DataFrame:
    """``exactly_same``: equal raw questions, never for a null; ``duplicated``: the pair of texts stood before.

    Order is training before evaluation, then the identifier.  Nulls equal nulls for
    ``duplicated``.  First rows come from an aggregation, so a pair of texts that a third
    of all rows repeat is not ordered in one task.
    """
    place = F.struct((F.col("split") != "train").alias("later"), F.col("id").alias("at"), F.col("split").alias("part"))
    nulls = [F.coalesce(F.col(q), F.lit("")).alias(f"k{i}") for i, q in enumerate(("question1", "question2"))] + [F.col("question1").isNull().alias("n1"), F.col("question2").isNull().alias("n2")]
    rows = pairs.select(*KEYS, F.coalesce(F.col("question1") == F.col("question2"), F.lit(False)).cast("int").alias("exactly_same"), *nulls)
    keys = ["k0", "k1", "n1", "n2"]
    first = rows.groupBy(*keys).agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = rows.join(first.select(*keys, "first"), keys, "left")
    same = (F.col("first.part") == F.col("split")) & (F.col("first.at") == F.col("id"))
    return joined.select(*KEYS, "exactly_same", F.when(F.col("first").isNotNull() & ~same, 1).otherwise(0).alias("duplicated"))


def question_word_features(pairs: DataFrame, wanted: list[str] = tuple(QUESTION_WORDS)) -> DataFrame:
    """Whether each question holds a word, as a part of its lower-case text, and whether both do; null is ``nan``."""
    low = [F.lower(F.coalesce(F.col(q), F.lit("nan"))) for q in ("question1", "question2")]
    out: dict[str, Column] = {}
    for w in wanted:
        one, two = (t.contains(w).cast("int") for t in low)
        out |= {f"q1_{w}": one, f"q2_{w}": two, f"{w}_both": one * two}
    return pairs.select(*KEYS, *(c.alias(n) for n, c in out.items()))


def leak_features(frequency: DataFrame, shared: DataFrame) -> DataFrame:
    """``magic_max_freq, magic_min_freq, magic_intersect`` of each pair."""
    both = frequency.join(shared, KEYS)
    return both.select(
        *KEYS, F.greatest("magic_q1_freq", "magic_q2_freq").alias("magic_max_freq"), F.least("magic_q1_freq", "magic_q2_freq").alias("magic_min_freq"), "magic_intersect"
    )

