"""Golden rows and properties of the column functions."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillpair.functions import edit, grams, numeric, similarity, stem, tagger, text, vectors


def one(spark, **columns):
    """A row of literals, as columns."""
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def value(frame, expression):
    return frame.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given_text", "wanted"),
    [("I'm OK", "i m ok"), ("we don't", "we don t"), ("can't stop", "ca not stop"), ("10k people", "10 000 people"), ("a\\b", "a\\b"), ("a  \t b c", "a b c"), ("You cannot.", "you can not"), ("gonna gonna wanna cannots", "gon na gon na wan na cannots"), ("a\u3000b\u2003c\x1fd", "a b c d")],
)
def test_tokenize_view(spark, given_text, wanted):
    assert value(one(spark, t=given_text), text.view("tokenize")(F.col("t"))) == wanted


def test_contractions_and_numbers(spark):
    assert value(one(spark, t="don't go"), text.replace_special(F.col("t"))) == "do not go"
    assert value(one(spark, t="5% off"), text.replace_special(F.col("t"))) == "5 percent off"
    assert value(one(spark, t="你好？《a》"), text.ascii_punctuation(F.col("t"))) == "你好? a "


def test_nulls_and_empty_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), ("  ",)], "t string")
    got = [r.x for r in rows.select(text.view("stopword")(F.col("t")).alias("x")).collect()]
    assert got == ["nan", "", ""]
    assert [r.x for r in rows.select(text.words(F.col("t")).alias("x")).collect()] == [[], [], []]


def test_stop_words_keep_can(spark):
    assert value(one(spark, t="what can the dog do"), text.remove_stop_words(F.col("t"))) == "can dog"


@pytest.mark.parametrize(
    ("tokens", "two", "three"),
    [(["I", "am", "Denny"], ["I_am", "am_Denny"], ["I_am_Denny"]), (["a"], ["a"], ["a"]), (["a", "b"], ["a_b"], ["a_b"]), ([], [], [])],
)
def test_grams(spark, tokens, two, three):
    frame = spark.createDataFrame([(tokens,)], "t array<string>")
    assert value(frame, grams.bigrams(F.col("t"))) == two
    assert value(frame, grams.trigrams(F.col("t"))) == three


def test_skipped_grams(spark):
    frame = spark.createDataFrame([(["a", "b", "c"],)], "t array<string>")
    assert value(frame, grams.bigrams(F.col("t"), skip=1)) == ["a_b", "a_c", "b_c"]
    frame = spark.createDataFrame([(["a", "b", "c", "d"],)], "t array<string>")
    assert value(frame, grams.trigrams(F.col("t"), skip=1)) == ["a_b_c", "a_b_d", "a_c_d", "b_c_d"]


def test_characters_keep_blanks_and_wide_letters(spark):
    assert value(one(spark, t="a 😀\nb"), grams.characters(F.col("t"))) == ["a", " ", "😀", "\n", "b"]


def test_set_ratios(spark):
    frame = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"], [])], "a array<string>, b array<string>, e array<string>")
    assert value(frame, similarity.jaccard_ratio(F.col("a"), F.col("b"))) == 0.5
    assert value(frame, similarity.dice_ratio(F.col("a"), F.col("b"))) == pytest.approx(2 / 3)
    assert value(frame, similarity.jaccard_ratio(F.col("e"), F.col("e"))) == 0
    frame = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "a array<string>, b array<string>")
    assert value(frame, similarity.equal_places(F.col("a"), F.col("b"))) == 0.5


def test_vector_distances(spark):
    frame = spark.createDataFrame([([1.0, 2.0], [2.0, 1.0])], "a array<double>, b array<double>")
    wanted = {"cosine": 0.8, "braycurtis": 2 / 6, "canberra": 2 / 3, "cityblock": 2, "euclidean": 2**0.5, "minkowski": 2 ** (1 / 3), "jaccard": 1}
    for name, want in wanted.items():
        assert value(frame, vectors.DISTANCES[name](F.col("a"), F.col("b"))) == pytest.approx(want)
    zeros = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    assert all(value(zeros, f(F.col("a"), F.col("b"))) == 0 for f in vectors.DISTANCES.values())


def test_moments(spark):
    data = [1.0, 2.0, 5.0, 9.0]
    x = np.array(data) - np.mean(data)
    frame = spark.createDataFrame([(data, [3.0, 3.0, 3.0])], "a array<double>, same array<double>")
    assert value(frame, vectors.skewness(F.col("a"))) == pytest.approx((x**3).mean() / (x**2).mean() ** 1.5)
    assert value(frame, vectors.kurtosis(F.col("a"))) == pytest.approx((x**4).mean() / (x**2).mean() ** 2 - 3)
    assert value(frame, vectors.skewness(F.col("same"))) == 0
    assert value(frame, vectors.unit(F.array(F.lit(3.0), F.lit(4.0)))) == pytest.approx([0.6, 0.8])


def test_numeric(spark):
    frame = spark.createDataFrame([([0.0, 1.0], [1.0, float("nan"), 2.0, 2.0, 1.0])], "a array<double>, v array<double>")
    assert value(frame, numeric.softmax(F.col("a"))) == pytest.approx([1 / (1 + math.e), math.e / (1 + math.e)])
    assert value(frame, numeric.majority(F.col("v"))) == 1.0
    assert value(frame, numeric.finite_mean(F.col("v"))) == 1.5
    assert value(frame, numeric.expected_class(F.array(F.lit(0.25), F.lit(0.75)))) == 1.75
    assert value(frame, numeric.one_hot(F.lit(1), 3)) == [0, 1, 0]
    assert value(frame, numeric.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0)))) == pytest.approx(math.log(2))
    assert value(frame, numeric.no_gaps(F.lit(float("inf")))) == 0
    assert value(frame, numeric.reweight(F.lit(0.5), 0.1835, 0.06)) == pytest.approx(0.221194, abs=1e-6)
    assert value(frame, numeric.reweight(F.lit(0.5), 0.37, 0.165)) == pytest.approx(0.251756, abs=1e-6)
    assert value(frame, (numeric.log_loss(F.lit(1), F.lit(0.8)) + numeric.log_loss(F.lit(0), F.lit(0.4))) / 2) == pytest.approx(0.366985, abs=1e-6)


def plain_common(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


short = st.text(alphabet="abc_ é", max_size=12)


@given(short, short)
@settings(max_examples=200, deadline=None)
def test_common_length(a, b):
    assert edit.common_length(a, b) == plain_common(a, b)


def plain_sequence(a, b):
    gap = lambda s, t: 0 if s == t else (len(s) + len(t) - 2 * plain_common(s, t)) / (len(s) + len(t))
    d = [[i + j if 0 in (i, j) else 0.0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        d[i + 1][j + 1] = min(d[i][j + 1] + 1, d[i + 1][j] + 1, d[i][j] + 2 * gap(a[i], b[j]))
    size = len(a) + len(b)
    return (size - d[-1][-1]) / size if size else 0.0


tokens = st.lists(st.sampled_from(["a", "ab", "abc", "bc", "xyz", "x"]), max_size=5)
pairs_of_letters = st.lists(st.sampled_from(["a_b", "a_c", "b_c", "_a_", "c_a"]), max_size=5)


@given(st.one_of(st.tuples(tokens, tokens), st.tuples(pairs_of_letters, pairs_of_letters)))
@settings(max_examples=200, deadline=None)
def test_sequence_ratio(both):
    a, b = both
    assert edit.sequence_ratio(a, b) == pytest.approx(plain_sequence(a, b))


@given(st.one_of(st.tuples(tokens, tokens), st.tuples(pairs_of_letters, pairs_of_letters)))
@settings(max_examples=200, deadline=None)
def test_set_ratio(both):
    a, b = sorted(both, key=len)
    gap = lambda s, t: 0 if s == t else (len(s) + len(t) - 2 * plain_common(s, t)) / (len(s) + len(t))
    least = min((sum(gap(a[i], b[p[i]]) for i in range(len(a))) for p in itertools.permutations(range(len(b)), len(a))), default=0)
    size = len(a) + len(b)
    want = (size - (len(b) - len(a) + 2 * least)) / size if size else 0.0
    assert edit.set_ratio(a, b) == pytest.approx(want)


def test_common_words_and_fuzzy():
    assert edit.common_words("a b c d", "b x d") == (2, "a c", "x")
    assert edit.common_words("", "b") == (0, "", "b")
    assert edit.quick_percent("Hello, World!", "hello  world") == 100
    assert edit.sorted_percent("new york mets", "mets york new") == 100
    assert edit.shared_percent("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100
    assert edit.quick_percent("", "a") == edit.shared_percent(None, "a") == 0
    assert edit.compression_ratio("abc", "abc") == 1


def test_edit_udfs_take_nulls(spark):
    frame = spark.createDataFrame([(["a"], None), (["a"], ["a"])], "a array<string>, b array<string>")
    assert [r.x for r in frame.select(edit.edit_seq_ratio(F.col("a"), F.col("b")).alias("x")).collect()] == [None, 1.0]
    frame = spark.createDataFrame([("a b", None), ("a b", "b c")], "a string, b string")
    got = [r.x for r in frame.select(edit.longest_common_words(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] is None and tuple(got[1]) == (1, "a", "c")


@pytest.mark.parametrize(
    ("word", "stem_"),
    [("consigned", "consign"), ("knackeries", "knackeri"), ("generously", "generous"), ("happy", "happi"), ("hopping", "hop"), ("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("agreed", "agre"), ("dying", "die"), ("sky", "sky"), ("national", "nation"), ("hopefulness", "hope"), ("by", "by"), ("generate", "generat"), ("hoping", "hope"), ("bed", "bed"), ("controll", "control")],
)
def test_stems(word, stem_):
    assert stem.stem_word(word) == stem_


def test_lemmas():
    assert [stem.lemma_word(w) for w in ("cats", "boxes", "cities", "glass", "children", "women", "bus")] == ["cat", "box", "city", "glass", "child", "woman", "bus"]
    assert stem.lemma_word("wolves", frozenset({"wolf", "wolve"})) == "wolf"
    assert stem.lemma_word("cats", frozenset()) == "cats"


def test_tags():
    tags = dict(tagger.tag_words("How can I read the old books in Berlin".split()))
    assert tags["How"] == "WRB" and tags["books"] == "NNS" and tags["Berlin"] == "NNP" and tags["can"] == "MD"


def test_compression_of_short_texts_clears_no_large_dictionary():
    """Sizes are those of the defaults; 300 short texts take far less than 300 default calls."""
    import lzma
    import random
    import time

    rng = random.Random(3)
    texts = ["", "a", "é" * 900, "ab" * 2_048, "ab" * 2_049, *("".join(rng.choice("ab é?") for _ in range(rng.randrange(4_200))) for _ in range(40))]
    assert [edit._compressed(t.encode()) for t in texts] == [len(lzma.compress(t.encode())) for t in texts]
    size = lambda t: len(lzma.compress(t.encode()))
    a, b = "how do I cook rice", "how can I cook brown rice"
    assert edit.compression_ratio(a, b) == 1 - (min(size(a + b), size(b + a)) - min(size(a), size(b))) / max(size(a), size(b))
    assert edit.compression_ratio("", a) == 1 - (size(a) - size("")) / size(a)
    pairs = [(f"what is the number {k}", f"which number is {k * 7} of them") for k in range(100)]
    began = time.process_time()
    for x, y in pairs:
        edit.compression_ratio(x, y)
    took = time.process_time() - began
    began = time.process_time()
    for x, y in pairs:
        [size(t) for t in (x, y, x + y, y + x)]
    assert took < (time.process_time() - began) / 2
