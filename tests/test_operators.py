"""Corpus, feature, matrix, spelling, vector and model operators on small tables."""

import itertools
import math
import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpair.operators import corpus, embed, features, lsa, matrix, models, ranking, spelling
from quillpair.sources import io
from quillpair.sources.pairs import question_texts
from quillpair.sources.shared import drop_table, stage_table

PAIRS = "split string, id long, question1 string, question2 string"


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [("train", 1, "a", "b"), ("train", 2, "a", "c"), ("train", 3, "b", "c"), ("train", 4, "a", "b"), ("test", 9, "b", "a"), ("test", 10, None, ""), ("test", 11, "a", "a")]
    return spark.createDataFrame(rows, PAIRS)


def by_id(frame, column):
    return {r["id"]: r[column] for r in frame.collect()}


def test_shared_neighbours(pairs):
    edges = {}
    rows = [(r.id, r.question1 or "", r.question2 or "") for r in pairs.collect()]
    for _, a, b in rows:
        edges.setdefault(a, set()).add(b)
        edges.setdefault(b, set()).add(a)
    assert by_id(corpus.shared_neighbours(pairs), "magic_intersect") == {i: len(edges[a] & edges[b]) for i, a, b in rows}


def test_frequency_and_equality(pairs):
    counts = Counter(x or "" for r in pairs.collect() for x in (r.question1, r.question2))
    got = corpus.question_frequency(pairs)
    assert by_id(got, "magic_q1_freq") == {r.id: counts[r.question1 or ""] for r in pairs.collect()}
    same = features.equality_features(pairs)
    assert by_id(same, "duplicated") == {1: 0, 2: 0, 3: 0, 4: 1, 9: 0, 10: 0, 11: 0}
    assert by_id(same, "exactly_same") == {1: 0, 2: 0, 3: 0, 4: 0, 9: 0, 10: 0, 11: 1}


def test_empty_tables(spark):
    none = spark.createDataFrame([], PAIRS)
    for f in (corpus.shared_neighbours, corpus.question_frequency, features.equality_features, features.length_features, features.question_word_features):
        assert f(none).count() == 0
    assert corpus.vocabulary(question_texts(none)).count() == 0
    assert corpus.word_shares(none, corpus.token_weights(question_texts(none))).count() == 0
    assert features.gram_features(none, "x").count() == 0


def test_word_shares_of_stop_words(spark):
    rows = spark.createDataFrame([("train", 1, "the of", "cats sit"), ("train", 2, "cats sit here now", "cats run"), ("train", 3, None, "cats")], PAIRS)
    got = corpus.word_shares(rows, corpus.token_weights(question_texts(rows)))
    assert by_id(got, "shared_count") == {1: 0.0, 2: 1.0, 3: 0.0}
    assert by_id(got, "tfidf_word_match")[2] == pytest.approx(1 / 3, abs=1e-6)
    assert by_id(got, "word_match")[1] == 0


def test_vocabulary_and_numerize(spark):
    texts = spark.createDataFrame([(1, "b a a"), (2, "c b"), (3, None), (4, "")], "id long, text string")
    vocab = corpus.vocabulary(texts)
    assert {r.token: r.token_id for r in vocab.collect()} == {"a": 2, "b": 3, "c": 4}
    ids = corpus.numerize(texts.unionByName(spark.createDataFrame([(5, "z a")], "id long, text string")), ["id"], "text", vocab, pad_to=3)
    assert by_id(ids, "ids") == {1: [3, 2, 2], 2: [4, 3, 1], 3: [1, 1, 1], 4: [1, 1, 1], 5: [0, 2, 1]}


def test_symmetrise_clean_and_best(spark):
    rows = spark.createDataFrame([(1, 3.0, 5.0, float("nan"))], "id long, x_q1_len double, x_q2_len double, y double")
    got = matrix.symmetrise(matrix.clean(rows, ["id"]), ["id"]).first().asDict()
    assert got == {"id": 1, "y": 0.0, "x_diff_len": 2.0, "x_max_len": 5.0, "x_min_len": 3.0}
    scores = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "feature string, score double")
    assert matrix.best_features(scores, 2) == ["c", "a"]
    assert {r.feature: r.score for r in matrix.scaled_ranks(scores, -1).collect()} == {"b": 1.0, "a": 1.0, "c": 0.0}


def test_folds_cover_each_row_once(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"))
    folds = matrix.stratified_folds(rows, "id", "y", 4)
    assert folds.count() == 500 and folds.select("id").distinct().count() == 500
    sizes = [r["n"] for r in folds.groupBy("y", "fold").agg(F.count("*").alias("n")).filter("y = 1").collect()]
    assert max(sizes) - min(sizes) <= 1 and len(sizes) == 4
    assert matrix.uncovered(rows, folds.filter("id > 2"), "id").count() == 3


def test_threshold_sweep(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.2), (3, 0, 0.4), (None, 1, 0.1)], "v int, y int, p double")
    got = {r.i: (r["rows"], r.positives, r.mean_prediction) for r in corpus.threshold_sweep(rows, "v", "y", "p", 4).collect()}
    assert got == {0: (2, 1, 0.3), 1: (1, 0, 0.4), 2: (1, 0, 0.4), 3: (0, 0, 0.0)}


def reach(word, most):
    seen = {word}
    for _ in range(most):
        seen |= {e for w in seen for e in spelling.one_edit(w)}
    return seen


def test_edits_agree_with_generation():
    words = ["".join(p) for k in range(4) for p in itertools.product("ab", repeat=k)]
    for w in words[::3]:
        one, two = reach(w, 1), reach(w, 2)
        for x in words:
            assert spelling.edits_between(w, x) == (0 if w == x else 1 if x in one else 2 if x in two else 3)


def test_corrections(spark):
    tokens = spark.createDataFrame([("helo",), ("wrold",), ("zzzzzz",), ("the",), (None,), ("",)], "token string")
    dictionary = spark.createDataFrame([("the", 0), ("hello", 5), ("help", 3), ("world", 7), ("world", 4)], "word string, rank int")
    found = spelling.corrections(tokens, dictionary)
    assert {r.token: r.correction for r in found.collect()} == {"helo": "help", "wrold": "world"}
    texts = spark.createDataFrame([(1, "helo  wrold x"), (2, None), (3, "")], "id long, t string")
    assert by_id(spelling.correct_texts(texts, ["id"], "t", found), "t") == {1: "help world x", 2: None, 3: ""}


def test_sentence_vectors(spark):
    vecs = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [3.0, 3.0])], "word string, vec array<double>")
    texts = spark.createDataFrame([("a b",), ("z",), (None,), ("a a",)], "text string")
    got = {r.text: r.vec for r in embed.sentence_vectors(texts, vecs, 2).collect()}
    assert got["a b"] == pytest.approx([4 / 3, 4 / 3]) and got["z"] == got[""] == [0, 0] and got["a a"] == pytest.approx([2 / 3, 2 / 3])


def test_vectors_by_block_agree_and_leave_no_shuffles(spark, monkeypatch):
    """Sums of vectors made in blocks of pairs give the features of joined vectors; shuffles of what is written are gone."""
    import glob

    from quillpair.plans.extraction import extract_vectors

    monkeypatch.setattr(embed, "BLOCK", 3)
    monkeypatch.setattr(embed, "CHUNK", 2)
    rng = np.random.default_rng(4)
    names = spark.createDataFrame([(f"w{k}", k % 5) for k in range(12)] + [("lost", 99)], "word string, vec_id long")
    vecs = spark.createDataFrame([(k, [float(x) for x in rng.normal(size=4)]) for k in range(5)], "vec_id long, vec array<float>")
    text = lambda: " ".join(f"w{k}" for k in rng.integers(0, 16, rng.integers(1, 6)))
    rows = spark.createDataFrame([("train", k, text(), text()) for k in range(9)] + [("test", 1, None, "w1 \t w1"), ("test", 2, "", "zz lost"), ("test", 3, "w3 w2", "w2 w3")], PAIRS)
    want = embed.vector_features(rows, names.join(vecs, "vec_id").select("word", "vec"), 4, "x").orderBy("split", "id").collect()
    blocks, known = embed.in_blocks(rows, names)
    got = embed.block_vector_features(blocks, known, vecs, "x").orderBy("split", "id").collect()
    assert got[0].asDict().keys() == want[0].asDict().keys() and len(got) == len(want) == 12
    assert all(g[:2] == w[:2] and g[2:] == pytest.approx(w[2:], abs=2e-6) for g, w in zip(got, want, strict=True))
    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    files = lambda: {f for d in jvm.blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{d}/*/shuffle_*")}
    before = files()
    written = extract_vectors(rows, f"file://{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/vectors-by-block", "tokenize", names, {"plain": vecs, "unit": embed.unit_vectors(vecs)})
    assert not files() - before
    assert written.count() == 2


def test_transport_and_movers():
    rng = np.random.default_rng(1)
    for _ in range(60):
        k = int(rng.integers(1, 5))
        cost = rng.random((k, k))
        least = min(sum(cost[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k))) / k
        assert embed.transport(np.full(k, 1 / k), np.full(k, 1 / k), cost) == pytest.approx(least)
    known = {"a": np.array([0.0, 0.0]), "b": np.array([3.0, 4.0])}
    assert embed.movers_distance(["a"], ["b"], known) == 5
    assert embed.movers_distance(["a", "b"], ["b", "a"], known) == 0
    assert embed.movers_distance(["a"], ["z"], known) == 100


def test_movers_of_repeated_and_shared_words(monkeypatch):
    """Only what differs is transported, with unequal masses, as by all assignments of repeated words."""
    rng = np.random.default_rng(6)
    known = {w: rng.normal(size=3) for w in "abcdefg"}
    sizes = []
    plain = embed.transport
    monkeypatch.setattr(embed, "transport", lambda p, q, cost: sizes.append(cost.shape) or plain(p, q, cost))
    for m, n in [(2, 4), (3, 6), (3, 3), (2, 6), (6, 2), (1, 5), (5, 5)] * 8:
        a, b = (rng.choice(list(known), k).tolist() for k in (m, n))
        k = math.lcm(m, n)
        x, y = np.repeat(a, k // m), np.repeat(b, k // n)
        least = min(sum(float(np.linalg.norm(known[s] - known[y[t]])) for s, t in zip(x, o, strict=True)) for o in itertools.permutations(range(k))) / k
        assert embed.movers_distance(a, b, known) == pytest.approx(least)
    sizes.clear()
    assert embed.movers_distance(list("abcd"), list("abef"), known) > 0 and sizes == [(2, 2)]


def test_movers_features(spark):
    vecs = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [3.0, 5.0])], "word string, vec array<double>")
    rows = spark.createDataFrame([("train", 1, "a", "b"), ("train", 2, None, "a")], PAIRS)
    assert by_id(embed.movers_features(rows, vecs, "x"), "x_uniwords_wmd") == {1: 5.0, 2: 100.0}


def test_latent_cosine(spark):
    rows = spark.createDataFrame([("train", i, q1, q2) for i, (q1, q2) in enumerate([("red cat sits", "red cat sits"), ("blue dog", "green fish swims"), (None, "a cat"), ("dog dog", "dog")])], PAIRS)
    got = by_id(lsa.latent_cosine(rows, "words", components=20), "words_tfidf_lsa_cosine")
    assert got[0] == pytest.approx(1) and abs(got[1]) < 1e-6 and got[2] == 0
    apart = by_id(lsa.latent_cosine(rows, "chars", components=5, compat=True), "chars_tfidf_lsa_cosine")
    assert len(apart) == 4 and all(-1.000001 <= v <= 1.000001 for v in apart.values())


def test_latent_cosine_agrees_with_a_full_decomposition(spark, monkeypatch):
    rng = np.random.default_rng(5)
    heads = [f"{a}{b}" for a in "bcdf" for b in "aeiou"]
    made = [" ".join(str(w) for w in rng.choice(heads, 5)) + f" rare{k // 3}" for k in range(60)]
    rows = [("train", k, made[k], made[(k * 7 + 1) % 60]) for k in range(60)] + [("train", 900 + k, made[0], made[1]) for k in range(40)]
    grams = lambda t: [" ".join(t.split()[i : i + n]) for n in (1, 2, 3) for i in range(len(t.split()) - n + 1)]
    texts = [r[2] for r in rows] + [r[3] for r in rows]
    ids = {g: i for i, g in enumerate(sorted({g for t in texts for g in grams(t)}))}
    tf = np.zeros((len(texts), len(ids)))
    for k, t in enumerate(texts):
        for g in grams(t):
            tf[k, ids[g]] += 1
    w = np.where(tf > 0, 1 + np.log(np.maximum(tf, 1)), 0) * (np.log((1 + len(texts)) / (1 + (tf > 0).sum(0))) + 1)
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    monkeypatch.setattr(lsa, "TEXTS", 20)
    monkeypatch.setattr(lsa, "PRODUCTS", 8)
    for components in (5, 200):
        got = by_id(lsa.latent_cosine(spark.createDataFrame(rows, PAIRS), "words", components=components), "words_tfidf_lsa_cosine")
        x = w @ np.linalg.svd(w, full_matrices=False)[2][:components].T
        want = [x[k] @ x[len(rows) + k] / np.linalg.norm(x[k]) / np.linalg.norm(x[len(rows) + k]) for k in range(len(rows))]
        assert np.corrcoef([got[r[1]] for r in rows], want)[0, 1] > 0.99


def test_corrections_of_both_questions_of_test(spark, tmp_path):
    """A word of a test pair two edits from a frequent one is corrected, in either question."""
    import __spark_entry__ as entry

    train = [(k, "elephant", "elephant", 1) for k in range(20)]
    spark.createDataFrame(train, "id long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    spark.createDataFrame([(1, "elefant", "elephant"), (2, "elephant", "elefant")], "test_id long, question1 string, question2 string").write.parquet(f"{tmp_path}/test.parquet")
    found = entry.queries()["tx_corrections"](spark, str(tmp_path)).collect()
    assert [(r.token, r.correction) for r in found] == [("elefant", "elephant")]
    got = entry.queries()["tx_corrected"](spark, str(tmp_path)).collect()
    assert len(got) == 22 and all(r.question1 == r.question2 == "elephant" for r in got)


def test_bagged_predicts_every_row_of_test(spark, small_dir):
    import __spark_entry__ as entry

    want = sorted(r[0] for r in spark.read.parquet(f"{small_dir}/test.parquet").select("test_id").collect())
    got = entry.queries()["ml_bagged"](spark, small_dir).collect()
    assert sorted(r.id for r in got) == want and all(0 <= r.prob <= 1 for r in got)


def test_latent_words_take_rare_words(spark, tmp_path):
    """A pair of words rarer than many thousand others has vectors."""
    import __spark_entry__ as entry

    texts = [" ".join(f"w{k}x{i}" for i in range(8)) for k in range(1_200)]
    rows = [(k, t, t, 1) for k, t in enumerate(texts * 2)] + [(9_999, "zyx wvu", "zyx wvu", 1)]
    spark.createDataFrame(rows, "id long, question1 string, question2 string, is_duplicate int").write.parquet(f"{tmp_path}/train.parquet")
    spark.createDataFrame([], "test_id long, question1 string, question2 string").write.parquet(f"{tmp_path}/test.parquet")
    assert by_id(entry.queries()["fe_latent_words"](spark, str(tmp_path)), "words_tfidf_lsa_cosine")[9_999] == 1


def test_latent_grams_have_a_number_each():
    """One- to three-grams get one number each, of one text only, and are made in no join."""
    texts = ["abcab", "", "é a", "ab c", "z"]
    for kind, items in (("chars", list), ("words", str.split)):
        gram, row = lsa.one_to_three(*lsa._codes(texts, kind), kind)
        want = [(k, tuple(x[i : i + n])) for n in (1, 2, 3) for k, x in enumerate(map(items, texts)) for i in range(len(x) - n + 1)]
        assert row.tolist() == [k for k, _ in want]
        assert len(set(zip(gram.tolist(), (g for _, g in want), strict=True))) == len(set(gram.tolist())) == len({g for _, g in want})


def test_latent_words_leave_no_shuffles_of_grams(spark):
    """What the fit wrote to shuffles is gone before its result is read."""
    import glob

    jvm = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    size = lambda: sum(os.path.getsize(f) for d in jvm.blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{d}/*/shuffle_*.data"))
    rows = spark.createDataFrame([("train", k, " ".join(f"w{k * i % 997}" for i in range(1, 30)), f"w{k} x y") for k in range(300)], PAIRS)
    before = size()
    out = lsa.latent_cosine(rows, "words", components=5)
    assert size() - before < 100_000
    assert out.count() == 300


def test_latent_words_of_blank_texts(spark):
    rows = spark.createDataFrame([("train", 1, " ", None), ("train", 2, "?", "")], PAIRS)
    assert by_id(lsa.latent_cosine(rows, "words", components=5), "words_tfidf_lsa_cosine") == {1: 0, 2: 0}


def model_rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, int(x + 0.3 * e > 0), float(x), float(z), i % 3) for i, (x, z, e) in enumerate(rng.normal(size=(240, 3)))]
    return spark.createDataFrame(data, "id long, y int, x double, z double, fold int")


def test_out_of_fold_and_metrics(spark):
    rows = model_rows(spark)
    predicted = models.out_of_fold(rows, "id", ["x", "z"], "y", "fold", "logistic")
    assert predicted.count() == 240 and predicted.select("id").distinct().count() == 240
    result = models.evaluate(predicted, "fold").first()
    assert result["loss"] < 0.5 < 0.69 and result["accuracy"] > 0.8
    drop_table(predicted)
    new = models.refit(rows.filter("fold > 0"), rows.filter("fold = 0").drop("y"), "id", ["x", "z"], "y", "network", {"maxIter": 20})
    assert new.count() == rows.filter("fold = 0").count()


def test_ensemble(spark):
    rows = spark.createDataFrame([(1, 0.9, 0.4), (0, 0.2, 0.6), (1, 0.7, 0.5)], "y int, good double, bad double")
    assert [r.model for r in models.select_ensemble(rows, ["bad", "good"], "y", 2).collect()] == ["good", "good"]


def test_rankings_prefer_the_informative_feature(spark):
    rows = model_rows(spark)
    ranks = ranking.rank_features(rows, ["x", "z"], "y", ["linear", "ridge", "lasso", "correlation", "stability", "elimination", "forest", "boosting"], stability={"rounds": 2}, elimination={"keep": 1}, boosting={"key": "id", "folds": 2, "rounds": 2})
    assert {r.method: r.feature for r in ranks.filter("score = 1").collect()} == dict.fromkeys(ranking.METHODS, "x")
    assert ranking.mean_ranks(ranks).filter("feature = 'x'").first()["mean"] == 1


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 2, 'say "hi",\nyou', "  b ", 1), (2, 3, 4, None, "c", None)], io.PAIR_SCHEMA)
    io.write_csv(rows, str(tmp_path / "t"))
    back = io.read_csv(spark, str(tmp_path / "t"), io.PAIR_SCHEMA).collect()
    assert sorted(map(tuple, back), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert io.choose("a, b", ["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError):
        io.choose("c", ["a"])


def test_extra_columns_do_not_clash(spark):
    rows = spark.createDataFrame([("train", 1, "a b", "b", 7, 8, 9, "x"), ("train", 2, "a", "a b", 7, 8, 9, "x")], PAIRS + ", n long, text int, magic_intersect int, node string")
    assert set(by_id(corpus.shared_neighbours(rows), "magic_intersect")) == {1, 2}
    assert set(by_id(corpus.question_frequency(rows), "magic_q1_freq")) == {1, 2}
    assert features.gram_features(rows, "x").count() == features.equality_features(rows).count() == 2


def test_staged_tables_are_removed(spark):
    staged = stage_table(spark.range(3).toDF("x"), "t")
    assert staged.count() == 3
    drop_table(staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged._staged_at)
    assert not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def test_latent_block_keeps_its_numbers_when_packed():
    """Packed entries take less than half of what they take in full; products agree with full weights."""
    import pickle

    rng = np.random.default_rng(2)
    entry = np.unique(np.concatenate([rng.integers(0, 90 * 400, 3_000), np.arange(90) * 400 + 7]))
    entry = entry[(entry // 400 != 5) & (entry // 400 != 89)]  # two texts without a term
    row, column, tf = (entry // 400).astype(np.int32), (entry % 400).astype(np.int32), rng.integers(1, 300, len(entry))
    block = lsa._Block(np.arange(90), np.full(90, 2), np.arange(400), row, column, tf, rng.random(400) + 1, rng.random(400) < 0.5)
    packed = pickle.dumps(block)
    again = pickle.loads(packed)
    assert all(np.array_equal(getattr(again, k), getattr(block, k)) for k in ("row", "column", "w", "many", "here", "terms"))
    assert len(packed) < 12 * len(entry)
    full = np.zeros((90, 400))
    full[row, column] = block.w
    z = rng.normal(size=(90, 6)).astype(np.float32)
    thin = rng.normal(size=(400, 6)).astype(np.float32)
    assert np.allclose(again.by_term(z, block.here), (full.T @ z) * block.here[:, None], atol=1e-4)
    assert np.allclose(again.by_text(thin), full @ thin, atol=1e-4)
