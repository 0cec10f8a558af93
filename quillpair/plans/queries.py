"""Registry of the core queries and their SQL twins.

Keys begin with the family of the operator: io, tx, ng, ss, vd, fe, ag, fm, fr, ml, st.
All run over whole tables and whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpair.functions import edit, grams, numeric, text
from quillpair.functions import similarity as sim
from quillpair.functions import vectors as vec
from quillpair.operators import corpus, embed, features, lsa, matrix, models, ranking, spelling
from quillpair.plans import extraction
from quillpair.plans import sql as S
from quillpair.plans.shipping import shipped
from quillpair.sources import io
from quillpair.sources.pairs import all_pairs, question_texts, train_pairs
from quillpair.sources.shared import shared_dir, stage_table
from quillpair.sources.tables import read_table as table
from quillpair.sources.tables import spread
from quillpair.streaming import views as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its twin if SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = shipped(f)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs, dealt out for queries whose work is by row."""
    return spread(all_pairs(spark, sf))


def _both(rows: DataFrame, change) -> DataFrame:
    """Keys and both questions, changed."""
    return rows.select("split", "id", *(change(F.col(q)).alias(q) for q in ("question1", "question2")))


def _both_sql(change) -> str:
    return f"WITH {S.PAIRS} SELECT split, id, {change('question1')} AS question1, {change('question2')} AS question2 FROM pairs"


# sources and sinks


@query("SELECT id, qid1, qid2, question1, question2, is_duplicate FROM train")
def io_scan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "train").select("id", "qid1", "qid2", "question1", "question2", "is_duplicate")


@query("SELECT id::VARCHAR AS id, qid1::VARCHAR AS qid1, qid2::VARCHAR AS qid2, question1, question2, is_duplicate::VARCHAR AS is_duplicate FROM train")
def io_strings(spark: SparkSession, sf: str) -> DataFrame:
    return io_scan(spark, sf).select(*(F.col(f.name).cast("string").alias(f.name) for f in io.PAIR_SCHEMA))


@query("SELECT id, is_duplicate FROM train WHERE is_duplicate = 1")
def io_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Reads two columns; the filter reaches the scan."""
    return table(spark, sf, "train").filter("is_duplicate = 1").select("id", "is_duplicate")


@query("SELECT id, question1 FROM train ORDER BY id LIMIT 100")
def io_preview(spark: SparkSession, sf: str) -> DataFrame:
    return io.preview(table(spark, sf, "train").select("id", "question1"), "id")


@query("SELECT id, qid1, qid2, nullif(question1, '') AS question1, nullif(question2, '') AS question2, is_duplicate FROM train")
def io_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Written as CSV and read again: an empty text comes back as null."""
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    io.write_csv(io_scan(spark, sf), path)
    rows = io.read_csv(spark, path, io.PAIR_SCHEMA)
    return rows.withColumns({q: F.when(F.col(q) != "", F.col(q)) for q in ("question1", "question2")})


_UNIT = "SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm FROM embeddings"


@query(f"WITH u AS ({_UNIT}) SELECT vec_id, round(e[1] / norm, 6) AS first, round(e[64] / norm, 6) AS last, round(list_sum(e) / norm, 6) AS total FROM u")
def io_unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors scaled to length 1: their first and last number and their sum."""
    rows = table(spark, sf, "embeddings").select("vec_id", vec.unit(F.col("embedding")).alias("v"))
    return rows.select("vec_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", 64), 6).alias("last"), F.round(vec.total(F.col("v")), 6).alias("total"))


@query(f"WITH u AS ({_UNIT}) SELECT 'w' || vec_id AS word, vec_id AS rank, round(list_sum(e) / norm, 6) AS total FROM u")
def io_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A table of word vectors, written and read again at length 1."""
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    io.write_matrix(table(spark, sf, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("vec_id").alias("rank"), F.col("embedding").alias("vec")), path)
    return io.read_vectors(spark, path, normalised=True).select("word", "rank", F.round(vec.total(F.col("vec")), 6).alias("total"))


@query("SELECT id, fold FROM folds")
def io_folds(spark: SparkSession, sf: str) -> DataFrame:
    """Folds, written and read again."""
    path = f"{shared_dir(spark)}/folds-{uuid.uuid4().hex}"
    io.write_matrix(table(spark, sf, "folds").select("id", "fold"), path)
    return io.read_matrix(spark, path)


@query("SELECT id, true AS same FROM train WHERE is_duplicate IS NOT NULL")
def io_model(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a model that was saved and loaded again predicts each labelled row as before."""
    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.functions import vector_to_array

    rows = _model_rows(spark, sf)
    data = ranking.assembled(rows, _inputs(rows), "is_duplicate")
    model = LogisticRegression(maxIter=10).fit(data)
    path = f"{shared_dir(spark)}/model-{uuid.uuid4().hex}"
    io.save_model(model, path)
    again = io.load_model(LogisticRegressionModel, path)
    of = lambda m, name: m.transform(data).select("id", vector_to_array("probability")[1].alias(name))
    return of(model, "one").join(of(again, "two"), "id").select("id", (F.col("one") == F.col("two")).alias("same"))


@query("SELECT id, question1, is_duplicate FROM train")
def io_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Written as parquet and read again, three columns of six."""
    path = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    io.write_matrix(io_scan(spark, sf), path)
    return io.read_matrix(spark, path, ["id", "question1", "is_duplicate"])


@query("SELECT test_id, is_duplicate FROM submission WHERE is_duplicate IS NOT NULL AND NOT isnan(is_duplicate)")
def io_json(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON lines and read again."""
    rows = table(spark, sf, "submission").filter(F.col("is_duplicate").isNotNull() & ~F.isnan("is_duplicate"))
    path = f"{shared_dir(spark)}/json-{uuid.uuid4().hex}"
    io.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query()
def io_discover(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in io.discover(spark, sf)], "name string")


# text


@query(_both_sql(S.lower_text))
def tx_lower(spark: SparkSession, sf: str) -> DataFrame:
    return _both(_pairs(spark, sf), text.lower_text)


@query(_both_sql(lambda x: S.special(S.lower_text(x))))
def tx_special(spark: SparkSession, sf: str) -> DataFrame:
    return _both(_pairs(spark, sf), lambda c: text.replace_special(text.lower_text(c)))


@query(_both_sql(S.punctuation))
def tx_punctuation(spark: SparkSession, sf: str) -> DataFrame:
    return _both(_pairs(spark, sf), text.remove_punctuation)


@query(_both_sql(S.base_view))
def tx_tokenize(spark: SparkSession, sf: str) -> DataFrame:
    return _both(_pairs(spark, sf), text.view("tokenize"))


@query(_both_sql(S.stop_view))
def tx_stopword(spark: SparkSession, sf: str) -> DataFrame:
    return _both(_pairs(spark, sf), text.view("stopword"))


@query()
def tx_lemmatized(spark: SparkSession, sf: str) -> DataFrame:
    return _both(_pairs(spark, sf), text.view("lemmatized"))


@query()
def tx_stemmed(spark: SparkSession, sf: str) -> DataFrame:
    return _both(_pairs(spark, sf), text.view("lemmatized_stemmed"))


@query(f"WITH {S.PAIRS}, {S.TEXTS} SELECT text, count(*) AS rows FROM texts GROUP BY text")
def tx_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus of all questions, as texts with their rows."""
    return question_texts(all_pairs(spark, sf)).groupBy("text").agg(F.count("*").alias("rows"))


_SPELLING = f"""{S.PAIRS}, v AS (SELECT split, id, {S.base_view("question1")} AS question1, {S.base_view("question2")} AS question2 FROM pairs),
tokens AS (SELECT token, count(*) AS n FROM (SELECT unnest({S.words("question1")}) AS token FROM v UNION ALL SELECT unnest({S.words("question2")}) FROM v) GROUP BY 1),
dictionary AS (SELECT token AS word, -n AS rank FROM tokens WHERE n >= 20 AND regexp_matches(token, '^[a-z]+$')),
unknown AS (SELECT token, regexp_replace(token, '[^\\x00-\\x7F]', '?', 'g') AS plain FROM tokens WHERE token NOT IN (SELECT word FROM dictionary)),
near AS (SELECT token, word, rank, damerau_levenshtein(plain, word) AS gap FROM unknown JOIN dictionary ON abs(length(plain) - length(word)) <= 2),
found AS (SELECT token, word AS correction FROM near WHERE gap <= 2 QUALIFY row_number() OVER (PARTITION BY token ORDER BY gap, rank, word) = 1)"""


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked dictionary: words of letters in at least 20 questions, the most frequent first."""
    counts = corpus.token_counts(question_texts(_both(all_pairs(spark, sf), text.view("tokenize")))).filter(F.col("n") >= 20)
    return counts.filter(F.col("token").rlike("^[a-z]+$")).select(F.col("token").alias("word"), (-F.col("n")).alias("rank"))


@query(f"WITH {_SPELLING} SELECT token, correction FROM found")
def tx_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Corrections of all words of the corpus by the dictionary of its frequent words."""
    tokens = corpus.token_counts(question_texts(_both(all_pairs(spark, sf), text.view("tokenize"))))
    return spelling.corrections(tokens, _dictionary(spark, sf))


def _corrected_sql(q: str) -> str:
    return f"SELECT split, id, string_agg(coalesce(correction, token), ' ' ORDER BY i) AS {q} FROM (SELECT split, id, unnest(range(1, len({S.words(q)}) + 1)) AS i, unnest({S.words(q)}) AS token FROM v) LEFT JOIN found USING (token) GROUP BY 1, 2"


@query(
    f"""WITH {_SPELLING}, a AS ({_corrected_sql("question1")}), b AS ({_corrected_sql("question2")})
SELECT split, id, coalesce(a.question1, '') AS question1, coalesce(b.question2, '') AS question2 FROM pairs LEFT JOIN a USING (split, id) LEFT JOIN b USING (split, id)"""
)
def tx_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """Both questions of all pairs with their words corrected, up to two edits."""
    rows = stage_table(_both(all_pairs(spark, sf), text.view("tokenize")).withColumn("row", F.monotonically_increasing_id()), "corrected")
    found = stage_table(tx_corrections(spark, sf), "corrections")
    one = spelling.correct_texts(rows, ["row", "split", "id"], "question1", found)
    return one.join(spelling.correct_texts(rows, ["row"], "question2", found), "row").drop("row")


@query(
    f"""WITH {_SPELLING}, l AS (SELECT list_transform(range(97, 123), lambda c: chr(c::INT)) AS letters),
e AS (SELECT word, unnest(list_distinct(flatten([
  list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)),
  list_transform(range(1, length(word)), lambda i: left(word, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2)),
  flatten(list_transform(range(1, length(word) + 1), lambda i: list_transform(letters, lambda c: left(word, i - 1) || c || substr(word, i + 1)))),
  flatten(list_transform(range(0, length(word) + 1), lambda i: list_transform(letters, lambda c: left(word, i) || c || substr(word, i + 1))))]))) AS edit FROM dictionary, l)
SELECT word, edit FROM e"""
)
def tx_one_edits(spark: SparkSession, sf: str) -> DataFrame:
    """All forms one edit away from each word of the dictionary."""
    return spelling.one_edits(_dictionary(spark, sf))


# n-grams


def _of_both(spark: SparkSession, sf: str, cut, **changes) -> DataFrame:
    """``split, id`` and each change of both questions' tokens, with 1 or 2 behind its name; tokens are columns."""
    rows = _pairs(spark, sf).select("split", "id", *(cut(F.col(f"question{k}")).alias(f"w{k}") for k in "12"))
    return rows.select("split", "id", *(f(F.col(f"w{k}")).alias(f"{n}{k}") for k in "12" for n, f in changes.items()))


@query(
    f"""WITH {S.PAIRS}, w AS (SELECT split, id, {S.words("question1")} AS w1, {S.words("question2")} AS w2 FROM pairs)
SELECT split, id, """ + ", ".join(f"array_to_string({S.bigrams(f'w{k}')}, ' ') AS bigrams{k}, array_to_string({S.trigrams(f'w{k}')}, ' ') AS trigrams{k}" for k in "12") + " FROM w"
)
def ng_words(spark: SparkSession, sf: str) -> DataFrame:
    return _of_both(spark, sf, text.words, bigrams=lambda w: F.array_join(grams.bigrams(w), " "), trigrams=lambda w: F.array_join(grams.trigrams(w), " "))


@query(
    f"""WITH {S.PAIRS}, w AS (SELECT split, id, {S.characters("question1")} AS w1, {S.characters("question2")} AS w2 FROM pairs)
SELECT split, id, """ + ", ".join(f"len(w{k})::INT AS unigrams{k}, array_to_string({S.bigrams(f'w{k}')}, ' ') AS bigrams{k}, array_to_string({S.trigrams(f'w{k}')}, ' ') AS trigrams{k}" for k in "12") + " FROM w"
)
def ng_characters(spark: SparkSession, sf: str) -> DataFrame:
    return _of_both(spark, sf, grams.characters, unigrams=F.size, bigrams=lambda w: F.array_join(grams.bigrams(w), " "), trigrams=lambda w: F.array_join(grams.trigrams(w), " "))


@query(
    f"""WITH {S.PAIRS}, w AS (SELECT split, id, {S.words("question1")} AS w1, {S.words("question2")} AS w2 FROM pairs)
SELECT split, id, """ + ", ".join(f"array_to_string({S.skip_bigrams(f'w{k}')}, ' ') AS pairs{k}, array_to_string({S.skip_trigrams(f'w{k}')}, ' ') AS triples{k}" for k in "12") + " FROM w"
)
def ng_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs and triples of words next to each other or with one word between."""
    return _of_both(spark, sf, text.words, pairs=lambda w: F.array_join(grams.bigrams(w, skip=1), " "), triples=lambda w: F.array_join(grams.trigrams(w, skip=1), " "))


@query(
    f"""WITH {S.PAIRS}, w AS (SELECT split, id, {S.words("question1")} AS w1, {S.words("question2")} AS w2 FROM pairs)
SELECT split, id, """ + ", ".join(f"len(list_distinct(list_transform(range(1, len(w{k})), lambda i: [w{k}[i], w{k}[i + 1]])))::INT AS word_pairs{k}" for k in "12") + " FROM w"
)
def ng_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct pairs of neighbouring words of each question."""
    return _of_both(spark, sf, text.words, word_pairs=lambda w: F.size(grams.word_pairs(w)))


# similarities


@query(
    f"""WITH {S.PAIRS}, w AS (SELECT split, id, {S.words("question1")} AS a, {S.words("question2")} AS b FROM pairs)
SELECT split, id, round({S.dice("a", "b")}, 6) AS dice, round({S.jaccard("a", "b")}, 6) AS jaccard, round({S.places("a", "b")}, 6) AS places FROM w"""
)
def ss_sets(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    rows = _pairs(spark, sf).select("split", "id", text.words(F.col("question1")).alias("a"), text.words(F.col("question2")).alias("b"))
    return rows.select("split", "id", F.round(sim.dice_ratio(a, b), 6).alias("dice"), F.round(sim.jaccard_ratio(a, b), 6).alias("jaccard"), F.round(sim.equal_places(a, b), 6).alias("places"))


@query()
def ss_edits(spark: SparkSession, sf: str) -> DataFrame:
    """Edit ratios of characters and of words."""
    rows = _pairs(spark, sf).select("split", "id", *(f(F.coalesce(F.col(q), F.lit(""))).alias(n) for f, k in ((grams.characters, "c"), (text.words, "w")) for q, n in (("question1", k + "1"), ("question2", k + "2"))))
    out = {f"{k}_{n}": f(F.col(k + "1"), F.col(k + "2")) for k in "cw" for n, f in (("seq", edit.edit_seq_ratio), ("set", edit.edit_set_ratio))}
    return rows.select("split", "id", *(F.round(c, 6).alias(n) for n, c in out.items()))


@query()
def ss_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return features.fuzzy_features(_pairs(spark, sf), "o")


@query()
def ss_compression(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf)
    return rows.select("split", "id", F.round(edit.lzma_ratio(F.coalesce("question1", F.lit("")), F.coalesce("question2", F.lit(""))), 6).alias("ratio"))


@query()
def ss_common_words(spark: SparkSession, sf: str) -> DataFrame:
    rows = _both(_pairs(spark, sf), text.view("tokenize"))
    return rows.select("split", "id", edit.longest_common_words(F.col("question1"), F.col("question2")).alias("c")).select("split", "id", "c.length", "c.left1", "c.left2")


# vectors

_VECTOR_PAIRS = "v AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), z AS (SELECT vec_id, list_zip(a, b) AS z, a, b FROM v)"


def _zipped(expression: str) -> str:
    return f"list_sum(list_transform(z, lambda p: {expression}))"


@query(
    f"""WITH {_VECTOR_PAIRS}
SELECT vec_id, round({S.divide(_zipped("p[1] * p[2]"), f"sqrt({_zipped('p[1] * p[1]')}) * sqrt({_zipped('p[2] * p[2]')})")}, 6) AS cosine,
round({S.divide("len(list_filter(z, lambda p: p[1] <> p[2] AND (p[1] <> 0 OR p[2] <> 0)))", "len(list_filter(z, lambda p: p[1] <> 0 OR p[2] <> 0))")}, 6) AS jaccard,
round({_zipped("CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END")}, 6) AS canberra,
round({_zipped("abs(p[1] - p[2])")}, 6) AS cityblock, round(sqrt({_zipped("(p[1] - p[2]) * (p[1] - p[2])")}), 6) AS euclidean,
round(cbrt({_zipped("abs(p[1] - p[2]) ** 3")}), 6) AS minkowski, round({S.divide(_zipped("abs(p[1] - p[2])"), _zipped("abs(p[1] + p[2])"))}, 6) AS braycurtis FROM z"""
)
def vd_distances(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    both = rows.select("vec_id", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", *(F.round(f(F.col("a"), F.col("b")), 6).alias(n) for n, f in vec.DISTANCES.items()))


@query(
    """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT vec_id, avg(x) AS m FROM x GROUP BY 1),
c AS (SELECT vec_id, avg((x - m) ** 2) AS m2, avg((x - m) ** 3) AS m3, avg((x - m) ** 4) AS m4 FROM x JOIN m USING (vec_id) GROUP BY 1)
SELECT vec_id, round(m3 / (m2 * sqrt(m2)), 6) AS skew, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM c"""
)
def vd_moments(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(vec.skewness(F.col("embedding")), 6).alias("skew"), F.round(vec.kurtosis(F.col("embedding")), 6).alias("kurtosis"))


# feature extractors


@query(f"WITH {S.PAIRS}, {S.gram_features('origin', ['uniwords', 'biwords', 'triwords'])}")
def fe_text_words(spark: SparkSession, sf: str) -> DataFrame:
    return features.gram_features(_pairs(spark, sf), "origin", ["uniwords", "biwords", "triwords"], edits=False)


@query(f"WITH {S.PAIRS}, {S.gram_features('origin', ['unichars', 'bichars', 'trichars'])}")
def fe_text_characters(spark: SparkSession, sf: str) -> DataFrame:
    return features.gram_features(_pairs(spark, sf), "origin", ["unichars", "bichars", "trichars"], edits=False)


@query(f"""WITH {S.PAIRS}, v AS (SELECT split, id, {S.stop_view("question1")} AS question1, {S.stop_view("question2")} AS question2 FROM pairs), {S.gram_features("stopword", ["uniwords", "biwords", "triwords"], "v")}""")
def fe_text_stopword(spark: SparkSession, sf: str) -> DataFrame:
    return features.gram_features(features.with_view(_pairs(spark, sf), "stopword"), "stopword", ["uniwords", "biwords", "triwords"], edits=False)


@query()
def fe_text_edits(spark: SparkSession, sf: str) -> DataFrame:
    """All six kinds of grams of all pairs with both edit ratios: 36 columns."""
    return features.gram_features(features.with_view(_pairs(spark, sf), "lemmatized_stemmed"), "lemmatized_stemmed")


@query()
def fe_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    return features.fuzzy_features(features.with_view(_pairs(spark, sf), "lemmatized"), "lemmatized")


@query()
def fe_tags(spark: SparkSession, sf: str) -> DataFrame:
    return features.tag_features(features.with_view(_pairs(spark, sf), "lemmatized"), "lemmatized")


@query(
    f"""WITH {S.PAIRS}, {S.TEXTS},
c AS (SELECT t, count(*) AS n FROM (SELECT unnest({S.words("lower(coalesce(text, 'nan'))")}) AS t FROM (SELECT question1 AS text FROM train UNION ALL SELECT question2 FROM train)) GROUP BY 1),
wt AS (SELECT t, CASE WHEN n < 2 THEN 0.0 ELSE 1.0::DOUBLE / (n + 10000) END AS w FROM c),
l AS (SELECT split, id, {S.words("lower(coalesce(question1, 'nan'))")} AS l1, {S.words("lower(coalesce(question2, 'nan'))")} AS l2 FROM pairs),
x AS (SELECT *, list_filter(list_distinct(l1), lambda w: NOT list_contains({S.STOPS}, w)) AS w1, list_filter(list_distinct(l2), lambda w: NOT list_contains({S.STOPS}, w)) AS w2,
      len(list_filter(list_distinct(l1), lambda w: list_contains({S.STOPS}, w))) AS t1, len(list_filter(list_distinct(l2), lambda w: list_contains({S.STOPS}, w))) AS t2,
      list_distinct(list_transform(range(1, len(l1)), lambda i: [l1[i], l1[i + 1]])) AS p1, list_distinct(list_transform(range(1, len(l2)), lambda i: [l2[i], l2[i + 1]])) AS p2 FROM l),
o AS (SELECT split, id, coalesce(sum(w), 0) AS s, coalesce(sum(w * w), 0) AS q FROM (SELECT split, id, unnest(w1) AS t FROM x) LEFT JOIN wt USING (t) GROUP BY 1, 2),
p AS (SELECT split, id, coalesce(sum(w), 0) AS s, coalesce(sum(w * w), 0) AS q FROM (SELECT split, id, unnest(w2) AS t FROM x) LEFT JOIN wt USING (t) GROUP BY 1, 2),
b AS (SELECT split, id, coalesce(sum(w), 0) AS s, coalesce(sum(w * w), 0) AS q FROM (SELECT split, id, unnest(list_intersect(w1, w2)) AS t FROM x) LEFT JOIN wt USING (t) GROUP BY 1, 2),
j AS (SELECT x.*, len(w1) * len(w2) > 0 AS ok, len(list_intersect(w1, w2)) AS n, coalesce(o.s, 0) AS o_s, coalesce(o.q, 0) AS o_q, coalesce(p.q, 0) AS p_q, coalesce(b.s, 0) AS b_s, coalesce(b.q, 0) AS b_q
      FROM x LEFT JOIN o USING (split, id) LEFT JOIN p USING (split, id) LEFT JOIN b USING (split, id)),
r AS (SELECT *, {S.divide("b_s", "2 * o_s")} AS m, {S.divide("t1", "len(w1)")} AS r1, {S.divide("t2", "len(w2)")} AS r2 FROM j)
SELECT split, id, CASE WHEN ok THEN round(m, 6) ELSE 0.0 END AS word_match, CASE WHEN ok THEN round(sqrt(m), 6) ELSE 0.0 END AS word_match_2root,
CASE WHEN ok THEN round({S.divide("n", "len(w1) + len(w2) - n")}, 6) ELSE 0.0 END AS tfidf_word_match, CASE WHEN ok THEN n::DOUBLE ELSE 0.0 END AS shared_count,
CASE WHEN ok THEN round(r1, 6) ELSE 0.0 END AS stops1_ratio, CASE WHEN ok THEN round(r2, 6) ELSE 0.0 END AS stops2_ratio,
CASE WHEN ok THEN round({S.divide("len(list_intersect(p1, p2))", "len(p1) + len(p2)")}, 6) ELSE 0.0 END AS shared_2gram,
CASE WHEN ok THEN round({S.divide("b_q", "sqrt(o_q) * sqrt(p_q)")}, 6) ELSE 0.0 END AS cosine,
CASE WHEN ok THEN round({S.places("l1", "l2")}, 6) ELSE 0.0 END AS words_hamming, CASE WHEN ok THEN round(r1 - r2, 6) ELSE 0.0 END AS diff_stops_r FROM r"""
)
def fe_word_shares(spark: SparkSession, sf: str) -> DataFrame:
    weights = corpus.token_weights(question_texts(train_pairs(spark, sf)))
    return corpus.word_shares(_pairs(spark, sf), weights)


def _length_sql() -> str:
    t1, t2 = "coalesce(question1, 'nan')", "coalesce(question2, 'nan')"
    measures = {
        "len": lambda t: f"length({t})", "caps_count": lambda t: rf"len(regexp_extract_all({t}, '\p{{Lu}}'))", "len_char": lambda t: f"length(replace({t}, ' ', ''))", "len_word": lambda t: f"len({S.words(t)})",
    }
    out = []
    for name, f in measures.items():
        out += [f"({f(t1)})::INT AS {name}_q1", f"({f(t2)})::INT AS {name}_q2", f"({f(t1)} - {f(t2)})::INT AS {'diff_caps' if name == 'caps_count' else 'diff_' + name}"]
    m1, m2 = (S.divide(measures["len_char"](t), measures["len_word"](t)) for t in (t1, t2))
    out += [f"round({m1}, 6) AS avg_world_len1", f"round({m2}, 6) AS avg_world_len2", f"round(({m1}) - ({m2}), 6) AS diff_avg_word"]
    return f"WITH {S.PAIRS} SELECT split, id, {', '.join(out)} FROM pairs"


@query(_length_sql())
def fe_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return features.length_features(_pairs(spark, sf))


@query(
    f"""WITH {S.PAIRS} SELECT split, id, CASE WHEN question1 = question2 THEN 1 ELSE 0 END AS exactly_same,
CASE WHEN row_number() OVER (PARTITION BY question1, question2 ORDER BY split <> 'train', id) > 1 THEN 1 ELSE 0 END AS duplicated FROM pairs"""
)
def fe_equality(spark: SparkSession, sf: str) -> DataFrame:
    return features.equality_features(all_pairs(spark, sf))


@query(
    f"WITH {S.PAIRS}, l AS (SELECT split, id, lower(coalesce(question1, 'nan')) AS a, lower(coalesce(question2, 'nan')) AS b FROM pairs) SELECT split, id, "
    + ", ".join(f"contains(a, '{w}')::INT AS q1_{w}, contains(b, '{w}')::INT AS q2_{w}, contains(a, '{w}')::INT * contains(b, '{w}')::INT AS {w}_both" for w in features.QUESTION_WORDS)
    + " FROM l"
)
def fe_question_words(spark: SparkSession, sf: str) -> DataFrame:
    return features.question_word_features(_pairs(spark, sf))


@query(f"WITH {S.MAGIC} SELECT split, id, q1 AS magic_q1_freq, q2 AS magic_q2_freq FROM magic")
def fe_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.question_frequency(all_pairs(spark, sf))


@query(f"WITH {S.MAGIC} SELECT split, id, shared AS magic_intersect FROM magic")
def fe_shared_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.shared_neighbours(all_pairs(spark, sf))


@query(f"WITH {S.MAGIC} SELECT split, id, greatest(q1, q2) AS magic_max_freq, least(q1, q2) AS magic_min_freq, shared AS magic_intersect FROM magic")
def fe_leak(spark: SparkSession, sf: str) -> DataFrame:
    pairs = all_pairs(spark, sf)
    return features.leak_features(corpus.question_frequency(pairs), corpus.shared_neighbours(pairs))


def _word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vocab = corpus.vocabulary(question_texts(all_pairs(spark, sf)))
    return embed.pseudo_vectors(vocab, table(spark, sf, "embeddings"))


def _moment_sql(v: str, power: int) -> str:
    m = f"(list_sum({v}) / 64)"
    top, low = (f"(list_sum(list_transform({v}, lambda x: ({x}) ** {k})) / 64)" for k, x in ((power, f"x - {m}"), (2, f"x - {m}")))
    return S.divide(top, f"{low} * {'sqrt(' + low + ')' if power == 3 else low}")


def _zip_sql(expression: str) -> str:
    return f"list_sum(list_transform(z, lambda p: {expression}))"


_DISTANCE_SQL = {
    "cosine": S.divide(_zip_sql("p[1] * p[2]"), f"sqrt({_zip_sql('p[1] * p[1]')}) * sqrt({_zip_sql('p[2] * p[2]')})"),
    "jaccard": S.divide("len(list_filter(z, lambda p: p[1] <> p[2] AND (p[1] <> 0 OR p[2] <> 0)))", "len(list_filter(z, lambda p: p[1] <> 0 OR p[2] <> 0))"),
    "canberra": _zip_sql("CASE WHEN abs(p[1]) + abs(p[2]) = 0 THEN 0 ELSE abs(p[1] - p[2]) / (abs(p[1]) + abs(p[2])) END"),
    "cityblock": _zip_sql("abs(p[1] - p[2])"), "euclidean": f"sqrt({_zip_sql('(p[1] - p[2]) * (p[1] - p[2])')})",
    "minkowski": f"cbrt({_zip_sql('abs(p[1] - p[2]) ** 3')})", "braycurtis": S.divide(_zip_sql("abs(p[1] - p[2])"), _zip_sql("abs(p[1] + p[2])")),
}


@query(
    f"""WITH {S.PAIRS}, {S.TEXTS}, tok AS (SELECT unnest({S.words("text")}) AS token FROM texts), c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM c),
e AS (SELECT token, embedding FROM v JOIN embeddings ON vec_id = token_id % (SELECT count(*) FROM embeddings)),
d AS (SELECT DISTINCT coalesce(text, '') AS text FROM texts), t AS (SELECT text, unnest({S.words("text")}) AS token FROM d),
x AS (SELECT text, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM t JOIN e USING (token)),
n AS (SELECT text, count(*) AS n FROM t JOIN e USING (token) GROUP BY 1),
s AS (SELECT text, i, sum(x) / (any_value(n.n) + 1) AS x FROM x JOIN n USING (text) GROUP BY 1, 2),
l AS (SELECT text, list(x ORDER BY i) AS v FROM s GROUP BY 1),
z0 AS (SELECT list_transform(range(64), lambda i: 0.0::DOUBLE) AS zero),
j AS (SELECT p.split, p.id, coalesce(a.v, zero) AS a, coalesce(b.v, zero) AS b FROM pairs p CROSS JOIN z0 LEFT JOIN l a ON a.text = coalesce(p.question1, '') LEFT JOIN l b ON b.text = coalesce(p.question2, '')),
k AS (SELECT *, list_zip(a, b) AS z FROM j)
SELECT split, id, """
    + ", ".join(f"round({_moment_sql(v, p)}{'' if p == 3 else ' - CASE WHEN list_max(' + v + ') = list_min(' + v + ') THEN 0 ELSE 3 END'}, 6) AS origin_uniwords_{q}_{n}" for n, p in (("skew", 3), ("kurtosis", 4)) for q, v in (("q1", "a"), ("q2", "b")))
    + ", "
    + ", ".join(f"round({x}, 6) AS origin_uniwords_{n}_distance" for n, x in _DISTANCE_SQL.items())
    + " FROM k"
)
def fe_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return embed.vector_features(all_pairs(spark, sf), _word_vectors(spark, sf), 64, "origin")


@query(
    f"""WITH {S.PAIRS}, {S.TEXTS}, tok AS (SELECT unnest({S.words("text")}) AS token FROM texts), c AS (SELECT token, count(*) AS n FROM tok GROUP BY 1),
v AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM c),
e AS (SELECT token, embedding FROM v JOIN embeddings ON vec_id = token_id % (SELECT count(*) FROM embeddings)),
d AS (SELECT DISTINCT coalesce(text, '') AS text FROM texts), t AS (SELECT text, unnest({S.words("text")}) AS token FROM d),
x AS (SELECT text, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM t JOIN e USING (token)),
n AS (SELECT text, count(*) AS n FROM t JOIN e USING (token) GROUP BY 1)
SELECT md5(text) AS text_hash, round(sum(x * x), 6) AS square, round(sum(x), 6) AS total FROM (SELECT text, i, sum(x) / (any_value(n.n) + 1) AS x FROM x JOIN n USING (text) GROUP BY 1, 2) GROUP BY 1"""
)
def vd_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentence vectors of all texts with a word, as their square and sum."""
    texts = question_texts(all_pairs(spark, sf))
    of = embed.sentence_vectors(texts, _word_vectors(spark, sf), 64).filter(F.size(text.words(F.col("text"))) > 0)
    return of.select(F.md5("text").alias("text_hash"), F.round(vec.dot(F.col("vec"), F.col("vec")), 6).alias("square"), F.round(vec.total(F.col("vec")), 6).alias("total"))


@query()
def fe_movers(spark: SparkSession, sf: str) -> DataFrame:
    pairs = features.with_view(_pairs(spark, sf), "stopword")
    return embed.movers_features(pairs, embed.pseudo_vectors(corpus.vocabulary(question_texts(pairs)), table(spark, sf, "embeddings")), "stopword")


@query()
def fe_latent_words(spark: SparkSession, sf: str) -> DataFrame:
    return lsa.latent_cosine(train_pairs(spark, sf), "words")


@query()
def fe_latent_characters(spark: SparkSession, sf: str) -> DataFrame:
    return lsa.latent_cosine(train_pairs(spark, sf), "chars", min_rows=3, max_share=0.75)


# corpus


@query(f"WITH {S.PAIRS}, {S.TEXTS} SELECT token, count(*) AS n FROM (SELECT unnest({S.words('lower(text)')}) AS token FROM texts) GROUP BY token")
def ag_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.token_counts(question_texts(all_pairs(spark, sf)))


@query(f"WITH {S.PAIRS}, {S.TEXTS} SELECT coalesce(text, '') AS text, count(*) AS n FROM texts GROUP BY 1")
def ag_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.value_counts(question_texts(all_pairs(spark, sf)))


@query(f"WITH {S.MAGIC} SELECT x AS node, count(*) AS neighbours FROM e GROUP BY 1")
def ag_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.neighbour_counts(all_pairs(spark, sf))


_VOCAB = f"{S.PAIRS}, {S.TEXTS}, c AS (SELECT token, count(*) AS n FROM (SELECT unnest({S.words('text')}) AS token FROM texts) GROUP BY 1), v AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id FROM c)"


@query(f"WITH {_VOCAB} SELECT token, n, token_id FROM v")
def ag_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.vocabulary(question_texts(all_pairs(spark, sf)))


@query(
    f"""WITH {_VOCAB}, t AS (SELECT split, id, 1 AS side, {S.words("question1")} AS w FROM pairs UNION ALL SELECT split, id, 2, {S.words("question2")} FROM pairs), u AS (SELECT split, id, side, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS token FROM t),
j AS (SELECT split, id, side, string_agg(coalesce(token_id, 0)::VARCHAR, ',' ORDER BY i) AS ids FROM u LEFT JOIN v USING (token) GROUP BY 1, 2, 3) SELECT split, id, t.side, coalesce(ids, '') AS ids FROM t LEFT JOIN j USING (split, id, side)"""
)
def ag_numerize(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of the words of both questions, a row for each."""
    pairs = _pairs(spark, sf)
    texts = pairs.select("split", "id", F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(f"question{k}").alias("text")) for k in (1, 2)))).alias("q")).select("split", "id", "q.side", "q.text")
    ids = corpus.numerize(texts, ["split", "id", "side"], "text", corpus.vocabulary(question_texts(pairs)))
    return ids.select("split", "id", "side", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"WITH {_VOCAB} SELECT token, n, token_id FROM v")
def io_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The vocabulary, written and read again."""
    path = f"{shared_dir(spark)}/vocabulary-{uuid.uuid4().hex}"
    io.write_matrix(ag_vocabulary(spark, sf), path)
    return io.read_matrix(spark, path, ["token", "n", "token_id"])


@query()
def ag_word_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """A vector for each word of the vocabulary: known ones as given, else seeded normal numbers."""
    vocab = corpus.vocabulary(question_texts(all_pairs(spark, sf)))
    known = embed.pseudo_vectors(vocab.filter("n >= 5"), table(spark, sf, "embeddings"))
    joined = vocab.join(known.withColumnRenamed("word", "token"), "token", "left")
    return joined.select("token", "token_id", F.coalesce(F.col("vec").cast("array<double>"), F.array(*(F.randn(i) for i in range(64)))).alias("vec"))


# feature matrix

FEATURES = [
    "o_uniwords_dice_ratio", "o_uniwords_jaccard_ratio", "o_uniwords_q1_len", "o_uniwords_q2_len", "len_q1", "len_q2", "magic_q1_freq", "magic_q2_freq", "magic_intersect",
]


def _features(spark: SparkSession, sf: str, split: str = "train") -> DataFrame:
    """``id, is_duplicate`` and nine features of the training pairs, or of the evaluation pairs, which have no label."""
    pairs = all_pairs(spark, sf)
    own = pairs.filter(F.col("split") == split)
    some = spread(own)
    label = train_pairs(spark, sf).select("split", "id", "is_duplicate") if split == "train" else own.select("split", "id", F.lit(None).cast("int").alias("is_duplicate"))
    parts = [
        label, features.gram_features(some, "o", ["uniwords"], edits=False),
        features.length_features(some).select("split", "id", "len_q1", "len_q2"), corpus.question_frequency(pairs), corpus.shared_neighbours(pairs),
    ]
    return matrix.side_by_side(parts, ["split", "id"]).filter(F.col("split") == split).select("id", "is_duplicate", *FEATURES)


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled rows with symmetric features and a fold, written once."""
    rows = _features(spark, sf).filter("is_duplicate IS NOT NULL")
    dealt = matrix.stratified_folds(rows, "id", "is_duplicate", 4).select("id", "fold")
    return stage_table(matrix.symmetrise(matrix.clean(rows, ["id", "is_duplicate"]), ["id", "is_duplicate"]).join(dealt, "id"), "model-rows")


def _inputs(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("id", "is_duplicate", "fold")]


@query(f"WITH {S.FEATURES} SELECT * FROM features")
def fm_side_by_side(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf)


@query(
    f"WITH {S.FEATURES} SELECT id, "
    + ", ".join(f"coalesce({c}, 0)::DOUBLE AS {c}" for c in ("o_uniwords_dice_ratio", "o_uniwords_jaccard_ratio", "magic_intersect"))
    + ", "
    + ", ".join(f"abs({a} - {b})::DOUBLE AS {n.replace('#', 'diff')}, greatest({a}, {b})::DOUBLE AS {n.replace('#', 'max')}, least({a}, {b})::DOUBLE AS {n.replace('#', 'min')}" for n in ("o_uniwords_#_len", "len_#", "magic_#_freq") for a, b in [(n.replace("#", "q1"), n.replace("#", "q2"))])
    + " FROM features"
)
def fm_symmetrise(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.symmetrise(matrix.clean(_features(spark, sf).drop("is_duplicate"), ["id"]), ["id"])


@query("SELECT test_id, CASE WHEN is_duplicate IS NULL OR isnan(is_duplicate) OR isinf(is_duplicate) THEN 0.0 ELSE is_duplicate END AS is_duplicate FROM submission")
def fm_clean(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.clean(table(spark, sf, "submission"), ["test_id"])


@query("SELECT id, question1 FROM train UNION ALL SELECT test_id, question1 FROM test")
def fm_below_each_other(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.below_each_other([table(spark, sf, "train").select("id", "question1"), table(spark, sf, "test").select(F.col("test_id").alias("id"), "question1")])


@query(f"WITH {S.MAGIC} SELECT split, id, shared = 0 AS magic_intersect_0, shared = 1 AS magic_intersect_1, shared = 2 AS magic_intersect_2, shared >= 3 AS magic_intersect_3 FROM magic")
def fm_bucket_flags(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.bucket_flags(corpus.shared_neighbours(all_pairs(spark, sf)), "magic_intersect")


@query("SELECT DISTINCT id FROM train WHERE id NOT IN (SELECT id FROM folds WHERE id IS NOT NULL)")
def fm_uncovered(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.uncovered(table(spark, sf, "train"), table(spark, sf, "folds"), "id")


@query("SELECT id, ('0x' || substring(md5(id::VARCHAR), 1, 8))::BIGINT % 100 >= 98 AS held FROM train")
def fm_hold_out(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.hold_out(table(spark, sf, "train").select("id"), "id", 2)


@query("SELECT test_id, round(1 / (1 + exp(-is_duplicate)), 6) AS sigmoid, round(CASE WHEN is_duplicate > 0 AND is_duplicate < 1 THEN ln(is_duplicate / (1 - is_duplicate)) END, 6) AS logit FROM submission WHERE is_duplicate IS NOT NULL AND NOT isnan(is_duplicate)")
def fm_scalars(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("is_duplicate")
    rows = table(spark, sf, "submission").filter(p.isNotNull() & ~F.isnan(p))
    return rows.select("test_id", F.round(numeric.sigmoid(p), 6).alias("sigmoid"), F.round(F.when((p > 0) & (p < 1), numeric.logit(p)), 6).alias("logit"))


@query(
    """WITH v AS (SELECT id, list(is_duplicate::DOUBLE ORDER BY is_duplicate) AS v FROM pair_labels WHERE is_duplicate IS NOT NULL GROUP BY id)
SELECT id, round(list_avg(v), 6) AS mean, CASE WHEN 2 * list_sum(v) > len(v) THEN 1.0 ELSE 0.0 END AS majority, round(list_avg(v), 6) AS share FROM v"""
)
def fm_votes(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and majority of all verdicts on a pair; of ties the smaller one."""
    rows = table(spark, sf, "pair_labels").groupBy("id").agg(F.collect_list(F.col("is_duplicate").cast("double")).alias("v"))
    rows = rows.filter(F.size("v") > 0)
    return rows.select("id", F.round(numeric.finite_mean(F.col("v")), 6).alias("mean"), numeric.majority(F.col("v")).alias("majority"), F.round(numeric.expected_class(F.array(1 - numeric.finite_mean(F.col("v")), numeric.finite_mean(F.col("v")))) - 1, 6).alias("share"))


@query(
    """WITH s AS (SELECT id, is_duplicate::DOUBLE AS v, sum(coalesce(annotator, 0) + 1.0) AS w FROM pair_labels WHERE is_duplicate IS NOT NULL GROUP BY ALL)
SELECT id, v AS vote FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, v) = 1"""
)
def fm_weighted_votes(spark: SparkSession, sf: str) -> DataFrame:
    """The verdict of the most weight on each pair, annotators weighing one more than their number."""
    rows = table(spark, sf, "pair_labels").select("id", F.col("is_duplicate").cast("double").alias("is_duplicate"), "annotator")
    return corpus.weighted_votes(rows, "id", "is_duplicate", F.coalesce("annotator", F.lit(0)) + 1.0)


@query(
    """WITH p AS (SELECT test_id, is_duplicate AS p FROM submission WHERE NOT isnan(is_duplicate) AND is_duplicate >= 0 AND is_duplicate <= 1)
SELECT test_id, round(exp(p) / (exp(p) + exp(1 - p)), 6) AS softmax, round(-(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END + CASE WHEN p < 1 THEN (1 - p) * ln(1 - p) ELSE 0 END) + 0.0, 6) AS entropy FROM p"""
)
def fm_softmax_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """Softmax and entropy of a prediction and its complement."""
    rows = table(spark, sf, "submission").filter("is_duplicate >= 0 AND is_duplicate <= 1").select("test_id", F.array("is_duplicate", 1 - F.col("is_duplicate")).alias("p"))
    return rows.select("test_id", F.round(F.element_at(numeric.softmax(F.col("p")), 1), 6).alias("softmax"), F.round(numeric.entropy(F.col("p")), 6).alias("entropy"))


@query("SELECT id, (is_duplicate = 0)::INT AS label_0, (is_duplicate = 1)::INT AS label_1 FROM train")
def fm_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    hot = table(spark, sf, "train").select("id", numeric.one_hot(F.col("is_duplicate"), 2).alias("hot"))
    return hot.select("id", *(F.element_at("hot", k + 1).alias(f"label_{k}") for k in (0, 1)))


@query(
    f"""WITH {S.MAGIC}, r AS (SELECT i FROM range(20) t(i)), t AS (SELECT m.shared, t.is_duplicate AS y, least(m.q1, m.q2)::DOUBLE AS p FROM train t JOIN magic m ON m.id = t.id AND m.split = 'train')
SELECT i, count(shared) AS rows, coalesce(sum(y), 0)::BIGINT AS positives, round(coalesce(avg(p), 0), 6) AS mean_prediction FROM r LEFT JOIN t ON t.shared > i GROUP BY i"""
)
def ag_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf).withColumn("p", F.least("magic_q1_freq", "magic_q2_freq").cast("double"))
    return corpus.threshold_sweep(rows, "magic_intersect", "is_duplicate", "p", 20)


_CORR = ["o_uniwords_dice_ratio", "o_uniwords_jaccard_ratio", "len_q1", "len_q2", "magic_intersect"]


@query(f"WITH {S.FEATURES} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(coalesce(corr({a}, {b}), 0), 6) AS r FROM features" for a in _CORR for b in _CORR))
def ag_correlations(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.correlations(_features(spark, sf), _CORR)


@query("SELECT count(is_duplicate) AS count, round(avg(is_duplicate), 6) AS mean, round(stddev_samp(is_duplicate), 6) AS std, min(is_duplicate) AS min, round(quantile_cont(is_duplicate, 0.25), 6) AS q25, round(quantile_cont(is_duplicate, 0.5), 6) AS q50, round(quantile_cont(is_duplicate, 0.75), 6) AS q75, max(is_duplicate) AS max FROM submission WHERE NOT isnan(is_duplicate)")
def ag_summary(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.summary(table(spark, sf, "submission"), "is_duplicate")


@query(
    """WITH f AS (SELECT DISTINCT id, fold FROM folds), r AS (SELECT f.fold, t.is_duplicate AS y FROM f JOIN train t USING (id) WHERE t.is_duplicate IS NOT NULL),
p AS (SELECT avg(y) AS p FROM r), l AS (SELECT fold, avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS loss FROM r, p GROUP BY fold) SELECT round(avg(loss), 6) AS mean, round(stddev_pop(loss), 6) AS std FROM l"""
)
def ag_fold_losses(spark: SparkSession, sf: str) -> DataFrame:
    """Loss by fold of predicting the share of positives."""
    rows = table(spark, sf, "folds").select("id", "fold").distinct().join(table(spark, sf, "train").select("id", "is_duplicate"), "id").filter("is_duplicate IS NOT NULL")
    share = rows.agg(F.avg("is_duplicate").alias("p"))
    losses = corpus.fold_losses(rows.crossJoin(F.broadcast(share)), "fold", numeric.log_loss(F.col("is_duplicate"), F.col("p")))
    return losses.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


# ranking

_F_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, is_duplicate) AS r, count(*) AS n FROM known" for c in FEATURES)


@query(
    f"""WITH {S.FEATURES}, known AS (SELECT * FROM features WHERE is_duplicate IS NOT NULL), r AS ({_F_SQL}), scores AS (SELECT feature, coalesce(r * r / (1 - r * r) * (n - 2), 0) AS score FROM r)
SELECT feature, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 3) AS score FROM scores"""
)
def fr_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.scaled_ranks(matrix.correlation_scores(_features(spark, sf), "is_duplicate", FEATURES))


@query(
    f"""WITH {S.FEATURES}, known AS (SELECT * FROM features WHERE is_duplicate IS NOT NULL), r AS ({_F_SQL}), scores AS (SELECT feature, coalesce(r * r / (1 - r * r) * (n - 2), 0) AS score FROM r)
SELECT feature FROM scores ORDER BY score DESC, feature LIMIT 5"""
)
def fm_best(spark: SparkSession, sf: str) -> DataFrame:
    names = matrix.best_features(matrix.correlation_scores(_features(spark, sf), "is_duplicate", FEATURES), 5)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query(
    f"""WITH {S.FEATURES}, known AS (SELECT * FROM features WHERE is_duplicate IS NOT NULL), r AS ({_F_SQL}), scores AS (SELECT feature, coalesce(r * r / (1 - r * r) * (n - 2), 0) AS score FROM r),
ranked AS (SELECT feature, row_number() OVER (ORDER BY score DESC, feature)::INT AS rank FROM scores) SELECT feature, rank FROM ranked WHERE contains(feature, 'magic')"""
)
def fm_search(spark: SparkSession, sf: str) -> DataFrame:
    """The ranks of the features with ``magic`` in their name."""
    return matrix.find_features(matrix.correlation_scores(_features(spark, sf), "is_duplicate", FEATURES), "magic").select("feature", "rank")


@query()
def fr_simple(spark: SparkSession, sf: str) -> DataFrame:
    """Least squares, ridge, lasso, correlation and stability, with their mean."""
    rows = _model_rows(spark, sf)
    return ranking.mean_ranks(ranking.rank_features(rows, _inputs(rows), "is_duplicate", ["linear", "ridge", "lasso", "correlation", "stability"], stability={"rounds": 4}))


@query()
def fr_elimination(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    return ranking.rank_features(rows, _inputs(rows), "is_duplicate", ["elimination"], elimination={"keep": 6})


@query()
def fr_trees(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    return ranking.rank_features(rows, _inputs(rows), "is_duplicate", ["forest", "boosting"], boosting={"key": "id", "folds": 2, "rounds": 5})


# models


@query(
    """WITH r AS (SELECT id, is_duplicate, row_number() OVER (PARTITION BY is_duplicate ORDER BY md5(id::VARCHAR), id) - 1 AS k FROM train) SELECT id, is_duplicate, (k % 8)::INT AS fold FROM r"""
)
def ml_folds(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.stratified_folds(table(spark, sf, "train"), "id", "is_duplicate")


@query()
def ml_logistic(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    return models.out_of_fold(rows, "id", _inputs(rows), "is_duplicate", "fold", "logistic")


@query()
def ml_boosting(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    return models.out_of_fold(rows, "id", _inputs(rows), "is_duplicate", "fold", "boosting", {"maxIter": 10})


@query()
def ml_forest(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    return models.evaluate(models.out_of_fold(rows, "id", _inputs(rows), "is_duplicate", "fold", "forest", {"numTrees": 20}), "fold")


@query()
def ml_network(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    return models.evaluate(models.out_of_fold(rows, "id", _inputs(rows), "is_duplicate", "fold", "network"), "fold")


@query()
def ml_matching(spark: SparkSession, sf: str) -> DataFrame:
    """Network over the matched sentence vectors of each pair, without and with the three leak features."""
    pairs, rows = all_pairs(spark, sf), _model_rows(spark, sf)
    head = embed.matching_head(pairs.filter("split = 'train'"), _word_vectors(spark, sf), 64).drop("split")
    data = stage_table(rows.join(head, "id"), "matching")
    inputs = [c for c in head.columns if c != "id"]
    out = []
    for name, columns in (("plain", inputs), ("leak", [*inputs, "magic_max_freq", "magic_min_freq", "magic_intersect"])):
        predicted = models.out_of_fold(data, "id", columns, "is_duplicate", "fold", "network", {"maxIter": 15, "hidden": [16]})
        out.append(models.evaluate(predicted, "fold").withColumn("inputs", F.lit(name)))
    return out[0].unionByName(out[1])


@query()
def ml_bagged(spark: SparkSession, sf: str) -> DataFrame:
    """Mean over the models of all labelled rows' folds for every row of test."""
    rows = _model_rows(spark, sf)
    test = stage_table(matrix.symmetrise(matrix.clean(_features(spark, sf, "test").drop("is_duplicate"), ["id"]), ["id"]), "test-rows")
    return models.bagged(rows, test, "id", _inputs(rows), "is_duplicate", "fold", "logistic")


@query()
def ml_refit(spark: SparkSession, sf: str) -> DataFrame:
    """One model of all labelled rows, and its prediction for every row of test."""
    rows = _model_rows(spark, sf)
    test = matrix.symmetrise(matrix.clean(_features(spark, sf, "test").drop("is_duplicate"), ["id"]), ["id"])
    return models.refit(rows, test, "id", _inputs(rows), "is_duplicate", "boosting", {"maxIter": 10})


@query()
def ml_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    return models.search(rows, "id", _inputs(rows), "is_duplicate", "fold", "logistic", trials=4)


@query()
def ml_ensemble(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    one = models.out_of_fold(rows, "id", _inputs(rows), "is_duplicate", "fold", "logistic").select("id", "label", F.col("prob").alias("logistic"))
    two = models.out_of_fold(rows, "id", _inputs(rows), "is_duplicate", "fold", "forest", {"numTrees": 10}).select("id", F.col("prob").alias("forest"))
    return models.select_ensemble(one.join(two, "id"), ["logistic", "forest"], "label", 4)


_A, _B = 0.060 / 0.1835, (1 - 0.060) / (1 - 0.1835)


@query(
    f"""WITH {S.MAGIC}, sub AS (SELECT test_id, is_duplicate AS p, shared FROM submission JOIN magic ON magic.id = test_id AND split = 'test')
SELECT test_id, round(CASE WHEN shared = 0 THEN {_A} * p / ({_A} * p + {_B} * (1 - p)) ELSE p END, 6) AS is_duplicate FROM sub WHERE p IS NOT NULL AND NOT isnan(p)"""
)
def ml_reweight(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions moved to another share of positives where the questions share no neighbour; joined by key."""
    shared = corpus.shared_neighbours(all_pairs(spark, sf)).filter("split = 'test'").select(F.col("id").alias("test_id"), "magic_intersect")
    p = F.col("is_duplicate")
    rows = table(spark, sf, "submission").filter(p.isNotNull() & ~F.isnan(p)).join(shared, "test_id")
    return rows.select("test_id", F.round(F.when(F.col("magic_intersect") == 0, numeric.reweight(p, 0.1835, 0.060)).otherwise(p), 6).alias("is_duplicate"))


_C, _D = 0.165 / 0.37, (1 - 0.165) / (1 - 0.37)


@query(f"SELECT test_id, round({_C} * is_duplicate / ({_C} * is_duplicate + {_D} * (1 - is_duplicate)), 6) AS is_duplicate FROM submission WHERE is_duplicate IS NOT NULL AND NOT isnan(is_duplicate)")
def ml_reweight_all(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("is_duplicate")
    return table(spark, sf, "submission").filter(p.isNotNull() & ~F.isnan(p)).select("test_id", F.round(numeric.reweight(p, 0.37, 0.165), 6).alias("is_duplicate"))


@query(
    f"""WITH {S.FEATURES}, p AS (SELECT is_duplicate AS y, least(greatest(o_uniwords_dice_ratio, 1e-15), 1 - 1e-15) AS p FROM features WHERE is_duplicate IS NOT NULL)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS loss, round(avg(((p >= 0.5)::INT = y)::INT), 6) AS accuracy FROM p"""
)
def ml_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Loss and accuracy of taking the dice ratio for a probability."""
    rows = _features(spark, sf).filter("is_duplicate IS NOT NULL").select(F.col("is_duplicate").cast("double").alias("label"), F.col("o_uniwords_dice_ratio").alias("prob"))
    return models.evaluate(rows).select(F.round("loss", 6).alias("loss"), F.round("accuracy", 6).alias("accuracy"))


# runs of extractors


@query("WITH n AS (SELECT (SELECT count(*) FROM train) + (SELECT count(*) FROM test) AS n) SELECT view, extractor, columns, n AS rows FROM n, (VALUES ('tokenize', 'grams', 26), ('tokenize', 'fuzzy', 5), ('stopword', 'grams', 26), ('stopword', 'fuzzy', 5)) t(view, extractor, columns)")
def or_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Two views by two extractors, written as tables; their columns and rows."""
    written = extraction.extract(_pairs(spark, sf), f"{shared_dir(spark)}/features-{uuid.uuid4().hex}", "tokenize, stopword", "grams, fuzzy")
    sizes = [(r["view"], r["extractor"], len(t.columns), t.count()) for r in written.collect() for t in [io.read_matrix(spark, r["path"])]]
    return spark.createDataFrame(sizes, "view string, extractor string, columns int, rows long")


@query("WITH n AS (SELECT (SELECT count(*) FROM train) + (SELECT count(*) FROM test) AS n) SELECT n AS rows, 46 AS columns FROM n")
def or_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Two views by two tables of word vectors, written and put side by side."""
    vecs = table(spark, sf, "embeddings")
    names = stage_table(embed.pseudo_names(corpus.vocabulary(question_texts(all_pairs(spark, sf))), vecs), "word-names")
    vecs = vecs.select("vec_id", F.col("embedding").alias("vec"))
    tables = {"plain": vecs, "unit": embed.unit_vectors(vecs)}
    written = extraction.extract_vectors(all_pairs(spark, sf), f"{shared_dir(spark)}/features-{uuid.uuid4().hex}", "tokenize, stopword", names, tables)
    every = extraction.joined(written, ["split", "id"])
    return every.agg(F.count("*").alias("rows"), F.lit(len(every.columns)).alias("columns"))


# streams


@query(
    f"""WITH w AS (SELECT id, {S.words(S.base_view("question1"))} AS a, {S.words(S.base_view("question2"))} AS b FROM train)
SELECT id, round({S.dice("a", "b")}, 6) AS dice, round({S.jaccard("a", "b")}, 6) AS jaccard FROM w"""
)
def st_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """The training pairs as a stream of files, through the same expressions as a batch, into a table."""
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf, "train")
    rows = streams.similarity_stream(streams.stream_pairs(spark, f"{sf}/train.parquet*", source.schema))
    run = rows.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/out")


@query("SELECT date_trunc('day', loaded_at) AS start, coalesce(source, 'none') AS source, count(*) AS pairs FROM train WHERE loaded_at IS NOT NULL GROUP BY ALL")
def st_source_counts(spark: SparkSession, sf: str) -> DataFrame:
    return streams.source_counts(table(spark, sf, "train"))
