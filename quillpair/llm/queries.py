"""Queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpair.llm import bitmaps, components, copies, encoding, lookalike, mixing, neighbours, overlap, quality, weights
from quillpair.plans.shipping import shipped
from quillpair.sources.shared import stage_table
from quillpair.sources.tables import read_table as table
from quillpair.sources.tables import spread

_BOTH = ["question1", "question2"]


def _dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work that is dear by row: read in at least as many parts as tasks run at once."""
    return spread(table(spark, sf, name))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return weights.distinctive_terms(table(spark, sf, "train"), "id", _BOTH, "frequency", 2).select("id", "term")


def p1_log_entropy(spark: SparkSession, sf: str) -> DataFrame:
    """The most characteristic term of each record by the log-entropy score."""
    return weights.distinctive_terms(table(spark, sf, "train"), "id", _BOTH, "log_entropy", 2)


def _bitmaps(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The united index of the first questions of train and test, each built apart, and the number of records."""
    tables = [(table(spark, sf, name).filter("question1 IS NOT NULL"), key, name) for name, key in (("train", "id"), ("test", "test_id"))]
    parts = [bitmaps.build_bitmaps(rows, key, "question1", name) for rows, key, name in tables]
    return bitmaps.merge_bitmaps(*parts), sum(rows.count() for rows, _, _ in tables)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_frequencies(spark, sf).filter("mark IS NOT NULL").select("term", "mark")


def p2_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    index, records = _bitmaps(spark, sf)
    return bitmaps.mark_terms(bitmaps.term_frequencies(index), records)


def p2_rare_records(spark: SparkSession, sf: str) -> DataFrame:
    """The records of each rare term, looked up from its bitmaps."""
    index, records = _bitmaps(spark, sf)
    index = stage_table(index, "bitmaps")
    rare = bitmaps.mark_terms(bitmaps.term_frequencies(index), records).filter("mark = 'rare'")
    return bitmaps.records_of(index, rare)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlapping_records(table(spark, sf, "train"), table(spark, sf, "test"), "id", "test_id", ("question1", "question2"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    return overlap.overlap_report(p3_found(spark, sf), table(spark, sf, "test"), "test_id", ["split", "source"])


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = table(spark, sf, "train").filter("is_duplicate = 1").select("qid1", "qid2")
    return components.connected_components(pairs, "qid1", "qid2").select(F.col("component").alias("group_qid"), F.col("node").alias("qid"))


def _pair_records(spark: SparkSession, sf: str) -> DataFrame:
    train = table(spark, sf, "train").select("id", *_BOTH)
    return train.unionByName(table(spark, sf, "test").select(F.col("test_id").alias("id"), *_BOTH))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    found = copies.collapse_copies(_pair_records(spark, sf), "id", _BOTH)
    return found.filter("kept <> id").select(F.col("kept").alias("kept_id"), F.col("id").alias("copy_id"))


def p5_copies(spark: SparkSession, sf: str) -> DataFrame:
    return copies.copy_counts(_pair_records(spark, sf), "id", _BOTH)


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    train = table(spark, sf, "train")
    return train.select(F.col("qid1").alias("qid"), F.col("question1").alias("text")).unionByName(train.select(F.col("qid2").alias("qid"), F.col("question2").alias("text")))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.same_looking_pairs(_questions(spark, sf), "qid", "text")


def p6_unified(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.unify_columns(table(spark, sf, "train").select("id", *_BOTH), _BOTH)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_pairs(_questions(spark, sf), "qid", "text")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_texts(_dealt(spark, sf, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(_dealt(spark, sf, "documents"), table(spark, sf, "source_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed_shares(p9_mix(spark, sf), table(spark, sf, "source_targets"))


def _document_statistics(spark: SparkSession, sf: str) -> DataFrame:
    common = {r["word"] for r in table(spark, sf, "common_words").select("word").collect()}  # a fixed list
    return quality.document_statistics(_dealt(spark, sf, "documents"), "doc_id", "text", common)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of which at least half of the characters are no prose."""
    return _document_statistics(spark, sf).filter("characters > 0 AND prose <= 0.5").select("doc_id")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _document_statistics(spark, sf)


QUERIES = {name: shipped(f) for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}

_TERMS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}]+')"
_CANON = r"regexp_replace(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')"

_POSTINGS = f"""
WITH n AS (SELECT count(*) AS n FROM train),
words AS (SELECT id, unnest(list_concat({_TERMS.format("coalesce(question1, '')")}, {_TERMS.format("coalesce(question2, '')")})) AS term FROM train),
p AS (SELECT id, term, count(*) AS c FROM words GROUP BY ALL),
t AS (SELECT term, count(*) AS d, sum(c) AS g, sum(c * ln(c)) AS s FROM p GROUP BY ALL)"""

_FREQUENCIES = f"""
WITH q AS (SELECT question1 AS q FROM train UNION ALL SELECT question1 FROM test),
r AS (SELECT row_number() OVER () AS k, q FROM q WHERE q IS NOT NULL),
m AS (SELECT count(*) AS m FROM r),
words AS (SELECT k, unnest({_TERMS.format("q")}) AS term FROM r),
f AS (SELECT term, count(DISTINCT k) AS records, count(*) AS occurrences FROM words GROUP BY ALL)
SELECT term, records, occurrences, CASE WHEN records < 3 THEN 'rare' WHEN records * 20 > m THEN 'common' END AS mark FROM f, m"""

_COPIES = f"""
WITH raw AS (SELECT id, question1, question2 FROM train UNION ALL SELECT test_id, question1, question2 FROM test),
c AS (SELECT id, {_CANON.format("question1")} AS a, {_CANON.format("question2")} AS b FROM raw),
k AS (SELECT id, least(a, b) AS a, greatest(a, b) AS b FROM c WHERE a <> '' AND b <> '')
SELECT min(id) OVER (PARTITION BY a, b) AS kept, id FROM k"""


def _near_sql(sets: str, queries: str | None = None) -> str:
    """Near pairs of term sets by counting the terms they share; ``sets`` and ``queries`` have k and terms."""
    left, right = queries or sets, sets
    return f"""
size AS (SELECT DISTINCT k, len(s) AS n FROM (SELECT k, list_distinct(terms) AS s FROM {left} UNION ALL SELECT k, list_distinct(terms) FROM {right})),
l AS (SELECT DISTINCT k, unnest(terms) AS t FROM {left}), r AS (SELECT DISTINCT k, unnest(terms) AS t FROM {right}),
shared AS (SELECT l.k AS a, r.k AS b, count(*) AS c FROM l JOIN r USING (t) GROUP BY ALL),
near AS (SELECT a, b FROM shared JOIN size x ON x.k = a JOIN size y ON y.k = b WHERE x.n >= 3 AND y.n >= 3 AND 10 * c >= 7 * (x.n + y.n - c))"""


ORACLE_SQL = {
    "p3_found": f"""
WITH t1 AS (SELECT DISTINCT q AS k, {_TERMS.format("q")} AS terms FROM (SELECT question1 AS q FROM train UNION ALL SELECT question2 FROM train) WHERE q IS NOT NULL),
t2 AS (SELECT DISTINCT q AS k, {_TERMS.format("q")} AS terms FROM (SELECT question1 AS q FROM test UNION ALL SELECT question2 FROM test) WHERE q IS NOT NULL),
{_near_sql("t2", "t1")},
f AS (SELECT id, question1 AS a, question2 AS b FROM train UNION ALL SELECT id, question2, question1 FROM train)
SELECT DISTINCT f.id, e.test_id FROM f JOIN near p ON p.a = f.a JOIN test e ON e.question1 = p.b JOIN near q ON q.a = f.b AND q.b = e.question2""",
    "p7_found": f"""
WITH q AS (SELECT qid1 AS k, question1 AS q FROM train UNION SELECT qid2, question2 FROM train),
t1 AS (SELECT k, {_TERMS.format("q")} AS terms FROM q WHERE q <> ''),
{_near_sql("t1")}
SELECT a AS qid_a, b AS qid_b FROM near WHERE a < b""",
    "p1_found": f"""{_POSTINGS},
s AS (SELECT id, term, round(c * ln(n::DOUBLE / d), 6) AS score FROM p JOIN t USING (term), n WHERE d >= 2)
SELECT id, term FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, term) = 1""",
    "p1_log_entropy": f"""{_POSTINGS},
s AS (SELECT id, term, c::INT AS c, d, round(ln(1 + c::DOUBLE) * (1 - (ln(g::DOUBLE) - s / g) / ln(n::DOUBLE)), 6) AS score
      FROM p JOIN t USING (term), n WHERE d >= 2)
SELECT id, term, c, d, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, term) = 1""",
    "p2_found": f"SELECT term, mark FROM ({_FREQUENCIES}) WHERE mark IS NOT NULL",
    "p2_frequencies": _FREQUENCIES,
    "p2_rare_records": f"""
WITH q AS (SELECT 'train' AS part, id AS key, question1 AS q FROM train UNION ALL SELECT 'test', test_id, question1 FROM test),
w AS (SELECT DISTINCT part, key, unnest({_TERMS.format("q")}) AS term FROM q WHERE q IS NOT NULL)
SELECT term, part, key FROM w QUALIFY count(*) OVER (PARTITION BY term) < 3""",
    "p4_found": """
WITH RECURSIVE e AS (SELECT DISTINCT qid1 AS a, qid2 AS b FROM train WHERE is_duplicate = 1 AND qid1 <> qid2),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS qid, a AS seen FROM l UNION SELECT r.qid, l.b FROM r JOIN l ON l.a = r.seen)
SELECT min(seen) AS group_qid, qid FROM r GROUP BY qid HAVING min(seen) < qid""",
    "p5_found": f"SELECT kept AS kept_id, id AS copy_id FROM ({_COPIES}) WHERE kept <> id",
    "p5_copies": f"SELECT kept, count(*) AS copies FROM ({_COPIES}) GROUP BY kept",
}
