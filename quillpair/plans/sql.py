"""Pieces of SQL from which the queries' twins for DuckDB are put together."""

from __future__ import annotations

from quillpair.functions.text import CJK_FROM, CJK_TO, CONTRACTIONS, PUNCTUATION, REMOVED_WORDS, SPACE, SPLIT_WORDS, STOP_WORDS


def text(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("'", "''") + "'"


def word_list(words: list[str]) -> str:
    return "[" + ", ".join(map(text, words)) + "]"


STOPS, REMOVED = word_list(STOP_WORDS), word_list(REMOVED_WORDS)


def words(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '[^{SPACE}]+')"


def characters(x: str) -> str:
    return f"regexp_extract_all(coalesce({x}, ''), '(?s).')"


def lower_text(x: str) -> str:
    return f"lower(coalesce({x}, 'nan'))"


def special(x: str) -> str:
    x = f"translate({x}, {text(CJK_FROM)}, {text(CJK_TO)})"
    for short, long in CONTRACTIONS:
        x = f"replace({x}, {text(short)}, {text(long)})"
    return numbers(x)


def numbers(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(\p{{Nd}}+)k ', '\1,000 ', 'g'), '(\p{{Nd}})% ', '\1 percent ', 'g')"


def punctuation(x: str) -> str:
    return f"translate({x}, {text(PUNCTUATION)}, {text(' ' * len(PUNCTUATION))})"


def tokenized(x: str) -> str:
    cases = " ".join(f"WHEN {text(a + b)} THEN {text(a + ' ' + b)}" for a, b in SPLIT_WORDS)
    return f"array_to_string(list_transform({words(x)}, lambda w: CASE w {cases} ELSE w END), ' ')"


def base_view(x: str) -> str:
    return tokenized(punctuation(special(lower_text(x))))


def stop_view(x: str) -> str:
    return f"array_to_string(list_filter({words(base_view(x))}, lambda w: NOT list_contains({REMOVED}, w)), ' ')"


def bigrams(a: str) -> str:
    return f"CASE WHEN len({a}) > 1 THEN list_transform(range(1, len({a})), lambda i: {a}[i] || '_' || {a}[i + 1]) ELSE {a} END"


def trigrams(a: str) -> str:
    return f"CASE WHEN len({a}) > 2 THEN list_transform(range(1, len({a}) - 1), lambda i: {a}[i] || '_' || {a}[i + 1] || '_' || {a}[i + 2]) ELSE {bigrams(a)} END"


def skip_bigrams(a: str) -> str:
    """Pairs of tokens with at most one between."""
    return f"CASE WHEN len({a}) > 1 THEN flatten(list_transform(range(1, len({a})), lambda i: list_transform(list_filter([1, 2], lambda k: i + k <= len({a})), lambda k: {a}[i] || '_' || {a}[i + k]))) ELSE {a} END"


def skip_trigrams(a: str) -> str:
    steps = "[[1, 1], [1, 2], [2, 1], [2, 2]]"
    triples = f"flatten(list_transform(range(1, len({a}) - 1), lambda i: list_transform(list_filter({steps}, lambda k: i + k[1] + k[2] <= len({a})), lambda k: {a}[i] || '_' || {a}[i + k[1]] || '_' || {a}[i + k[1] + k[2]])))"
    return f"CASE WHEN len({a}) > 2 THEN {triples} ELSE {skip_bigrams(a)} END"


def divide(x: str, y: str) -> str:
    return f"CASE WHEN ({y}) = 0 OR ({y}) IS NULL OR ({x}) IS NULL THEN 0.0 ELSE ({x})::DOUBLE / ({y}) END"


def jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return divide(both, f"len(list_distinct({a})) + len(list_distinct({b})) - {both}")


def dice(a: str, b: str) -> str:
    return divide(f"2 * len(list_intersect({a}, {b}))", f"len(list_distinct({a})) + len(list_distinct({b}))")


def places(a: str, b: str) -> str:
    same = f"len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: {a}[i] = {b}[i]))"
    return divide(same, f"greatest(len({a}), len({b}))")


PAIRS = """pairs AS (SELECT 'train' AS split, id, question1, question2 FROM train UNION ALL SELECT 'test', test_id, question1, question2 FROM test)"""
TEXTS = "texts AS (SELECT question1 AS text FROM pairs UNION ALL SELECT question2 FROM pairs)"
GRAMS = {
    "unichars": lambda w, c: c, "bichars": lambda w, c: bigrams(c), "trichars": lambda w, c: trigrams(c),
    "uniwords": lambda w, c: w, "biwords": lambda w, c: bigrams(w), "triwords": lambda w, c: trigrams(w),
}


def gram_features(prefix: str, grams: list[str], source: str = "pairs") -> str:
    """Lengths and set ratios for each kind of grams, over a table of split, id and two texts."""
    lists = ", ".join(f"{GRAMS[g](f'w{k}', f'c{k}')} AS {g}_{k}" for g in grams for k in "12")
    out = ", ".join(
        f"len({g}_1)::INT AS {prefix}_{g}_q1_len, len({g}_2)::INT AS {prefix}_{g}_q2_len, round({dice(f'{g}_1', f'{g}_2')}, 6) AS {prefix}_{g}_dice_ratio, "
        f"round({jaccard(f'{g}_1', f'{g}_2')}, 6) AS {prefix}_{g}_jaccard_ratio"
        for g in grams
    )
    return f"""w AS (SELECT split, id, {words("question1")} AS w1, {words("question2")} AS w2, {characters("question1")} AS c1, {characters("question2")} AS c2 FROM {source}),
g AS (SELECT split, id, {lists} FROM w)
SELECT split, id, {out} FROM g"""


MAGIC = f"""{PAIRS}, {TEXTS},
f AS (SELECT coalesce(text, '') AS t, count(*) AS n FROM texts GROUP BY 1),
k AS (SELECT split, id, coalesce(question1, '') AS a, coalesce(question2, '') AS b FROM pairs),
e AS (SELECT DISTINCT a AS x, b AS y FROM k UNION SELECT b, a FROM k),
d AS (SELECT DISTINCT a, b FROM k),
s AS (SELECT d.a, d.b, count(*) AS n FROM d JOIN e p ON p.x = d.a JOIN e q ON q.x = d.b AND q.y = p.y GROUP BY 1, 2),
magic AS (SELECT k.split, k.id, f1.n AS q1, f2.n AS q2, coalesce(s.n, 0) AS shared
          FROM k JOIN f f1 ON f1.t = k.a JOIN f f2 ON f2.t = k.b LEFT JOIN s ON s.a = k.a AND s.b = k.b)"""

#: Training pairs with a label and twelve features, as ``features``.
FEATURES = f"""{MAGIC},
w AS (SELECT t.id, t.is_duplicate, {words("t.question1")} AS w1, {words("t.question2")} AS w2, length(coalesce(t.question1, 'nan')) AS l1,
      length(coalesce(t.question2, 'nan')) AS l2, m.q1, m.q2, m.shared FROM train t JOIN magic m ON m.id = t.id AND m.split = 'train'),
features AS (SELECT id, is_duplicate, round({dice("w1", "w2")}, 6) AS o_uniwords_dice_ratio, round({jaccard("w1", "w2")}, 6) AS o_uniwords_jaccard_ratio,
      len(w1)::INT AS o_uniwords_q1_len, len(w2)::INT AS o_uniwords_q2_len, l1::INT AS len_q1, l2::INT AS len_q2, q1 AS magic_q1_freq, q2 AS magic_q2_freq, shared AS magic_intersect FROM w)"""
