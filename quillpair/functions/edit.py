"""Edit similarities, common subsequences and transport, as Arrow-batched UDFs.

The algorithms have no built-in counterpart.  Each UDF remembers the pairs of its
batch, so repeated pairs cost once.  Whole texts are compared; long ones by rows of
the distance table, never by all of it.
"""

from __future__ import annotations

import lzma
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common_length(a: str | list, b: str | list) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(maxsize=500_000)
def _token_gap(a: str, b: str) -> float:
    """Insertions and deletions between two tokens, by their lengths together: 0 if equal, 1 if nothing is shared."""
    if a == b:
        return 0.0
    size = len(a) + len(b)
    return (size - 2 * common_length(a, b)) / size


def text_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence, by both lengths; 1 for two empty texts."""
    size = len(a) + len(b)
    return 2 * common_length(a, b) / size if size else 1.0


def _gaps(a: list[str], b: list[str]) -> np.ndarray:
    """Gap of each token of a to each of b.

    Tokens of one short length, as of character grams, are compared all at once by the
    table of their common subsequence; others by distinct pair.
    """
    size = len(a[0])
    if size <= 8 and all(len(t) == size for t in a) and all(len(t) == size for t in b):
        x, y = (np.array([[ord(c) for c in t] for t in s], np.int32) for s in (a, b))
        row = [np.zeros((len(a), len(b)), np.int8)] * (size + 1)
        for i in range(size):
            new = [row[0]]
            for j in range(size):
                equal = x[:, i, None] == y[None, :, j]
                new.append(np.where(equal, row[j] + 1, np.maximum(row[j + 1], new[j])).astype(np.int8))
            row = new
        return (size - row[size]) / size
    p, q = list(dict.fromkeys(a)), list(dict.fromkeys(b))
    table = np.array([[_token_gap(s, t) for t in q] for s in p])
    at_p, at_q = {t: k for k, t in enumerate(p)}, {t: k for k, t in enumerate(q)}
    return table[np.ix_([at_p[t] for t in a], [at_q[t] for t in b])]


def sequence_ratio(a: list[str], b: list[str]) -> float:
    """Similarity of token sequences: a token in or out costs 1, a replacement up to 2 by how the tokens differ."""
    m, n = len(a), len(b)
    if m + n == 0:
        return 0.0
    if all(len(t) == 1 for t in a) and all(len(t) == 1 for t in b):
        return 2 * common_length(a, b) / (m + n)
    if a == b:
        return 1.0
    if not m or not n:
        return 0.0
    steps = np.arange(n + 1, dtype=float)
    row = steps.copy()
    block = max(1, 1_000_000 // n)  # rows of the gaps held at once
    for start in range(0, m, block):
        for cost in 2 * _gaps(a[start : start + block], b):
            new = np.empty(n + 1)
            new[0] = row[0] + 1
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + cost)
            row = np.minimum.accumulate(new - steps) + steps
    return float((m + n - row[n]) / (m + n))


def assign(cost: np.ndarray) -> float:
    """Least total cost of giving each row a column of its own; rows at most columns."""
    m, n = cost.shape
    u, v = np.zeros(m + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)
    back = np.zeros(n + 1, int)
    for i in range(1, m + 1):
        owner[0] = i
        j = 0
        slack = np.full(n + 1, np.inf)
        used = np.zeros(n + 1, bool)
        while True:
            used[j] = True
            here = owner[j]
            free = ~used[1:]
            now = cost[here - 1] - u[here] - v[1:]
            better = free & (now < slack[1:])
            slack[1:][better] = now[better]
            back[1:][better] = j
            nearest = int(np.argmin(np.where(free, slack[1:], np.inf))) + 1
            step = slack[nearest]
            u[owner[used]] += step
            v[used] -= step
            slack[~used] -= step
            j = nearest
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[back[j]]
            j = back[j]
    matched = np.flatnonzero(owner[1:])
    return float(sum(cost[owner[j + 1] - 1, j] for j in matched))


def set_ratio(a: list[str], b: list[str]) -> float:
    """Similarity of token multisets by their cheapest matching; tokens without a partner cost 1 each.

    The time grows with the cube of the tokens that have no equal partner.
    """
    m, n = len(a), len(b)
    if m + n == 0:
        return 0.0
    if {len(t) for t in a} | {len(t) for t in b} <= {len((a or b)[0])}:  # of one length the gap is a metric: equal tokens match
        both = Counter(a) & Counter(b)
        rest_a, rest_b = list((Counter(a) - both).elements()), list((Counter(b) - both).elements())
    else:
        rest_a, rest_b = list(a), list(b)
    if len(rest_a) > len(rest_b):
        rest_a, rest_b = rest_b, rest_a
    total = 0.0
    if rest_a:
        if all(len(t) == 1 for t in rest_a + rest_b):
            total = float(len(rest_a))
        else:
            total = assign(_gaps(rest_a, rest_b))
    return (m + n - (abs(m - n) + 2 * total)) / (m + n)


@lru_cache(maxsize=1)
def _short_filters() -> list[dict]:
    """The default filter with a dictionary for texts up to ``_SHORT`` bytes.

    One compression with the default dictionary comes first: its release teaches the C
    library to keep such blocks, else each call maps and clears fresh pages.
    """
    lzma.compress(b"")
    return [{"id": lzma.FILTER_LZMA2, "preset": lzma.PRESET_DEFAULT, "dict_size": _SHORT}]


_SHORT = 4_096


def _compressed(text: bytes) -> int:
    """Size by the default settings; a dictionary beyond the text changes only what is allocated and cleared."""
    return len(lzma.compress(text, filters=_short_filters()) if len(text) <= _SHORT else lzma.compress(text))


_compressed_once = lru_cache(maxsize=100_000)(_compressed)


def compression_ratio(a: str, b: str) -> float:
    """One minus the compression distance; 1 for equal texts."""
    if a == b:
        return 1.0
    x, y = a.encode(), b.encode()
    m, n = _compressed_once(x), _compressed_once(y)
    both = min(_compressed(x + y), _compressed(y + x)) if x and y else max(m, n)
    return 1 - (both - min(m, n)) / max(m, n)


def common_words(a: str, b: str) -> tuple[int, str, str]:
    """Length of the longest common word sequence, and the words of each text that are not in it.

    Of several sequences the one found from the end: a match first, then a step in the
    first text, then in the second.
    """
    x, y = a.split(), b.split()
    table = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    code = {w: k for k, w in enumerate(dict.fromkeys(x + y))}
    cy = np.array([code[w] for w in y], int)
    for i, w in enumerate(x):
        take = np.where(cy == code[w], table[i, :-1] + 1, 0) if len(y) else cy
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], take))
    keep_x, keep_y = [True] * len(x), [True] * len(y)
    i, j = len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            keep_x[i - 1] = keep_y[j - 1] = False
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            j -= 1
    left = [" ".join(w for w, k in zip(t, keep, strict=True) if k) for t, keep in ((x, keep_x), (y, keep_y))]
    return int(table[-1, -1]), left[0], left[1]


_NO_WORD = re.compile(r"\W")


def plain(text: str | None) -> str:
    """ASCII characters in lower case, all but letters, digits and underscores as blanks, ends trimmed."""
    kept = "".join(c for c in text or "" if c < "\x80")
    return _NO_WORD.sub(" ", kept).lower().strip()


def _percent(a: str, b: str) -> int:
    return round(100 * text_ratio(a, b)) if a and b else 0


def quick_percent(a: str | None, b: str | None) -> int:
    """Similarity of two texts in plain form, in percent; 0 if one is empty."""
    return _percent(plain(a), plain(b))


def sorted_percent(a: str | None, b: str | None) -> int:
    """Similarity of the sorted words."""
    return _percent(*(" ".join(sorted(plain(t).split())) for t in (a, b)))


def shared_percent(a: str | None, b: str | None) -> int:
    """Largest similarity among the shared words, and these with the rest of either text."""
    x, y = plain(a), plain(b)
    if not x or not y:
        return 0
    p, q = set(x.split()), set(y.split())
    shared = " ".join(sorted(p & q))
    one, two = ((shared + " " + " ".join(sorted(r))).strip() for r in (p - q, q - p))
    return max(_percent(shared, one), _percent(shared, two), _percent(one, two))


def _pairwise(change: Callable, kind: str) -> Callable[[Column, Column], Column]:
    """UDF of a function of two values; null if either is null."""

    def on(a: Column, b: Column) -> Column:
        @F.pandas_udf(kind)
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            seen: dict = {}
            out = []
            for p, q in zip(x, y, strict=True):
                if p is None or q is None:
                    out.append(None)
                    continue
                key = (p, q) if isinstance(p, str) else ("\0".join(p), "\0".join(q))
                if key not in seen:
                    seen[key] = change(p, q) if isinstance(p, str) else change(list(p), list(q))
                out.append(seen[key])
            return pd.Series(out, dtype="float64" if kind == "double" else object)

        return run(a, b)

    return on


edit_seq_ratio = _pairwise(sequence_ratio, "double")
edit_set_ratio = _pairwise(set_ratio, "double")
lzma_ratio = _pairwise(compression_ratio, "double")
fuzz_qratio = _pairwise(quick_percent, "int")
fuzz_token_sort_ratio = _pairwise(sorted_percent, "int")
fuzz_token_set_ratio = _pairwise(shared_percent, "int")


def longest_common_words(a: Column, b: Column) -> Column:
    """Struct ``(length, left1, left2)`` of :func:`common_words`; null if either text is null."""

    @F.pandas_udf("length int, left1 string, left2 string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [common_words(p, q) if p is not None and q is not None else (None, None, None) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["length", "left1", "left2"])

    return F.when(a.isNotNull() & b.isNotNull(), run(a, b))
