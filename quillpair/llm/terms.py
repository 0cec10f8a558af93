"""Terms of a text: maximal runs of letters, combining marks and digits, lower case.

All operators of the subpackage that work on terms split texts here, so that
their results fit together.  A null, empty or blank text has no terms.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex

_ASCII = re.compile(r"[a-z0-9]+")
_ANY = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def split_terms(text: str | None) -> list[str]:
    """Terms of one text in order, with repeats."""
    if not text:
        return []
    low = text.lower()
    return _ASCII.findall(low) if low.isascii() else _ANY.findall(low)


def batch_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of many texts as ``(row of each token, code of each token, term of each code)``."""
    tokens: list[str] = []
    lengths = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        found = split_terms(text)
        lengths[k] = len(found)
        tokens += found
    if not tokens:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, object)
    codes, terms = pd.factorize(np.array(tokens, dtype=object))
    return np.repeat(np.arange(len(texts)), lengths), codes.astype(np.int64), terms


def count_terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of each term in each text: ``(row, code, count, term of each code)``, sorted by row."""
    rows, codes, terms = batch_terms(texts)
    if not len(rows):
        return rows, codes, np.empty(0, np.int64), terms
    key, count = np.unique(rows * len(terms) + codes, return_counts=True)
    return key // len(terms), key % len(terms), count, terms
