"""A small part-of-speech tagger for questions: closed classes by list, open ones by ending and place.

No trained tagger or corpus is available offline, so tags of open-class words are an
approximation; the features built on them are exact for the tags given.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags that count as nouns and as verbs.
NOUNS = ["NN", "NNS", "NNP"]
VERBS = ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"]
# Closed classes.
_CLOSED = {
    "DT": "a an the this that these those each every some any no all both",
    "IN": "of in to for on with as at by from about into over after before between through against during without near than like because if while until",
    "CC": "and or but nor yet",
    "PRP": "i you he she it we they me him her us them",
    "PRP$": "my your his its our their",
    "MD": "can could will would shall should may might must",
    "WP": "who what whom",
    "WRB": "how why when where",
    "WDT": "which",
    "VBZ": "is has does",
    "VBP": "are am have do",
    "VBD": "was were had did",
    "VB": "be",
    "RB": "not never very too so also only just still",
    "EX": "there",
}
_LOOKUP = {w: tag for tag, words in _CLOSED.items() for w in words.split()}
_ENDINGS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("less", "JJ"), ("est", "JJS")]


def tag_words(words: list[str]) -> list[tuple[str, str]]:
    """``(word, tag)`` of each word."""
    out: list[tuple[str, str]] = []
    for k, w in enumerate(words):
        low, before = w.lower(), out[-1][1] if out else ""
        tag = _LOOKUP.get(low)
        if tag is None:
            if not any(c.isalpha() for c in w):
                tag = "CD" if any(c.isdigit() for c in w) else "SYM"
            elif before in ("MD", "PRP") or out and out[-1][0].lower() == "to":
                tag = "VB"
            elif k and w[0].isupper():
                tag = "NNP"
            else:
                tag = next((t for e, t in _ENDINGS if low.endswith(e) and len(low) > len(e) + 2), None) or ("NNS" if low.endswith("s") and not low.endswith("ss") and len(low) > 3 else "NN")
        out.append((w, tag))
    return out


def tagged(tokens: Column) -> Column:
    """Array of structs ``(word, pos)``; null for null arrays."""

    @F.pandas_udf("array<struct<word:string,pos:string>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: None if r is None else [{"word": w, "pos": t} for w, t in tag_words(list(r))])

    return run(tokens)


def of_class(tags: Column, kinds: list[str]) -> Column:
    """Words of an array of tagged words whose tag is one of ``kinds``."""
    listed = F.array(*map(F.lit, kinds))
    return F.transform(F.filter(tags, lambda t: F.array_contains(listed, t.pos)), lambda t: t.word)
