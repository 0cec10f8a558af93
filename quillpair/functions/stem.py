"""Stemming and lemmatising of English words.

Both work word by word and remember distinct words of a batch, so the Python cost
follows the vocabulary, not the text.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Fixed values of the published Porter2 algorithm.
_WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"), ("izer", "ize"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"),
    ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"), ("ogi", "og"),
    ("fulli", "ful"), ("lessli", "less"), ("li", ""),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion"]


def _regions(word: str) -> tuple[int, int]:
    """Starts of the two regions in which suffixes count."""

    def after(start: int) -> int:
        for k in range(start + 1, len(word)):
            if word[k] not in _VOWELS and word[k - 1] in _VOWELS:
                return k + 1
        return len(word)

    prefix = next((p for p in ("gener", "commun", "arsen") if word.startswith(p)), None)
    first = len(prefix) if prefix else after(0)
    return first, after(first) if first < len(word) else len(word)


def _short_end(word: str) -> bool:
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    return len(word) > 2 and word[-1] not in _VOWELS + "wxY" and word[-2] in _VOWELS and word[-3] not in _VOWELS


def _longest(word: str, suffixes: list) -> tuple[str, str] | None:
    pairs = [(s, "") if isinstance(s, str) else s for s in suffixes]
    return max((p for p in pairs if word.endswith(p[0])), key=lambda p: len(p[0]), default=None)


@lru_cache(maxsize=200_000)
def stem_word(word: str) -> str:
    """Stem of a lower-case word by the Porter2 algorithm."""
    word = re.sub("[’‘‛]", "'", word.lower())
    if word in _WHOLE:
        return _WHOLE[word]
    if len(word) <= 2:
        return word
    word = word.removeprefix("'")
    word = re.sub(f"(^|[{_VOWELS}])y", r"\1Y", word)
    r1, r2 = _regions(word)
    for s in ("'s'", "'s", "'"):
        if word.endswith(s):
            word = word[: -len(s)]
            break
    # plurals
    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith(("us", "ss")):
        pass
    elif word.endswith("s") and any(c in _VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in _AFTER_1A:
        return word
    # past and progressive
    found = _longest(word, ["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if found:
        s = found[0]
        if s in ("eed", "eedly"):
            if len(word) - len(s) >= r1:
                word = word[: -len(s)] + "ee"
        elif any(c in _VOWELS for c in word[: -len(s)]):
            word = word[: -len(s)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif word.endswith(_DOUBLES):
                word = word[:-1]
            elif r1 >= len(word) and _short_end(word):
                word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    # derived endings
    found = _longest(word, _STEP2)
    if found and len(word) - len(found[0]) >= r1:
        s, to = found
        base = word[: -len(s)]
        if s == "ogi":
            word = base + "og" if base.endswith("l") else word
        elif s == "li":
            word = base if base[-1:] and base[-1] in "cdeghkmnrt" else word
        else:
            word = base + to
    found = _longest(word, _STEP3)
    if found and len(word) - len(found[0]) >= r1:
        s, to = found
        if s != "ative" or len(word) - len(s) >= r2:
            word = word[: -len(s)] + to
    found = _longest(word, _STEP4)
    if found and len(word) - len(found[0]) >= r2:
        s = found[0]
        if s != "ion" or word[:-3].endswith(("s", "t")):
            word = word[: -len(s)]
    if word.endswith("e"):
        at = len(word) - 1
        if at >= r2 or at >= r1 and not _short_end(word[:-1]):
            word = word[:-1]
    elif word.endswith("l") and len(word) - 1 >= r2 and word[-2:-1] == "l":
        word = word[:-1]
    return word.replace("Y", "y")


# How English plural endings are taken off a noun, in order.
NOUN_ENDINGS = [("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"), ("s", "")]
#: Irregular plurals of common nouns.
IRREGULAR = {"children": "child", "feet": "foot", "teeth": "tooth", "mice": "mouse", "geese": "goose", "people": "people", "lives": "life", "wives": "wife", "knives": "knife", "leaves": "leaf"}


def lemma_word(word: str, known: frozenset[str] | None = None, irregular: dict[str, str] = IRREGULAR) -> str:
    """Singular of a noun.

    ``known`` is a noun lexicon: a form counts only if it is in it, and the shortest
    such form is taken.  Without one, the first ending that fits is taken off, but not
    from words of three letters or in -ss, -us or -is.
    """
    if word in irregular:
        return irregular[word]
    if known is not None:
        forms = [word] if word in known else []
        forms += [f for s, to in NOUN_ENDINGS if word.endswith(s) and (f := word[: -len(s)] + to) in known]
        return min(forms, key=len, default=word)
    if len(word) <= 3 or word.endswith(("ss", "us", "is")):
        return word
    for s, to in NOUN_ENDINGS:
        if word.endswith(s) and s != "ves":
            return word[: -len(s)] + to
    return word


def _by_word(c: Column, change) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        seen: dict[str, str] = {}

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            out = []
            for w in text.split():
                if w not in seen:
                    seen[w] = change(w)
                out.append(seen[w])
            return " ".join(out)

        return texts.map(one, na_action="ignore")

    return run(c)


def stemmed_text(c: Column) -> Column:
    """Each word's stem, joined by a blank; null stays null."""
    return _by_word(c, stem_word)


def lemmatized_text(c: Column, known: frozenset[str] | None = None) -> Column:
    """Each word's singular, joined by a blank; null stays null."""
    return _by_word(c, lambda w: lemma_word(w, known))
