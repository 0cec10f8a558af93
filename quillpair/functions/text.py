"""Text normalisers as column functions.

Each takes and returns a string column, so a chain is one projection that Catalyst
collapses.  Null policy: :func:`lower_text` turns null into the text ``nan``, as the
chain's first step does by definition; every other function keeps null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillpair.functions.stem import lemmatized_text, stemmed_text

#: White space, as Unicode defines it, inside a character class of a pattern.
SPACE = r"\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The part of it that the pattern class for white space does not hold.
WIDE_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# Punctuation of other scripts and what it becomes.
CJK_FROM = "？，、。：；！～—“”【】《》「」（）"
CJK_TO = '?,,.:;!~-""[]    ()'
# Contractions, in the order in which they are replaced.
CONTRACTIONS = [(" m ", " am "), ("I'm ", "I am "), ("'re ", " are "), ("n't ", " not "), ("'ve ", " have "), ("'d ", " would "), ("'ll ", " will ")]
#: ASCII punctuation that becomes a space; the backslash stays.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
# Words that a Treebank tokenizer splits in two.
SPLIT_WORDS = [("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na")]
# The public English stop word list.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these those
am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by
for with about against between into through during before after above below to from up down in out on off over under again
further then once here there when where why how all any both each few more most other some such no nor not only own same so
than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't
doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't
shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()
#: Stop words that a view removes: the list without "can".
REMOVED_WORDS = [w for w in STOP_WORDS if w != "can"]


def words(c: Column) -> Column:
    """Runs of characters that are no white space; none in a null, empty or blank text.

    Wide spaces become blanks first: a class that lists them all is many times slower.
    """
    return F.regexp_extract_all(F.translate(F.coalesce(c, F.lit("")), WIDE_SPACE, " " * len(WIDE_SPACE)), F.lit(r"\S+"), F.lit(0))


def lower_text(c: Column) -> Column:
    """Lower case; null becomes ``nan``."""
    return F.lower(F.coalesce(c, F.lit("nan")))


def ascii_punctuation(c: Column) -> Column:
    """Punctuation of other scripts as ASCII."""
    return F.translate(c, CJK_FROM, CJK_TO)


def expand_contractions(c: Column) -> Column:
    """Contractions followed by a blank, spelled out."""
    for short, long in CONTRACTIONS:
        c = F.replace(c, F.lit(short), F.lit(long))
    return c


def expand_numbers(c: Column) -> Column:
    """``10k `` to ``10,000 ``, ``5% `` to ``5 percent ``."""
    c = F.regexp_replace(c, r"(\p{Nd}+)k ", "$1,000 ")
    return F.regexp_replace(c, r"(\p{Nd})% ", "$1 percent ")


def replace_special(c: Column) -> Column:
    return expand_numbers(expand_contractions(ascii_punctuation(c)))


def remove_punctuation(c: Column) -> Column:
    """ASCII punctuation, but for the backslash, as spaces."""
    return F.translate(c, PUNCTUATION, " " * len(PUNCTUATION))


def tokenize(c: Column) -> Column:
    """Words joined by one blank, with the Treebank splits."""
    joined = F.array_join(words(c), " ")
    heads = "|".join(f"{a}(?={b}(?: |$))" for a, b in SPLIT_WORDS)
    joined = F.regexp_replace(joined, f"(^| )({heads})", "$1$2 ")
    return F.when(c.isNotNull(), joined)


def remove_stop_words(c: Column, stops: list[str] = REMOVED_WORDS) -> Column:
    """Words that are not in ``stops``, case counting; repeats stay."""
    listed = F.array(*map(F.lit, stops))
    return F.when(c.isNotNull(), F.array_join(F.filter(words(c), lambda w: ~F.array_contains(listed, w)), " "))


def lemmatize(c: Column) -> Column:
    return lemmatized_text(c)


def stem(c: Column) -> Column:
    return stemmed_text(c)


_BASE = [lower_text, replace_special, remove_punctuation, tokenize]
#: Named chains; each starts from the raw text.  Views with corrected words need a dictionary: see operators.spelling.
VIEWS: dict[str, list[Callable[[Column], Column]]] = {
    "origin": [],
    "tokenize": _BASE,
    "stopword": [*_BASE, remove_stop_words],
    "lemmatized": [*_BASE, remove_stop_words, lemmatize],
    "lemmatized_stemmed": [*_BASE, remove_stop_words, lemmatize, stem],
}


def view(name: str) -> Callable[[Column], Column]:
    """The chain of a named view as one function."""

    def run(c: Column) -> Column:
        for step in VIEWS[name]:
            c = step(c)
        return c

    return run
