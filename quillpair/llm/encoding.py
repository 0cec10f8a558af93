"""Token ids of a whole corpus by a public byte-pair tokenizer.

A text is cut into words by the tokenizer's published pattern.  The lexicon holds the
words that are one entry of the vocabulary -- a byte-pair vocabulary lists words in
order of how early, that is how often, they were merged -- and any further frequent
words a caller names.  Words that are not in it are merged exactly by rank.

The lexicon is compiled once on the driver; its size is bounded by the vocabulary and
the named words.  Spark ships it as a file to each executor, where all workers map
the same pages.  A worker numbers the distinct words it has met, so each is looked up
or merged once, and ids of a batch are gathered by number.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillpair.llm.lexicon import Lexicon, compile_lexicon
from quillpair.sources.shared import put_shared_file

#: Folder of the public tokenizers' files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pattern that cuts a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most distinct words that a worker remembers, and code points that it encodes at a time.
REMEMBERED, AT_A_TIME = 400_000, 2_000_000


@lru_cache(maxsize=2)
def _merger(path: str):
    """Exact merges of one word (bytes) to ids, by the rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece, ranks


def vocabulary_words(path: str, extra: list[str] = ()) -> dict[bytes, list[int]]:
    """Words of the lexicon: entries of the vocabulary that the pattern keeps whole, and the pieces of ``extra``."""
    merge, ranks = _merger(path)
    cut = regex.compile(PATTERN)
    words: dict[bytes, list[int]] = {}
    for raw in [*ranks, *(w.encode() for e in extra for w in cut.findall(e))]:
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if cut.fullmatch(text) and cut.findall(text) == [text]:
            words[raw] = list(merge(raw))
    return words


class Encoder:
    """Encodes texts in one worker."""

    def __init__(self, lexicon: Lexicon, ranks_path: str):
        self.lexicon, self.merge = lexicon, _merger(ranks_path)[0]
        self.cut = regex.compile(PATTERN).findall
        self.forget()

    def forget(self) -> None:
        self.code: dict[str, int] = {}
        self.sizes = np.empty(0, np.int64)
        self.at = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        raw = [w.encode("utf-8", "replace") for w in words]
        number = self.lexicon.numbers(raw)
        found = [self.lexicon.ids_of(n) if n >= 0 else self.merge(w) for n, w in zip(number.tolist(), raw, strict=True)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum()))
        for w in words:
            self.code[w] = len(self.code)
        self.sizes = np.concatenate([self.sizes, sizes])
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, flat])

    def _codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and the number of each word."""
        if len(self.code) > REMEMBERED:
            self.forget()
        words: list[str] = []
        lengths = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                before = len(words)
                words += self.cut(text)
                lengths[k] = len(words) - before
        new = set(words).difference(self.code)
        if new:
            self._learn(list(new))
        return lengths, np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and flat ids of the texts."""
        lengths, codes = self._codes(texts)
        size = self.sizes[codes]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - self.at[codes], size)
        offsets = ends[np.concatenate([[0], np.cumsum(lengths)])]
        return offsets.astype(np.int32), self.ids[place]

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text."""
        lengths, codes = self._codes(texts)
        ends = np.concatenate([[0], np.cumsum(self.sizes[codes])])
        at = np.concatenate([[0], np.cumsum(lengths)])
        return np.diff(ends[at])


@lru_cache(maxsize=1)
def _encoder(lexicon_file: str, ranks_path: str) -> Encoder:
    return Encoder(Lexicon(SparkFiles.get(lexicon_file)), ranks_path)


def ship_lexicon(spark: SparkSession, ranks_path: str, extra: list[str] = ()) -> str:
    """Compile the lexicon, put it into the shared folder and register it as a file of the job; returns its name."""
    content = compile_lexicon(vocabulary_words(ranks_path, extra))
    name = f"lexicon-{hashlib.sha256(content).hexdigest()[:16]}.bin"
    spark.sparkContext.addFile(put_shared_file(spark, name, content))
    return name


def _pieces(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of together about ``AT_A_TIME`` code points."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= AT_A_TIME:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_texts(df: DataFrame, key: str, text: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", extra: list[str] = ()) -> DataFrame:
    """``(key, ids)``: token ids of each text; null and empty texts give the empty list.

    Strings of special tokens are ordinary text.  Repeated rows and null keys are kept.
    """
    name = ship_lexicon(df.sparkSession, ranks, extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name, ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _pieces(texts):
                offsets, ids = encoder.encode(texts[a:b])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [key, "ids"])

    rows = df.select(F.col(key), F.col(text))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, text: str, ranks: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", name: str = "tokens") -> DataFrame:
    """``df`` without ``text`` and with ``name``, the text's number of tokens (0 for null and empty texts)."""
    lexicon = ship_lexicon(df.sparkSession, ranks)
    others = [c for c in df.columns if c != text]
    rows = df.select(text, *others)
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others), f"`{name}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(lexicon, ranks)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            counts = [encoder.count(texts[a:b]) for a, b in _pieces(texts)]
            total = pa.array(np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], total], [*others, name])

    return rows.mapInArrow(run, schema)
