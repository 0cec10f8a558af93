"""Full-text index of integer sequences that is searched backwards.

The suffixes of all documents' symbols are sorted; what is kept is the
Burrows-Wheeler transform as lists of places by symbol, from which ranks are read by
binary search, and the document of each suffix.  All patterns of a batch take a step
together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class BackwardIndex:
    """Index over documents given as one array of symbols and the document of each."""

    def __init__(self, symbols: np.ndarray, documents: np.ndarray):
        self.alphabet, codes = np.unique(symbols, return_inverse=True)
        breaks = np.flatnonzero(np.diff(documents)) + 1 if len(documents) else np.empty(0, np.int64)
        # every document ends in a separator of its own, which sorts before all symbols
        stops = len(breaks) + (1 if len(documents) else 0)
        at = np.arange(len(codes)) + np.searchsorted(breaks, np.arange(len(codes)), side="right")
        size = len(codes) + stops
        text = np.empty(size, np.int64)
        text[at] = codes + stops
        owner = np.empty(size, np.int64)
        owner[at] = documents
        gap = np.ones(size, bool)
        gap[at] = False
        text[gap] = np.arange(stops)
        owner[gap] = documents[np.append(breaks, len(codes)) - 1] if stops else 0
        order = self._sort(text, stops)
        before = text[order - 1]  # the last symbol stands before the first
        by_symbol = np.argsort(before, kind="stable")
        self.size, self.stops = size, stops
        self.places = before[by_symbol] * (size + 1) + by_symbol
        self.begin = np.searchsorted(np.sort(text), np.arange(stops, stops + len(self.alphabet) + 1))
        self.owner = owner[order]

    @staticmethod
    def _sort(text: np.ndarray, stops: int) -> np.ndarray:
        """Suffix array by doubling; separators are unique, so it ends with the longest repeat."""
        rank, step, size = text.copy(), 1, len(text)
        while True:
            behind = np.zeros(size, np.int64)
            behind[:-step] = rank[step:] + 1
            key = rank * (size + 2) + behind if size and rank.max() < (1 << 62) // (size + 2) else None
            if key is None:
                return np.argsort(rank)
            order = np.argsort(key, kind="stable")
            new = np.ones(size, bool)
            new[1:] = np.diff(key[order]) != 0
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(new) - 1
            if new.all() or step >= size:
                return order
            step *= 2

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Code of each symbol, -1 for symbols that no document has."""
        if not len(self.alphabet):
            return np.full(len(symbols), -1)
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at, -1)

    def single(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that start with each symbol."""
        known = np.maximum(code, 0)
        low, high = self.begin[known], self.begin[known + 1]
        return low, np.where(code < 0, low, high)

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step backwards: the ranges of the symbol followed by what the given ranges match."""
        known = np.maximum(code, 0)
        base = (known + self.stops) * (self.size + 1)
        first = np.searchsorted(self.places, base)
        lo = self.begin[known] + np.searchsorted(self.places, base + low) - first
        hi = self.begin[known] + np.searchsorted(self.places, base + high) - first
        return lo, np.where(code < 0, lo, hi)

    def followed(self, code: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two steps backwards: the ranges of each symbol followed by any of the symbols from ``least`` to ``most``."""
        low, high = self.begin[np.searchsorted(self.alphabet, least)], self.begin[np.searchsorted(self.alphabet, most, side="right")]
        return self.extend(code, low, high)

    def matches(self, symbols: np.ndarray, patterns: np.ndarray, block: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(place in symbols, document, 1 or more)``: right ends of maximal matches of the patterns.

        A document is given for a place if it holds the place's symbol and does not go on
        with the pattern's next one: those that do are given for a later place of the same
        pattern.  So each run of symbols that a pattern shares with a document is given once.
        """
        code = self.codes(symbols)
        low, high = self.single(code)
        inner_low, inner_high = high.copy(), high.copy()  # empty: nothing follows
        follows = np.flatnonzero((patterns[:-1] == patterns[1:]) & (code[:-1] >= 0) & (code[1:] >= 0)) if len(patterns) > 1 else np.empty(0, np.int64)
        if len(follows):
            inner_low[follows], inner_high[follows] = self.extend(code[follows], low[follows + 1], high[follows + 1])
            none = follows[inner_low[follows] == inner_high[follows]]
            inner_low[none] = inner_high[none] = high[none]
        for a, b in ((low, inner_low), (inner_high, high)):
            width = np.maximum(b - a, 0)
            ends = np.cumsum(width)
            start = 0
            while start < len(width):
                base = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, base + block, side="right")))
                w = width[start:stop]
                if w.sum():
                    place = np.repeat(np.arange(start, stop), w)
                    offset = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                    yield place, self.owner[a[place] + offset], w
                start = stop
