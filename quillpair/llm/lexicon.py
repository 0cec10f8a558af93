"""Minimal acyclic transducer over words, with lists of token ids as outputs.

States that accept the same endings are one state.  Every arc carries how many words
sort before the ones behind it, so the sum along a word's path is the word's number,
and numbers point into one flat array of ids.  The whole lexicon is a handful of
integer arrays in a file that workers map into memory; a batch of words is looked up
together, one byte position at a time.
"""

from __future__ import annotations

import io
import mmap

import numpy as np

_FIELDS = ("arc_key", "arc_to", "arc_skip", "final", "ids_at", "ids")


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The file's content for ``words``; the empty word is not allowed."""
    order = sorted(words)
    register: dict[tuple, int] = {}
    arcs: list[tuple[tuple[int, int], ...]] = []
    finals: list[bool] = []
    # open states of the last word: [final, [(byte, state)...]]
    path: list[list] = [[False, []]]
    previous = b""

    def close(down_to: int) -> None:
        while len(path) - 1 > down_to:
            final, out = path.pop()
            signature = (final, tuple(out))
            state = register.get(signature)
            if state is None:
                state = register[signature] = len(arcs)
                arcs.append(signature[1])
                finals.append(final)
            path[-1][1].append((previous[len(path) - 1], state))

    for word in order:
        if not word:
            raise ValueError("the empty word has no path")
        same = 0
        while same < min(len(word), len(previous)) and word[same] == previous[same]:
            same += 1
        close(same)
        path += [[False, []] for _ in word[same:]]
        path[-1][0] = True
        previous = word
    close(0)
    root = len(arcs)
    arcs.append(tuple(path[0][1]))
    finals.append(False)
    # words accepted from each state; a state is made after the ones it leads to
    behind = np.zeros(len(arcs), np.int64)
    key, to, skip = [], [], []
    for state, out in enumerate(arcs):
        passed = int(finals[state])
        for byte, target in out:
            key.append((state << 8) | byte)
            to.append(target)
            skip.append(passed)
            passed += int(behind[target])
        behind[state] = passed
    lengths = np.array([len(words[w]) for w in order], np.int64)
    arrays = {
        "arc_key": np.array(key, np.int64),
        "arc_to": np.array(to, np.int32),
        "arc_skip": np.array(skip, np.int32),
        "final": np.array(finals, np.int8),
        "ids_at": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64),
        "ids": np.array([i for w in order for i in words[w]], np.int32),
    }
    head = np.array([root, *(len(arrays[f]) for f in _FIELDS)], np.int64)
    out = io.BytesIO()
    out.write(head.tobytes())
    for field in _FIELDS:
        raw = arrays[field].tobytes()
        out.write(raw + b"\0" * (-len(raw) % 8))
    return out.getvalue()


class Lexicon:
    """A compiled lexicon, mapped from a file or read from bytes."""

    def __init__(self, source: str | bytes):
        if isinstance(source, str):
            with open(source, "rb") as f:
                source = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        head = np.frombuffer(source, np.int64, 1 + len(_FIELDS))
        self.root, at = int(head[0]), head.nbytes
        for field, size, kind in zip(_FIELDS, head[1:].tolist(), (np.int64, np.int32, np.int32, np.int8, np.int64, np.int32), strict=True):
            setattr(self, field, np.frombuffer(source, kind, size, at))
            at += -(-size * np.dtype(kind).itemsize // 8) * 8

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Number of each word, -1 for words that are not in the lexicon."""
        number = np.zeros(len(words), np.int64)
        state = np.full(len(words), self.root, np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(length) - length
        letters = np.frombuffer(b"".join(words) + b"\0", np.uint8)
        alive = np.flatnonzero(length > 0)
        state[length == 0] = -1
        depth = 0
        while len(alive) and len(self.arc_key):
            key = (state[alive] << 8) | letters[start[alive] + depth]
            at = np.minimum(np.searchsorted(self.arc_key, key), len(self.arc_key) - 1)
            known = self.arc_key[at] == key
            state[alive[~known]] = -1
            alive, at = alive[known], at[known]
            number[alive] += self.arc_skip[at]
            state[alive] = self.arc_to[at]
            depth += 1
            alive = alive[length[alive] > depth]
        ends = (state >= 0) & (self.final[np.maximum(state, 0)] == 1)
        return np.where(ends, number, -1)

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.ids_at[number] : self.ids_at[number + 1]].tolist()
