"""Words of many texts at once as 64-bit hashes, for operators that look at windows of words."""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import xxhash

#: Words that a worker remembers; a full table starts over.
REMEMBERED = 150_000


class WordTable(dict):
    """word bytes -> its number in ``words`` and ``hashes``, filled on demand."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self.hashes = array("Q")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.words)
        self.words.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        return number


_table = WordTable()


@dataclass
class Numbered:
    """The words of some texts: each word's number, where each text begins (and the end), and the numbers' words and hashes."""

    ids: np.ndarray
    begins: np.ndarray
    words: list[bytes]
    hashes: np.ndarray

    @property
    def values(self) -> np.ndarray:
        return self.hashes[self.ids]


def numbered(texts: list[bytes]) -> Numbered:
    """Number the words of texts.

    ``bytes.split`` parts words at space and the controls from tab to carriage return, and nowhere else.
    """
    global _table
    if len(_table) > REMEMBERED:
        _table = WordTable()
    get, parts, begins = _table.__getitem__, [], np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        parts.append(np.fromiter(map(get, words), np.int64, len(words)))
        begins[i + 1] = begins[i] + len(words)
    ids = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return Numbered(ids, begins, _table.words, np.array(_table.hashes, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive values; the caller leaves out those that cross a text's end."""
    count = max(0, len(values) - n + 1)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[i : i + count]
    return mixed(out)


def window_starts(begins: np.ndarray, n: int) -> np.ndarray:
    """Positions at which n words of one text begin."""
    total = int(begins[-1])
    inside = np.ones(total, bool)
    for back in range(1, n):  # the last n-1 words of a text begin no window
        at = begins[1:] - back
        inside[at[at >= begins[:-1]]] = False
    return np.flatnonzero(inside)
