"""Byte-level BPE encoding and decoding with contiguous rank arrays.

A short word is a row of part ids next to a row of adjacent ranks (rank of the merge of part i with part i+1, or NEVER).
Each step scans a row for its minimum, merges that pair, deletes the boundary between its parts and looks up the ranks
of the two neighbours anew, until no rank is left. Words of one length are rows of one matrix: after a step all rows that still
merge have one part fewer, so the matrices stay contiguous and numpy does a step for thousands of words. Longer
words keep the same arrays as linked lists under a heap, so a text without any white space costs n log n.

Texts are parted into words by the vocabulary's pattern; special tokens in a text are single ids, as in the library. Each
space-free stretch is encoded once per worker and remembered in a bounded cache. Decoding joins the bytes of the tokens and
replaces what is not UTF-8.

Defined results: a null text is empty and has no ids; ids and rows are independent of each other, so null ids, ties,
repeated rows, empty tables and other columns change nothing.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes
from .wordtok import Generations, byte_alphabet

#: Longest word, in bytes, that is a matrix row; rows of a matrix at most; entries of a cache generation; longest cached stretch.
SHORT, ROWS, GENERATION, KEPT_LENGTH = 40, 20_000, 250_000, 48

# White space as Unicode's property has it, and the word pattern of the vocabulary with it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"

_WHITE_BYTES = rb"(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
#: A space between two white spaces, or between one and the end: there stretches are not independent.
_RUN = re.compile(rb" (?=[\t-\r \xc2\xe1-\xe3]|$)(?<=[\t-\r \x80-\x8a\xa0\xa8\xa9\xaf\x9f] )")
_RUN_FULL = re.compile(_WHITE_BYTES + rb" (?:" + _WHITE_BYTES + rb"|$)")
NEVER = np.int32(2**31 - 1)
_loaded: dict[str, "RankBPE"] = {}


class RankBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        splitter = found.get("pre_tokenizer") or {}
        plain = splitter.get("type") == "ByteLevel" and splitter.get("use_regex", True) and not splitter.get("add_prefix_space")
        if not plain or found.get("normalizer") or found["model"]["type"] != "BPE" or found["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        vocabulary, merges = found["model"]["vocab"], found["model"]["merges"]
        value = {c: b for b, c in byte_alphabet().items()}
        self.special = {x["content"].encode(): x["id"] for x in found.get("added_tokens", [])}
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.tokens = [b""] * size
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(value[c] for c in token)
        for token, i in self.special.items():
            self.tokens[i] = token
        self.of_byte = np.zeros(256, np.int32)
        for c, b in value.items():
            self.of_byte[b] = vocabulary[c]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in merges]
        left = np.array([vocabulary[a] for a, _ in pairs], np.uint64)
        right = np.array([vocabulary[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int32)
        self._build((left << np.uint64(32)) | right)
        self.rank_of = {(a, b): r for r, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}
        self.split_special = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.split_words = regex.compile(PATTERN).findall
        self.stretches, self.words = Generations(GENERATION), Generations(GENERATION)

    def _build(self, keys: np.ndarray) -> None:
        """An open-addressing table of the merges, at most a quarter full."""
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] == np.uint64(2**64 - 1)
            slots, first = np.unique(at[free], return_index=True)
            own = todo[free][first]
            self.keys[slots], self.ranks[slots] = keys[own], own
            left = ~np.isin(todo, own)
            todo, at = todo[left], (at[left] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _adjacent(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair."""
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        at = self._slot(keys)
        found, out = self.keys[at], np.full(len(keys), NEVER, np.int32)
        hit = found == keys
        out[hit] = self.ranks[at[hit]]
        open_ = np.flatnonzero(~hit & (found != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(2**64 - 1))]
        return out.reshape(left.shape)

    def _rows(self, words: list[bytes], length: int) -> Iterator[tuple[bytes, bytes]]:
        """The ids of words of one length."""
        index = np.arange(len(words))
        parts = self.of_byte[np.frombuffer(b"".join(words), np.uint8).reshape(-1, length)]
        ranks = self._adjacent(parts[:, :-1], parts[:, 1:])
        for n in range(length, 0, -1):
            row = np.arange(len(index))
            at = ranks.argmin(1) if n > 1 else np.zeros(len(index), np.int64)
            best = ranks[row, at] if n > 1 else np.full(len(index), NEVER)
            done = np.flatnonzero(best == NEVER)
            data = parts[done].astype("<u4").tobytes()
            for k, i in enumerate(index[done].tolist()):
                yield words[i], data[4 * n * k : 4 * n * (k + 1)]
            more = np.flatnonzero(best != NEVER)
            if not len(more):
                return
            index, at, row, rank = index[more], at[more], np.arange(len(more)), best[more]
            parts, ranks = parts[more], ranks[more]
            parts[row, at] = self.merged[rank]
            column = np.arange(n - 1)
            parts = np.take_along_axis(parts, column + (column > at[:, None]), 1)  # part at+1 goes
            ranks = np.take_along_axis(ranks, column[:-1] + (column[:-1] >= at[:, None]), 1)  # the merged pair's rank goes
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < n - 2))
                ranks[ok, side[ok]] = self._adjacent(parts[ok, side[ok]], parts[ok, side[ok] + 1])

    def _long(self, word: bytes) -> bytes:
        """The ids of one long word: the same merges, minimum by heap."""
        ids = self.of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, rank_of, merged = len(ids), self.rank_of, self.merged
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = int(merged[r]), False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0 and y < n and (s := rank_of.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[y]))
        return np.array([x for x, ok in zip(ids, alive) if ok], "<u4").tobytes()

    def _learn_words(self, wanted: set[bytes]) -> dict[bytes, bytes]:
        """A map that holds the ids of all ``wanted`` words."""
        kept = self.words.settle()
        by_length: dict[int, list[bytes]] = {}
        for word in self.words.unknown({w for w in wanted if w not in kept}):
            by_length.setdefault(len(word), []).append(word)
        for length, words in by_length.items():
            if length > SHORT:
                kept.update((w, self._long(w)) for w in words)
            else:
                for begin in range(0, len(words), ROWS):
                    kept.update(self._rows(words[begin : begin + ROWS], length))
        return kept

    def encode_words(self, texts: list[str]) -> list[bytes]:
        """The ids of each text without special tokens, by its words."""
        split = [[w.encode() for w in self.split_words(x)] for x in texts]
        known = self._learn_words(set().union(*split))
        out = [b"".join([known[w] for w in words]) for words in split]
        for words in split:
            for w in words:
                if len(w) > KEPT_LENGTH:
                    known.pop(w, None)
        return out

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit bytes."""
        whole: list[tuple[int, bytes]] = []  # (text, piece or special token) that are encoded as they are
        split: dict[int, list[bytes]] = {}
        wanted: set[bytes] = set()
        known = self.stretches.settle()
        for i, text in enumerate(texts):
            if self.split_special and self.split_special.search(text):
                end = 0
                for m in self.split_special.finditer(text):
                    whole += [(i, text[end : m.start()]), (i, m[0])]
                    end = m.end()
                whole.append((i, text[end:]))
            elif _RUN.search(text) and _RUN_FULL.search(text):
                whole.append((i, text))
            else:
                first, *rest = text.split(b" ")
                whole.append((i, first))
                split[i] = rest
                wanted.update(w for w in rest if w not in known)
        missing = self.stretches.unknown(wanted)
        new = dict(zip(missing, self.encode_words([f" {x.decode()}" for x in missing]), strict=True))
        known.update(new)
        out: list[list[bytes]] = [[] for _ in texts]
        plain = self.encode_words([x.decode() for _, x in whole if x not in self.special])
        ids = iter(plain)
        for i, x in whole:
            out[i].append(np.array([self.special[x]], "<u4").tobytes() if x in self.special else next(ids))
        for i, rest in split.items():
            out[i] += map(known.__getitem__, rest)
        for stretch in new:
            if len(stretch) > KEPT_LENGTH:
                del known[stretch]
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        """The text of some ids in UTF-8, special tokens included."""
        joined = b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return joined.decode("utf-8", "replace").encode()


def rank_bpe(path: str) -> RankBPE:
    """One encoder per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = RankBPE(path)
    return _loaded[path]


def encode_texts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: doc_id, ids (little-endian unsigned 32-bit), decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = rank_bpe(tokenizer_path)
        for batch in batches:
            for part in chunks(batch):
                ids = bpe.encode(text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array([bpe.decode(x).decode() for x in ids], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, decoded string")
