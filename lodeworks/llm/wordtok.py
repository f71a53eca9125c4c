"""Whole-text encoding with the tokenizers library at the price of one encoding per distinct word.

The tokenizer of a word-end vocabulary drops white space and never forms a token across it, and its normaliser (NFC,
white-space folding, per-character lower case) works on each space-free stretch alone. So a text's ids are the ids of its
stretches, one after the other. Stretches are encoded by the library once and kept in a bounded two-generation cache.

A stretch of Latin letters with or without punctuation behind it goes straight to the library's model, since normaliser
and word splitter do nothing to it but lower its case and part the two; every other stretch passes through all of the
library.
"""

from __future__ import annotations

import json
import os
import re
from itertools import filterfalse

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import WhitespaceSplit

#: Entries in each cache generation and the longest string that is kept; beyond either, the library encodes again.
GENERATION, KEPT_LENGTH = 250_000, 48

#: A line of Latin letters, then ASCII punctuation; or else any line.
_LINES = re.compile(r"^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)|.*)$", re.MULTILINE)
#: ASCII punctuation.
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_loaded: dict[str, "WordEncoder"] = {}


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for
    themselves, the others for the characters from U+0100 on, in ascending order."""
    own = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: A mark that ends a stretch behind an ASCII letter or digit, a word of its own.
_TAIL = re.compile(rb"[,.;:!?](?<=[A-Za-z0-9].)(?![^\x20\x09-\x0D])", re.DOTALL)


def _spread(text: bytes) -> bytes:
    """A text of equal ids with fewer different stretches: ASCII letters in lower case and marks at the end of words apart.

    Letters stay as they are in a text with combining marks, since some compose with a small letter only, or with what may be a special token.
    """
    if b"<|" not in text and b"\xcc" not in text and b"\xcd" not in text:
        text = text.lower()
    return _TAIL.sub(rb" \g<0>", text)


# Normaliser steps and word pattern of the vocabulary files that this module reads.
NORMALISER = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _check(spec: dict, path: str) -> None:
    """Refuse a file that does not work as this module takes for granted."""
    normaliser = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    splitter = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pattern = splitter[0].get("pattern", {}).get("Regex") if splitter else None
    bytes_after = [x["type"] for x in splitter[1:]] == ["ByteLevel"] and not splitter[1]["add_prefix_space"] and not splitter[1]["use_regex"]
    model = spec["model"]
    if (model["type"], model.get("end_of_word_suffix"), normaliser, pattern, bytes_after) != ("BPE", "</w>", NORMALISER, WORDS, True):
        raise ValueError(f"{path} is no lower-case word-end vocabulary: {normaliser}, {pattern}")


class Generations:
    """A bounded map: what the last two generations of lookups did not touch is forgotten."""

    def __init__(self, entries: int):
        self.entries, self.young, self.old = entries, {}, {}

    def settle(self) -> dict:
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young
        return self.young

    def unknown(self, wanted: set) -> list:
        """Those of ``wanted``, none of them young, that are in neither generation; the others become young."""
        young, missing = self.young, []
        for key, value in zip(wanted, map(self.old.get, wanted)):
            if value is None:
                missing.append(key)
            else:
                young[key] = value
        return missing


class WordEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            _check(json.load(f), path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = byte_alphabet()
        self.as_bytes = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.words = Tokenizer(self.tokenizer.model)  # the same merges for words that are parted and lower case already
        self.words.pre_tokenizer = WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = len(vocabulary)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stretches, self.parts = Generations(GENERATION), Generations(GENERATION)

    def _learn_parts(self, parts: list[bytes]) -> None:
        """A word's last token is its only one with a word end, which shows where the next word begins."""
        kept = self.parts.young
        for begin in range(0, len(parts), 4000):
            some = parts[begin : begin + 4000]
            joined = b" ".join(some)
            joined = joined.decode() if joined.isascii() else joined.decode().translate(self.as_bytes)
            ids = np.array(self.words.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            data, cuts = ids.tobytes(), [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            kept.update(zip(some, [data[x:y] for x, y in zip(cuts, cuts[1:])], strict=True))

    def _learn(self, missing: list[bytes]) -> dict[bytes, bytes]:
        plain, odd, other = [], [], []
        for stretch in missing:
            word = stretch.rstrip(_MARKS)
            if word.isalpha() and len(stretch) <= 200:  # of bytes: ASCII letters
                plain.append((stretch, word.lower(), stretch[len(word) :]))
            else:
                odd.append(stretch)
        for stretch, m in zip(odd, _LINES.finditer(b"\n".join(odd).decode())):
            word, marks = m.groups()
            if word and len(stretch) <= 200:
                plain.append((stretch, word.lower().encode(), marks.encode()))
            else:
                other.append(stretch)
        ids = self.parts.settle()
        parts = {x[1] for x in plain}
        parts.update([x[2] for x in plain if x[2]])
        self._learn_parts(self.parts.unknown({x for x in parts if x not in ids}))
        got = {stretch: ids[a] + ids[b] if b else ids[a] for stretch, a, b in plain}
        for begin in range(0, len(other), 5000):
            some = other[begin : begin + 5000]
            encoded = self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)
            got.update((s, np.array(e.ids, "<u4").tobytes()) for s, e in zip(some, encoded, strict=True))
        return got

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, given and returned as bytes."""
        split = [_spread(x).split() for x in texts]  # at space and the controls from tab to carriage return
        known = self.stretches.settle()
        wanted: set[bytes] = set()
        for words in split:
            wanted.update(filterfalse(known.__contains__, words))
        new = self._learn(missing) if (missing := self.stretches.unknown(wanted)) else {}
        known.update(new)
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for stretch in new:
            if len(stretch) > KEPT_LENGTH:
                del known[stretch]
        return out


def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]
