"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a run of words, line breaks or not, since statements are wrapped anywhere: from any template word on, as many words as the
template has divided by ``THRESHOLD``. Its set is its distinct words. A block matches a template when it holds at least ``THRESHOLD`` of the
template's distinct words; words scattered over a longer line or text are no block and match nothing.

The join is exact: template words are ordered by ascending frequency over all
documents (counted over all of them first); a match must hold one of the first |T| - need + 1 words of a template (prefix filter),
must have need words at all (length filter), and at the first common word enough words must be left on both sides
(positional filter); what passes is counted in full. A text's words as a whole pass these filters first, for no block holds more.
Of runs that overlap, the last of the best counts; a match is shown with the line where its run begins, once for each template and
line, with the highest containment. The templates are a fixed table, so its broadcast is bounded.

Defined results: null texts are empty and have no words, no labels and score 0; null and repeated ids keep a row each;
empty tables give empty results; other columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_bytes

THRESHOLD = 0.9

# Phrases that name a license, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License texts and statements as their publishers word them, with their labels.
TEMPLATES = {
    "mit-grant": ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    "mit-text": (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mit-release": ("mit", "released under the mit license"),
    "as-is-disclaimer": (
        "permissive",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
    ),
    "apache-header": ("apache", "licensed under the apache license version 2 0"),
    "apache-notice": (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    ),
    "apache-warranty": ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    "gpl-grant": ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    "gpl-warranty": (
        "gpl",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details",
    ),
    "gpl-work": ("gpl", "this work is licensed under the gnu general public license"),
    "lgpl": ("lgpl", "licensed under the gnu lesser general public license"),
    "lgpl-grant": ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    "agpl": ("agpl", "licensed under the gnu affero general public license"),
    "agpl-grant": ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    "bsd": ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    "bsd-text": (
        "bsd",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "bsd-endorsement": ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    "isc": ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    "isc-text": (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "zlib": ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    "boost": (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software",
    ),
    "mpl": ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    "mpl-copy": ("mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    "cc-by-nc": ("cc-by-nc", "licensed under cc by nc"),
    "cc-by-sa": ("cc-by-sa", "licensed under cc by sa"),
    "cc-by-work": ("cc-by", "this work is licensed under a creative commons attribution international license"),
    "cc0": ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    "unlicense": ("unlicense", "this is free and unencumbered software released into the public domain"),
    "unlicense-text": (
        "unlicense",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
}

#: Bytes that belong to words: digits, letters (A-Z as a-z), all of what is not ASCII; line feed stays, the rest is a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 or b == 10 else 32 for b in range(256))


def fold(text: bytes) -> bytes:
    return text.translate(_TABLE)


def phrase_places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Word numbers at which the phrase stands."""
    out, at, n = [], -1, len(phrase)
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """In how many documents each template word stands; as many rows as the fixed vocabulary has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = dict.fromkeys(sorted(vocabulary), 0)
        for batch in batches:
            for part in chunks(batch):
                for text in text_bytes(part.column("text")):
                    for w in vocabulary.intersection(fold(text).split()):
                        counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["word"]): r["n"] for r in rows}


class TemplateIndex:
    """Templates under a global order of words, for containment search."""

    def __init__(self, templates: dict[str, tuple[str, str]], frequencies: dict[bytes, int], threshold: float = THRESHOLD):
        texts = {name: frozenset(x.encode() for x in text.split()) for name, (_, text) in templates.items()}
        self.labels = {name: label for name, (label, _) in templates.items()}
        everything = sorted(frozenset().union(*texts.values()), key=lambda w: (frequencies.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(everything)}
        self.sorted = {name: sorted(t, key=self.rank.__getitem__) for name, t in texts.items()}
        self.sets, self.need = texts, {name: -(-round(1000 * threshold) * len(t) // 1000) for name, t in texts.items()}
        self.run = {name: -(-1000 * len(text.split()) // round(1000 * threshold)) for name, (_, text) in templates.items()}
        self.prefix: dict[bytes, list[tuple[str, int]]] = {}
        for name, words in self.sorted.items():
            for i, w in enumerate(words[: len(words) - self.need[name] + 1]):
                self.prefix.setdefault(w, []).append((name, i))
        self.probes = frozenset(self.prefix)

    def matches(self, block: list[bytes]) -> dict[str, float]:
        """Template -> containment of the templates that the block meets."""
        mine = sorted((w for w in set(block) if w in self.rank), key=self.rank.__getitem__)
        out: dict[str, float] = {}
        seen: set[str] = set()
        for j, w in enumerate(mine):
            for name, i in self.prefix.get(w, ()):
                need, size = self.need[name], len(self.sorted[name])
                if name in seen or len(mine) < need:
                    continue
                seen.add(name)  # the first common word: all others come later on both sides
                if 1 + min(size - i - 1, len(mine) - j - 1) < need:
                    continue
                common = len(self.sets[name].intersection(mine))
                if common >= need:
                    out[name] = common / size
        return out

    def runs(self, words: list[bytes], name: str) -> list[tuple[int, float]]:
        """First word and containment of the runs that match a template; of those that overlap, the last of the best."""
        mine, need, width = self.sets[name], self.need[name], self.run[name]
        places = [i for i, w in enumerate(words) if w in mine]
        held: dict[bytes, int] = {}
        out: list[tuple[int, float]] = []
        reach = end = 0
        for at in places:
            while end < len(places) and places[end] < at + width:
                held[words[places[end]]] = held.get(words[places[end]], 0) + 1
                end += 1
            if len(held) >= need:
                found = (at, len(held) / len(mine))
                if at >= reach:
                    out.append(found)
                elif found[1] >= out[-1][1]:
                    out[-1] = found
                reach = at + width
            held[words[at]] -= 1
            if not held[words[at]]:
                del held[words[at]]
        return out

    def blocks(self, flat: bytes) -> list[tuple[int, str, float]]:
        """(line, template, containment) of the runs of a folded text that match."""
        words = flat.split()
        if self.probes.isdisjoint(words) or not (near := self.matches(words)):
            return []
        begins = [0, *accumulate(len(x.split()) for x in flat.split(b"\n"))]
        out: dict[tuple[int, str], float] = {}
        for name in near:
            for at, share in self.runs(words, name):
                place = bisect_right(begins, at) - 1, name
                out[place] = max(share, out.get(place, 0.0))
        return sorted((line, name, share) for (line, name), share in out.items())


_RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:int,template:string,containment:double>>"


def scan_licenses(docs: DataFrame, templates: dict[str, tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks (the matches)."""
    vocabulary = frozenset(w.encode() for _, text in templates.values() for w in text.split())
    index = TemplateIndex(templates, word_frequencies(docs, vocabulary), threshold)
    phrases = [(p.encode().split(), label) for p, label in PHRASES.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = re.findall(r"(\w+) (?:long|string|double|array)", _RESULT)
        block_type = pa.list_(pa.struct([("line", pa.int32()), ("template", pa.string()), ("containment", pa.float64())]))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), block_type]
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for doc, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text"))):
                    flat = fold(text)
                    words = flat.split()
                    places, base = [], set()
                    if b"license" in flat:
                        for phrase, label in phrases:
                            if at := phrase_places(words, phrase):
                                places += at
                                base.add(label)
                    blocks = index.blocks(flat)
                    labels = base | {index.labels[name] for _, name, _ in blocks}
                    score = max([1.0 if base else 0.0, *(c for _, _, c in blocks)])
                    rows.append((doc, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [dict(zip(("line", "template", "containment"), b)) for b in blocks]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 9, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(run, _RESULT)
