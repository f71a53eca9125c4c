"""Substring deduplication by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words of a document. Each window has a minimiser, the smallest hash among its runs of ``SEED``
words; consecutive windows with the same minimiser form one super-k-mer. It travels as one packed string (words as numbers into the
string's own dictionary of whole words) to the bucket of its minimiser, so all occurrences of a window meet in one bucket. There windows are
sorted and counted; windows with equal hashes are compared word by word, so the count is exact.

Buckets follow the data. First the words of all super-k-mers of all documents are counted by ``CELLS`` cells of their minimiser; cells
are then laid out over as many buckets as the total asks for, ``LOAD`` words each. A cell over that, as one very common run of words
makes it, is split over several buckets by a second, longer minimiser (``LONG_SEED`` words), which a window's own words decide, too.

Inside a task equal super-k-mers are merged before they travel: only the one with the smallest doc_id of each chunk is sent, and of those that
repeat, ``REMEMBERED`` at most are remembered for the task's further chunks. The others are marked at once, since an earlier document
holds the same windows. A passage that a third of all documents share thus costs a string or few for each task. A bucket sends back
marked word ranges, which meet their documents by (doc_id, text hash).

Defined results: a null text has no words; a null id counts as larger than any other; windows never remove windows of
rows with the same id, so rows that repeat an id stand or fall alike; documents under ``WINDOW`` words keep all; an empty
table gives an empty result; ``remove_repeats`` carries all other columns along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, shuffle_partitions, text_bytes
from .words import mixed, numbered, window_hashes, window_starts

WINDOW, SEED, LONG_SEED = 13, 4, 8
#: Text bytes that a task splits at a time; counted cells; words of a bucket; merged super-k-mers that a task remembers.
SPLIT_BYTES, CELLS, LOAD, REMEMBERED = 10 << 20, 1 << 16, 3 << 19, 20_000
LAST = 2**63 - 1  # stands for a null id
#: Tasks that buckets are dealt to at most; a task takes its buckets one after the other, so memory does not follow their number.
MOST_TASKS = 1 << 16
_PACKED = "bucket int, marks boolean, data binary"
_MARK = np.dtype([("doc", "<i8"), ("key", "<i8"), ("begin", "<i4"), ("end", "<i4")])
_MULTIPLIER = 0x9E3779B97F4A7C15


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= n:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - span : n - span + len(x) - n + 1]) if span < n else out


def _ranges(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """begin, begin+1, ... of each range, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def super_kmers(values: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer of texts given by word hashes."""
    starts = window_starts(begins, WINDOW)
    if not len(starts):
        return starts, starts, np.empty(0, np.uint64)
    least = _sliding_min(window_hashes(values, SEED), WINDOW - SEED + 1)[starts]
    fresh = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return starts[fresh], np.diff(np.append(fresh, len(starts))), least[fresh]


def cell_of(least: np.ndarray) -> np.ndarray:
    return (mixed(least) % np.uint64(CELLS)).astype(np.int64)


def _loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> words of their super-k-mers by cell, a row for each cell that the task meets."""
    total = np.zeros(CELLS, np.int64)
    for batch in batches:
        for part in chunks(batch, limit=SPLIT_BYTES):
            found = numbered(text_bytes(part.column("text")))
            _, windows, least = super_kmers(found.values, found.begins)
            total += np.bincount(cell_of(least), windows + WINDOW - 1, CELLS).astype(np.int64)
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], ["cell", "load"])


@dataclass(frozen=True)
class Layout:
    """A cell's first bucket, and over how many buckets it is split."""

    base: np.ndarray
    splits: np.ndarray
    buckets: int


def layout(load: np.ndarray, least_buckets: int, most: int = 0) -> Layout:
    """Cells in their order over buckets of ``most`` words (LOAD), or fewer where that would make less than ``least_buckets``."""
    limit = max(1, min(most or LOAD, -(-int(load.sum()) // least_buckets)))
    heavy = load > limit
    before = np.cumsum(np.where(heavy, 0, load)) - np.where(heavy, 0, load)
    base, splits = before // limit, np.where(heavy, -(-load // limit), 1)
    light = int(base.max()) + 1
    own = np.where(heavy, splits, 0)
    base = np.where(heavy, light + np.cumsum(own) - own, base)
    return Layout(base.astype(np.int32), splits.astype(np.int32), light + int(own.sum()))


def placed_kmers(values: np.ndarray, begins: np.ndarray, plan: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and bucket of each super-k-mer; those of split cells are parted by their longer minimiser."""
    first, windows, least = super_kmers(values, begins)
    if not len(first):
        return first, windows, np.empty(0, np.int64)
    cell = cell_of(least)
    bucket = plan.base[cell].astype(np.int64)
    heavy = plan.splits[cell] > 1
    if not heavy.any():
        return first, windows, bucket
    starts = _ranges(first[heavy], windows[heavy])
    owner = np.repeat(np.flatnonzero(heavy), windows[heavy])
    longer = _sliding_min(window_hashes(values, LONG_SEED), WINDOW - LONG_SEED + 1)[starts]
    fresh = np.flatnonzero(np.concatenate([[True], (longer[1:] != longer[:-1]) | (owner[1:] != owner[:-1])]))
    split = bucket[owner[fresh]] + (mixed(longer[fresh]) % plan.splits[cell[owner[fresh]]].astype(np.uint64)).astype(np.int64)
    first = np.concatenate([first[~heavy], starts[fresh]])
    windows = np.concatenate([windows[~heavy], np.diff(np.append(fresh, len(starts)))])
    bucket = np.concatenate([bucket[~heavy], split])
    order = np.argsort(first, kind="stable")
    return first[order], windows[order], bucket[order]


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, then their second ones, and so on, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _pack(words: list[bytes], ids: np.ndarray, doc: np.ndarray, key: np.ndarray, place: np.ndarray, windows: np.ndarray) -> bytes:
    """Super-k-mers as one string: their documents, places and window counts, word numbers (frequent words first), and the dictionary."""
    used, local, count = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-count, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    parts = [
        np.array([len(doc), len(ids), len(used)], "<i8").tobytes(),
        _planes(doc.astype("<i8")),
        _planes(key.astype("<i8")),
        _planes(place.astype("<i4")),
        _planes(windows.astype("<i4")),
        _planes(rank[local].astype("<u2" if len(used) <= 65536 else "<u4")),
        b" ".join([words[i] for i in used[order].tolist()]),
    ]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def _unpack(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, n_ids, n_words = np.frombuffer(raw, "<i8", 3).tolist()
    at, out = 24, []
    for kind, count in (("<i8", n), ("<i8", n), ("<i4", n), ("<i4", n), ("<u2" if n_words <= 65536 else "<u4", n_ids)):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, width * count, at).reshape(width, count)
        out.append(np.ascontiguousarray(planes.T).view(kind).ravel())
        at += width * count
    return raw[at:].split(b" "), out[4], *out[:4]


def _marks(doc: np.ndarray, key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    out = np.empty(len(doc), _MARK)
    out["doc"], out["key"], out["begin"], out["end"] = doc, key, begin, end
    return zstandard.ZstdCompressor(level=1).compress(out.tobytes())


def _merged(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching ranges of one text as one; ranges come in order."""
    if not len(text):
        return text, begin, end
    fresh = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (begin[1:] > end[:-1])]))
    return text[fresh], begin[fresh], end[np.append(fresh[1:], len(text)) - 1]


def _rows(rows: list[tuple[int, bool, bytes]]) -> pa.RecordBatch:
    bucket, marks, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(marks), pa.array(data, pa.binary())], ["bucket", "marks", "data"])


def _digests(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each range of words, from prefix sums of a polynomial with an invertible base."""
    base, inverse = np.uint64(_MULTIPLIER), np.uint64(pow(_MULTIPLIER, -1, 2**64))
    up, down = np.full(len(values), base), np.full(len(values), inverse)
    up[:1], down[:1] = 1, 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(values) * np.cumprod(up))])
    return mixed((sums[first + size] - sums[first]) * np.cumprod(down)[first] + size.astype(np.uint64))


def _equal(ids: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the words of two ranges of one size agree, one by one."""
    if not len(a):
        return np.zeros(0, bool)
    differ = ids[_ranges(a, size)] != ids[_ranges(b, size)]
    return ~np.logical_or.reduceat(differ, np.cumsum(size) - size)


class _Remembered:
    """Super-k-mers that a task has merged: their digest, words and smallest doc_id."""

    def __init__(self):
        self.held: dict[int, tuple[int, bytes]] = {}
        self.digests = np.empty(0, np.uint64)

    def later(self, found, digest: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the super-k-mers ``at`` a smaller doc_id of a former chunk holds; of others that are remembered, the smaller id stays."""
        known = at[np.isin(digest[at], self.digests)] if len(self.digests) else at[:0]
        out = np.zeros(len(known), bool)
        for i, k in enumerate(known.tolist()):
            held, words = self.held[int(digest[k])]
            if words == self.words(found, first[k], size[k]):
                out[i] = held < doc[k]
                if doc[k] < held:
                    self.held[int(digest[k])] = int(doc[k]), words
        return known[out]

    def add(self, found, digest: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, at: np.ndarray) -> None:
        if len(self.held) + len(at) > REMEMBERED:
            self.held = {}
        for k in at[:REMEMBERED].tolist():
            self.held.setdefault(int(digest[k]), (int(doc[k]), self.words(found, first[k], size[k])))
        self.digests = np.fromiter(self.held, np.uint64, len(self.held))

    @staticmethod
    def words(found, first: int, size: int) -> bytes:
        return b" ".join([found.words[i] for i in found.ids[first : first + size].tolist()])


def _split(held):
    """Documents (doc_id, key, text) -> packed super-k-mers by bucket, and the marks that a task finds alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, remembered = held.value, _Remembered()
        for batch in batches:
            for part in chunks(batch, limit=SPLIT_BYTES):
                found = numbered(text_bytes(part.column("text")))
                values, begins = found.values, found.begins
                first, windows, bucket = placed_kmers(values, begins, plan)
                if not len(first):
                    continue
                size = windows + WINDOW - 1
                text = np.searchsorted(begins, first, side="right") - 1
                place = first - begins[text]
                doc = np.array([LAST if x is None else x for x in part.column("doc_id").to_pylist()], np.int64)[text]
                key = np.array(part.column("key").to_pylist(), np.int64)[text]
                digest = _digests(values, first, size)
                order = np.lexsort((doc, digest))
                fresh = np.concatenate([[True], digest[order][1:] != digest[order][:-1]])
                leader = np.empty_like(order)
                leader[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]  # of equal digests, one with the smallest id
                late = np.flatnonzero((doc > doc[leader]) & (size == size[leader]))
                late = late[_equal(found.ids, first[late], first[leader[late]], size[late])]
                stays = np.ones(len(first), bool)
                stays[late] = False
                stays[remembered.later(found, digest, first, size, doc, np.flatnonzero(stays))] = False
                remembered.add(found, digest, first, size, doc, np.unique(leader[late]))
                late = np.flatnonzero(~stays)
                if len(late):  # in the order of the texts
                    t, a, b = _merged(text[late], place[late], (place + size)[late])
                    lead = np.searchsorted(text, t)  # any super-k-mer of the text
                    yield _rows([(int(bucket[0]), True, _marks(doc[lead], key[lead], a, b))])
                go = np.flatnonzero(stays)
                by = np.argsort(bucket[go], kind="stable")
                own = bucket[go][by]
                cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else []
                for x, y in zip(list(cuts), [*cuts[1:], len(by)]):
                    some = go[by[x:y]]
                    taken = found.ids[_ranges(first[some], size[some])]
                    yield _rows([(int(own[x]), False, _pack(found.words, taken, doc[some], key[some], place[some], windows[some]))])

    return run


def _groups(ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows (positions ``at``) that occur twice or more, and a number for each distinct one of them; exact."""
    keys = window_hashes(mixed(ids.astype(np.uint64) + np.uint64(1)), WINDOW)[at]
    order = np.argsort(keys, kind="stable")
    fresh = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    number = np.cumsum(fresh) - 1
    often = np.flatnonzero(np.bincount(number)[number] > 1)
    member, number, head = order[often], number[often], order[np.flatnonzero(fresh)][number[often]]
    column = np.arange(WINDOW)
    differ = np.zeros(len(member), bool)
    for c in column:
        differ |= ids[at[member] + c] != ids[at[head] + c]
    if differ.any():  # one hash for different windows: tell those groups apart by their words
        mixed_up = np.isin(number, number[differ])
        _, exact = np.unique(ids[at[member[mixed_up]][:, None] + column], axis=0, return_inverse=True)
        number[mixed_up] = number.max() + 1 + exact.ravel()
    return member, number


def _count(table: pa.Table) -> pa.Table:
    """One bucket: the word ranges of its super-k-mers whose windows an earlier document holds."""
    number: dict[bytes, int] = {}
    out, ids, doc, key, place, windows = [], [], [], [], [], []
    for marks, data in zip(table.column("marks").to_pylist(), table.column("data")):
        if marks:
            out.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(data.as_py()), _MARK))
            continue
        words, local, *rest = _unpack(data.as_py())
        ids.append(np.array([number.setdefault(w, len(number)) for w in words], np.int64)[local])
        for column, x in zip((doc, key, place, windows), rest, strict=True):
            column.append(x)
    if ids:
        ids, doc, key, place, windows = map(np.concatenate, (ids, doc, key, place, windows))
        size = windows.astype(np.int64) + WINDOW - 1
        kmer = np.repeat(np.arange(len(doc)), windows)
        offset = _ranges(np.zeros(len(doc), np.int64), windows.astype(np.int64))
        at = (np.cumsum(size) - size)[kmer] + offset
        member, group = _groups(ids, at)
        least = np.full(group.max() + 1 if len(group) else 0, LAST)
        np.minimum.at(least, group, doc[kmer[member]])
        hit = np.sort(member[doc[kmer[member]] > least[group]])
        own, a, b = _merged(kmer[hit], (place[kmer] + offset)[hit], (place[kmer] + offset)[hit] + WINDOW)
        found = np.empty(len(own), _MARK)
        found["doc"], found["key"], found["begin"], found["end"] = doc[own], key[own], a, b
        out.append(found)
    every = np.concatenate(out) if out else np.empty(0, _MARK)
    return pa.table({"doc": every["doc"], "key": every["key"], "span": (every["begin"].astype(np.int64) << 32) | every["end"]})


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc (null id as LAST), key (hash of the text) and spans, an array of begin << 32 | end in words, for each document that
    holds windows of a document with a smaller id."""
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    loads = docs.select("text").mapInArrow(_loads, "cell int, load long").groupBy("cell").agg(F.sum("load").alias("load")).toArrow()  # CELLS rows at most
    load = np.zeros(CELLS, np.int64)
    load[loads.column("cell").to_numpy()] = loads.column("load").to_numpy()
    plan = layout(load, 2 * parts)
    packed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(_split(spark.sparkContext.broadcast(plan)), _PACKED)
    # a task for each bucket, not by hash, which would bring several together by chance
    dealt = packed.repartitionById(plan.buckets, "bucket") if plan.buckets <= MOST_TASKS else packed.repartition(MOST_TASKS, "bucket")
    marks = dealt.groupBy("bucket").applyInArrow(_count, "doc long, key long, span long")
    return marks.groupBy("doc", "key").agg(F.collect_list("span").alias("spans"))  # as many as a document has super-k-mers


def strip_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the words left in ``text``, joined by one space, and with n_words and n_removed (in place of columns of that name)."""
    names = [c for c in docs.columns if c not in ("text", "n_words", "n_removed")]
    columns = [f"_{i}" for i in range(len(names))]  # columns may be named like the operator's own
    spans = materialize(repeated_spans(docs), "spans")  # the super-k-mers' shuffle files can go before texts are shuffled
    picked = docs.select(*(F.col(c).alias(x) for c, x in zip(names, columns)), "text")
    keyed = picked.withColumns({"_doc": F.coalesce(F.col(columns[names.index("doc_id")]), F.lit(LAST)), "_key": F.xxhash64("text")})
    joined = keyed.join(spans, (F.col("_doc") == F.col("doc")) & (F.col("_key") == F.col("key")), "left")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts, totals, removed = [], [], []
                for text, own in zip(text_bytes(part.column("text")), part.column("spans").to_pylist()):
                    words = text.split()
                    gone = 0
                    if own:
                        keep = np.ones(len(words), np.uint8)
                        for s in own:
                            keep[s >> 32 : s & 0xFFFFFFFF] = 0
                        gone = len(words) - int(keep.sum())
                        kept = compress(words, keep.tolist())
                    else:
                        kept = words
                    texts.append(b" ".join(kept).decode())
                    totals.append(len(words))
                    removed.append(gone)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64())],
                    [*columns, "text", "n_words", "n_removed"],
                )

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"{x} {kinds[c]}" for c, x in zip(names, columns)), "text string", "n_words long", "n_removed long"])
    out = joined.select(*columns, "text", "spans").mapInArrow(strip, schema)
    return out.select(*(F.col(x).alias(c) for c, x in zip(names, columns)), "text", "n_words", "n_removed")
