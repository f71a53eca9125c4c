"""Exact n-gram Jaccard self-join with skipping by set relations.

A document's set is its distinct lower-case ``NGRAM``-word shingles as 64-bit hashes; documents link when their sets' Jaccard
similarity is at least ``SIMILARITY`` percent.

1. *Classes.* Documents with equal sets form one class (two independent 64-bit sums of the set's hashes); only classes go on.
2. *Order.* Any global order of shingles is exact for a prefix filter; rare first is fast. Shingles are counted over all documents
   (packed, by bucket of their hash), and the most frequent ``FREQUENT`` of them at most are ordered behind all others.
3. *Index lists.* A class sends its prefix, |x| - ceil(t|x|) + 1 shingles, to the index. A list is ordered by size and cut into blocks;
   the positional filter skips whole blocks by their sizes and largest rests, and an entry without a partner leaves the list. Of
   what remains, the entry with the smallest key leads, and each other is paired with its leader only: two sets that may link
   have a common leader, so a list of n entries makes n-1 pairs, never n*n. A group that lies in another leader's group is left out.
4. *Answers.* A leader's overlaps with all its members are computed in full. They answer most of the rest: members that link with
   the leader are one component already, and for two members S, T with overlaps s, t with the leader, |S & T| is at most
   min(s, t) + min(|S| - s, |T| - t); pairs below the bound are skipped without looking at the sets, the others counted.
   A leader with more than ``BLOCK`` members is dealt out in blocks that each hold the leader. Members that a block connects with
   the leader need no other block. The others, if few (``FEW`` for each member of a block), visit all blocks, which is linear in the group.
   If they are many, the group is an accident of a common shingle, and it is indexed again by its next common shingle: two sets that
   link share d + 1 shingles within prefixes longer by d, so lists under (first, ..., next common shingle) hold all pairs, and
   each is far shorter. After ``DEPTH`` such steps whatever is left visits block by block, in tasks of two blocks; only sets
   that share as many rare shingles without linking, by the thousand, get there.
5. *Components* of the links by alternating stars.

Defined results: null or word-less texts have empty sets, link with nothing and are their own component; with fewer words than ``NGRAM``
the whole sequence is the one shingle; a null id counts as larger than any other and is shown as null; rows that repeat an id with
different texts share whatever either links to; an empty table gives an empty result. ``one_of_each`` goes by texts, not by ids: one
row of each component of classes stays, the one with the smallest id (null last) and then the smallest text hash, with all its
columns; rows without words all stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialize, shuffle_partitions, text_bytes, text_total
from .graph import components
from .words import mixed, numbered, window_hashes, window_starts

NGRAM, SIMILARITY = 4, 85
#: Text bytes a task takes at a time; shingles ordered by frequency at most; from which document frequency; list blocks; group blocks.
SPLIT_BYTES, FREQUENT, RARE, LIST_BLOCK, BLOCK = 8 << 20, 1 << 20, 8, 64, 128
#: Visitors for each member of a block at most before a group is indexed again; how often; text bytes for each bucket of an index; parts of a leader's pairs.
FEW, DEPTH, BUCKET_BYTES, SALTS = 16, 3, 32 << 20, 16
LAST = 2**63 - 1
#: Tasks that buckets are dealt to at most.
MOST_TASKS = 1 << 16
#: Columns that documents do not have.
_DOC, _HASH = "__lodeworks_doc", "__lodeworks_hash"
_SCAN = "doc long, hash long, n long, d1 long, d2 long, bucket int, data binary"
_POST = np.dtype([("token", "<u8"), ("key", "<i8"), ("size", "<i4"), ("pos", "<i4")])


def needed(x, y):
    """Common shingles that two sets of these sizes must have: the least o with 100 o >= t (x + y - o)."""
    return -(-SIMILARITY * (x + y) // (100 + SIMILARITY))


def _compress(x: np.ndarray) -> bytes:
    """Byte planes of an array, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _restore(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of some texts, each in ascending order, and where each begins (with the end)."""
    found = numbered([x.lower() for x in texts])
    values, begins = found.values, found.begins
    starts = window_starts(begins, NGRAM)
    tokens = window_hashes(values, NGRAM)[starts] if len(starts) else np.empty(0, np.uint64)
    text = np.searchsorted(begins, starts, side="right") - 1
    counts = np.bincount(text, minlength=len(texts))
    length = np.diff(begins)
    short = np.flatnonzero((length > 0) & (length < NGRAM))
    if len(short):
        whole = np.array([window_hashes(values[begins[i] : begins[i + 1]], int(length[i]))[0] + np.uint64(length[i]) for i in short], np.uint64)
        at = np.concatenate([[0], np.cumsum(counts)])[short]
        tokens, text = np.insert(tokens, at, mixed(whole)), np.insert(text, at, short)
        counts[short] = 1
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        tokens[a:b].sort()
    fresh = np.ones(len(tokens), bool)
    fresh[1:] = (tokens[1:] != tokens[:-1]) | (text[1:] != text[:-1])
    begins = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(text[fresh], minlength=len(texts)), out=begins[1:])
    return tokens[fresh], begins


def _sums(values: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Wrapping sum of each range; 0 for an empty one."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return (total[begins[1:]] - total[begins[:-1]]).view(np.int64)


def signatures(tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set."""
    return _sums(mixed(tokens * np.uint64(0xC2B2AE3D27D4EB4F)), begins), _sums(mixed(tokens ^ np.uint64(0x165667B19E3779F9)), begins)


def _scan(buckets: int):
    """Documents -> a row of signatures each, and the high halves of all their shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
        names = ["doc", "hash", "n", "d1", "d2", "bucket", "data"]
        for batch in batches:
            for part in chunks(batch, limit=SPLIT_BYTES):
                docs, hashes = part.column("doc").to_pylist(), part.column("hash").to_pylist()
                tokens, begins = shingle_sets(text_bytes(part.column("text")))
                d1, d2 = signatures(tokens, begins)
                none = [None] * len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((docs, hashes, np.diff(begins), d1, d2, none, none), kinds)], names)
                high = np.sort((tokens >> np.uint64(32)).astype(np.uint32))
                cuts = np.searchsorted(high, np.arange(buckets + 1) * (2**32 / buckets))
                rows = [(None, None, None, None, None, b, _compress(np.diff(high[x:y], prepend=np.uint32(0)))) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """One bucket: its shingles of RARE documents or more and their counts, as arrays."""
    deltas = [_restore(x.as_py(), np.dtype("<u4")) for x in table.column("data")]
    values, counts = np.unique(np.concatenate([np.cumsum(x, dtype=np.uint32) for x in deltas]), return_counts=True)
    often = counts >= RARE
    counts = np.minimum(counts[often], 2**32 - 1).astype("<u4")
    histogram = np.bincount(np.log2(counts).astype(int), minlength=33) if len(counts) else np.zeros(33, int)
    return pa.table({"tokens": [values[often].astype("<u4").tobytes()], "counts": [counts.tobytes()], "histogram": [histogram.tolist()]})


def frequent_shingles(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles' high halves in ascending order, FREQUENT at most, and their document frequencies."""
    found = scan.where("bucket IS NOT NULL").select("bucket", "data").groupBy("bucket").applyInArrow(_frequencies, "tokens binary, counts binary, histogram array<long>")
    found = materialize(found, "frequencies")
    levels = found.select(F.posexplode("histogram")).groupBy("pos").sum("col").collect()
    total, least = 0, 33
    for level, n in sorted(((r[0], r[1]) for r in levels), reverse=True):
        if total + n > FREQUENT:
            break
        total, least = total + n, level

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [[], []]
            for t, c in zip(batch.column("tokens").to_pylist(), batch.column("counts").to_pylist()):
                counts = np.frombuffer(c, "<u4")
                often = counts >= 2**least
                kept[0].append(np.frombuffer(t, "<u4")[often].tobytes())
                kept[1].append(counts[often].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in kept], ["tokens", "counts"])

    rows = found.select("tokens", "counts").mapInArrow(pick, "tokens binary, counts binary").collect()  # FREQUENT entries at most
    tokens, counts = (np.frombuffer(b"".join(bytes(r[c]) for r in rows), "<u4") for c in ("tokens", "counts"))
    order = np.argsort(tokens)
    return tokens[order], counts[order]


def _prefixes(tokens: np.ndarray, begins: np.ndarray, frequent: np.ndarray, counts: np.ndarray, longer: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix shingles in the global order, ``longer`` more than one common shingle needs: which set, the shingle, its position in the set's order."""
    weight = np.zeros(len(tokens), np.uint32)
    if len(frequent):
        high = (tokens >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(frequent, high), len(frequent) - 1)
        weight = np.where(frequent[at] == high, counts[at], 0)
    size = np.diff(begins)
    length = np.where(size > 0, np.minimum(size, size - -(-SIMILARITY * size // 100) + 1 + longer), 0)
    owner, rare = np.repeat(np.arange(len(size)), size), weight == 0
    before = np.cumsum(rare) - rare
    rank = before - np.concatenate([before, [0]])[begins[:-1]].repeat(size)  # among the set's rare shingles
    plain = np.bincount(owner[rare], minlength=len(size))
    take = rare & (rank < length[owner])
    parts = [(owner[take], tokens[take], rank[take])]
    for i in np.flatnonzero(plain < length).tolist():  # the rest of the prefix comes from the frequent ones
        own = np.arange(begins[i], begins[i + 1])[~rare[begins[i] : begins[i + 1]]]
        own = own[np.lexsort((tokens[own], weight[own]))][: length[i] - plain[i]]
        parts.append((np.full(len(own), i), tokens[own], plain[i] + np.arange(len(own))))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _packed(out: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Postings as rows (bucket, data)."""
    bucket = (mixed(out["token"]) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((out["token"], bucket))
    out, bucket = out[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = [(b, _compress(out[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if y > x]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "data"])


def _post(buckets: int, held):
    """Documents -> packed postings by bucket of their shingle; of equal sets in a chunk, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = held.value
        for batch in batches:
            for part in chunks(batch, limit=SPLIT_BYTES):
                tokens, begins = shingle_sets(text_bytes(part.column("text")))
                key, _ = signatures(tokens, begins)
                size = np.diff(begins)
                one = np.zeros(len(key), bool)
                one[np.unique(key, return_index=True)[1]] = True
                owner, token, pos = _prefixes(tokens, begins, frequent, counts)
                go = one[owner]
                out = np.empty(int(go.sum()), _POST)
                out["token"], out["key"], out["size"], out["pos"] = token[go], key[owner[go]], size[owner[go]], pos[go]
                yield _packed(out, buckets)

    return run


def partnered(size: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which entries of an index list, in ascending order of size, pass length and positional filter with some other entry.

    ``rest`` is the number of shingles from the common one on. Blocks whose sizes are too far apart, or whose largest rest is
    too small for the smallest sum of sizes, are skipped whole.
    """
    n = len(size)
    found = np.zeros(n, bool)
    cuts = list(range(0, n, LIST_BLOCK))
    top = [rest[a : a + LIST_BLOCK].max() for a in cuts]
    for i, a in enumerate(cuts):
        x = slice(a, a + LIST_BLOCK)
        for j in range(i, len(cuts)):
            b = cuts[j]
            y = slice(b, b + LIST_BLOCK)
            if SIMILARITY * size[b] > 100 * size[min(a + LIST_BLOCK, n) - 1]:
                break  # all further blocks have larger sets yet
            if found[x].all() and found[y].all() or min(top[i], top[j]) < needed(size[a], size[b]):
                continue
            ok = np.minimum(rest[x, None], rest[None, y]) >= needed(size[x, None], size[None, y])
            if i == j:
                np.fill_diagonal(ok, False)
            found[x] |= ok.any(1)
            found[y] |= ok.any(0)
    return found


def _runs(table: pa.Table, depth: int = 0) -> Iterator[np.ndarray]:
    """The runs of one bucket's lists in which sets may link, as postings; ``depth`` common shingles stand before the list's own."""
    posts = np.concatenate([_restore(x.as_py(), _POST) for x in table.column("data")])
    posts = posts[np.lexsort((posts["key"], posts["token"]))]
    fresh = np.ones(len(posts), bool)
    fresh[1:] = (posts["token"][1:] != posts["token"][:-1]) | (posts["key"][1:] != posts["key"][:-1])
    posts = posts[fresh]
    cuts = np.flatnonzero(np.concatenate([[True], posts["token"][1:] != posts["token"][:-1], [True]]))
    for k in np.flatnonzero(np.diff(cuts) > 1).tolist():
        own = posts[cuts[k] : cuts[k + 1]]
        own = own[np.argsort(own["size"], kind="stable")]
        own = own[partnered(own["size"].astype(np.int64), (own["size"] - own["pos"] + depth).astype(np.int64))]
        size = own["size"].astype(np.int64)
        ends = np.flatnonzero(np.concatenate([[True], SIMILARITY * size[1:] > 100 * size[:-1], [True]]))  # no link across a gap
        for a, b in zip(ends[:-1], ends[1:]):
            if b - a > 1:
                yield own[a:b]


def _lists(table: pa.Table) -> pa.Table:
    """One bucket of the index: pairs of a list's leader with each other entry."""
    leaders, members = [], []
    for run in _runs(table):
        lead = run["key"].min()
        members.append(run["key"][run["key"] != lead])
        leaders.append(np.full(len(members[-1]), lead))
    if not leaders:
        return pa.table({"leader": pa.array([], pa.int64()), "member": pa.array([], pa.int64())})
    pairs = np.unique(np.stack([np.concatenate(leaders), np.concatenate(members)]), axis=1)
    return pa.table({"leader": pairs[0], "member": pairs[1]})


def _deeper(depth: int):
    """One bucket of a further index: groups (grp, leader, key, pos) of one list each."""

    def run(table: pa.Table) -> pa.Table:
        runs = list(_runs(table, depth))
        size = [len(x) for x in runs]
        grp = [int(mixed(x["token"][:1] + x["size"][:1].astype(np.uint64)).view(np.int64)[0]) for x in runs]
        posts = np.concatenate(runs) if runs else np.empty(0, _POST)
        lead = np.repeat(np.array([x["key"].min() for x in runs], np.int64), size)
        return pa.table({"grp": np.repeat(np.array(grp, np.int64), size), "leader": lead, "key": posts["key"], "pos": posts["pos"].astype(np.int32)})

    return run


def _extend(buckets: int, depth: int, held):
    """Members (grp, pos, key, data) -> postings under their group and the next shingle of their prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = held.value
        for batch in batches:
            for part in chunks(batch, "data", SPLIT_BYTES):
                grp, after, key = (np.array(part.column(c).to_pylist(), np.int64) for c in ("grp", "pos", "key"))
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in part.column("data")]
                size = np.array([len(x) for x in sets])
                owner, token, pos = _prefixes(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), frequent, counts, depth)
                go = pos > after[owner]
                owner, token, pos = owner[go], token[go], pos[go]
                out = np.empty(len(owner), _POST)
                out["token"] = mixed(mixed(grp.view(np.uint64))[owner] + token)
                out["key"], out["size"], out["pos"] = key[owner], size[owner], pos
                yield _packed(out, buckets)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, hash, place, text) -> rows (place, data) with the texts' sets, each row once; a text that comes several times in a
    row is split once."""
    seen: set[tuple] = set()
    for batch in batches:
        for part in chunks(batch, limit=SPLIT_BYTES):
            ids = list(zip(part.column("doc").to_pylist(), part.column("hash").to_pylist()))
            first: dict[tuple, int] = {}
            for i, x in enumerate(ids):
                first.setdefault(x, i)
            number = {x: j for j, x in enumerate(first)}
            tokens, begins = shingle_sets(text_bytes(part.column("text").take(pa.array(list(first.values()), pa.int64()))))
            data = [tokens[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist())]
            places = list(zip(part.column("place").field("grp").to_pylist(), part.column("place").field("salt").to_pylist(), part.column("place").field("turn").to_pylist()))
            keep = [i for i, (x, y) in enumerate(zip(ids, places)) if not ((x, y) in seen or seen.add((x, y)))]
            yield pa.RecordBatch.from_arrays([part.column("place").take(pa.array(keep, pa.int64())), pa.array([data[number[ids[i]]] for i in keep], pa.binary())], ["place", "data"])


def _overlaps(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Common elements of one ascending set with each of many."""
    flat = np.concatenate(many)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    ends = np.cumsum([len(x) for x in many])
    return np.diff(np.concatenate([[0], np.cumsum(one[at] == flat)])[np.concatenate([[0], ends])])


def answers(sets: list[np.ndarray], leader: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links that connect all linked sets of a group, and which sets they do not connect with the leader.

    The leader's overlaps are computed; those of other pairs are derived from them as far as bounds decide.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    common = _overlaps(sets[leader], sets)
    other = size - common  # outside the leader
    near = common >= needed(size, size[leader])
    near[leader] = True
    links = [(leader, int(i)) for i in np.flatnonzero(near) if i != leader]
    for _, i in links:
        root[i] = leader
    far = np.flatnonzero(~near)
    for t in far.tolist():
        bound = np.minimum(common, common[t]) + np.minimum(other, other[t])
        open_ = np.flatnonzero((bound >= needed(size, size[t])) & (SIMILARITY * np.maximum(size, size[t]) <= 100 * np.minimum(size, size[t])))
        open_ = [i for i in open_.tolist() if i != t and (near[i] or i > t) and find(i) != find(t)]
        if open_:
            shared = _overlaps(sets[t], [sets[i] for i in open_])
            for i, o in zip(open_, shared.tolist()):
                if o >= needed(len(sets[i]), len(sets[t])) and find(i) != find(t):
                    root[find(i)] = find(t)
                    links.append((t, i))
    return links, np.array([i for i in far.tolist() if find(i) != find(leader)], int)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, salt, turn, blocks, leader, key, data) in order of their first three -> links (a, b), and of a group with several
    blocks the members that a block does not connect with the leader (grp, b)."""
    at, blocks, leader, keys, sets = None, 1, 0, [], []

    def close() -> pa.RecordBatch:
        links, apart = answers(sets, keys.index(leader))
        rows = [(keys[a], keys[b], None) for a, b in links]
        if blocks > 1:
            rows += [(None, keys[i], at[0]) for i in apart.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else ((), (), ()))], ["a", "b", "grp"])

    for batch in batches:
        for *place, n, lead, key, data in zip(*(batch.column(c).to_pylist() for c in ("grp", "salt", "turn", "blocks", "leader", "key")), batch.column("data")):
            if place != at:
                if len(keys) > 1:
                    yield close()
                at, blocks, leader, keys, sets = place, n, lead, [], []
            if key not in keys[-1:]:
                keys.append(key)
                sets.append(np.frombuffer(data.as_py(), np.uint64))
    if len(keys) > 1:
        yield close()


def _dealt(members: DataFrame) -> DataFrame:
    """Members (grp, leader, key) of groups, leaders not among them, as rows of groups: their block is salt; the leader, one row, is in
    all blocks, which is what a salt to ``last_salt`` says. Turns are the like of it for visits."""
    counts = members.groupBy("grp", "leader").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = members.select("grp", "key").join(counts, "grp").select("grp", spread.alias("salt"), spread.alias("last_salt"), "blocks", "leader", "key")
    leads = counts.select("grp", F.lit(0).alias("salt"), (F.col("blocks") - 1).alias("last_salt"), "blocks", "leader", F.col("leader").alias("key"))
    return rows.unionByName(leads).withColumns({"turn": F.lit(0), "last_turn": F.lit(0)})


#: Most bits of the table by which texts are looked up before they are shuffled: 8 MB, whatever the corpus.
BITS = 1 << 26


def _among(df: DataFrame, hashes: DataFrame) -> DataFrame:
    """The rows of ``df`` whose ``hash`` may be among ``hashes``: one bit for each value of its lowest bits. The table is broadcast and has at
    most BITS bits; the more hashes, the more other rows pass, and a join decides."""
    bits = 1 << 15
    while bits < min(BITS, 32 * hashes.count()):
        bits *= 2
    low = F.expr(f"hash & {bits - 1}")
    at = lambda c: F.shiftright(c, 15).alias("_part")  # noqa: E731  32,768 bits in a row of the table
    table = hashes.select(low.alias("bit")).groupBy(at("bit")).agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("_bits"))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((hash & {bits - 1} & 32767) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    hit = F.getbit(byte, F.expr("cast(hash & 7 as int)")) == 1
    return df.withColumn("_part", at(low)).join(F.broadcast(table), "_part").where(hit).select(df.columns)


class _Join:
    """What the steps of one join share: the texts, the order of shingles, and how to get sets of keys."""

    def __init__(self, docs: DataFrame):
        self.parts = shuffle_partitions(docs.sparkSession)
        self.texts = docs.select(_doc(docs).alias("doc"), _hash(docs).alias("hash"), "text")
        self.buckets = max(2 * self.parts, text_total(self.texts) // BUCKET_BYTES)
        scan = materialize(self.texts.mapInArrow(_scan(self.buckets), _SCAN), "scan")
        self.rows = scan.where("bucket IS NULL").select("doc", "hash", "n", "d1", "d2")
        firsts = self.rows.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc", "hash")).alias("first"))
        self.classes = materialize(firsts.select("d1", "d2", F.col("first.doc").alias("rep"), F.col("first.hash").alias("hash")), "classes")
        self.held = docs.sparkSession.sparkContext.broadcast(frequent_shingles(scan))  # FREQUENT entries at most

    def placed(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` (key, grp, salt, turn and ``columns``) as (doc, hash, place), a written table: a document stands for each key."""
        reps = self.classes.select(F.col("d1").alias("key"), F.col("rep").alias("doc"), "hash")
        return materialize(rows.join(reps, "key").select("doc", "hash", F.struct("grp", "salt", "turn", "key", *columns).alias("place")), "placed")

    def with_sets(self, placed: DataFrame) -> DataFrame:
        """The places with the set of each key as ``data``. What is shuffled of the texts is what may stand for a key, and a text is split
        once for all of its rows."""
        texts = _among(self.texts, placed.select("hash"))
        kinds = placed.schema["place"].dataType.simpleString()
        found = texts.join(placed, ["doc", "hash"]).select("doc", "hash", "place", "text").mapInArrow(_sets, f"place {kinds}, data binary")
        return found.select("place.*", "data")

    def indexed(self, posts: DataFrame, handler, schema: str) -> DataFrame:
        """Lists of packed postings, a bucket at a time; each bucket is a task, as long as they are not too many."""
        dealt = posts.repartitionById(self.buckets, "bucket") if self.buckets <= MOST_TASKS else posts.repartition(MOST_TASKS, "bucket")
        return dealt.groupBy("bucket").applyInArrow(handler, schema)

    def pairs(self) -> DataFrame:
        """(leader, member) of the groups. A group whose members and leader are all in the group of the leader's own smallest leader holds
        no pair that is not answered there, and is left out."""
        posts = self.texts.select("text").mapInArrow(_post(self.buckets, self.held), "bucket int, data binary")
        pairs = materialize(self.indexed(posts, _lists, "leader long, member long").distinct(), "pairs")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))  # a leader of very many members is no single task
        above = pairs.groupBy(F.col("member").alias("leader")).agg(F.min("leader").alias("above")).withColumn("salt", salts)
        there = pairs.select(F.col("leader").alias("above"), "member", F.lit(1).alias("there"))
        salted = pairs.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(SALTS)).cast("int"))
        met = salted.join(above, ["leader", "salt"]).join(there, ["above", "member"], "left")
        held = met.groupBy("leader").agg(F.count("*").alias("n"), F.count("there").alias("met")).where("n = met").select("leader")
        gone = held.withColumn("salt", salts)
        return salted.join(gone, ["leader", "salt"], "left_anti").select("leader", "member")

    def linked(self, groups: DataFrame) -> DataFrame:
        """(a, b, grp) of groups (grp, salt, last_salt, turn, last_turn, blocks, leader, key)."""
        placed = self.placed(groups, "last_salt", "last_turn", "blocks", "leader")
        spans = (F.col("place.last_salt") - F.col("place.salt") + 1) * (F.col("place.last_turn") - F.col("place.turn") + 1).cast("long")
        size = placed.agg(F.sum(spans)).first()[0] or 0
        spread = self.with_sets(placed).withColumn("salt", F.explode(F.sequence("salt", "last_salt"))).withColumn("turn", F.explode(F.sequence("turn", "last_turn")))
        place = ["grp", "salt", "turn"]
        rows = spread.repartition(max(self.parts, size // (16 * BLOCK)), *place).sortWithinPartitions(*place, "key")
        return materialize(rows.select(*place, "blocks", "leader", "key", "data").mapInArrow(_verify, "a long, b long, grp long"), "found")

    def visits(self, groups: DataFrame, apart: DataFrame, many: DataFrame) -> DataFrame:
        """Groups in which the members ``apart`` visit all blocks, so many at a turn as a block holds."""
        hosts = groups.join(many, "grp").withColumn("last_turn", F.col("turns") - 1).drop("turns")
        spread = F.pmod(F.xxhash64("key", F.lit(1)), F.col("turns")).cast("int")
        leads = groups.where("key = leader").select("grp", "salt", "last_salt", "leader")
        guests = apart.join(many, "grp").join(leads, "grp").withColumns({"turn": spread, "last_turn": spread, "blocks": F.lit(1)}).drop("turns")
        return hosts.withColumn("blocks", F.lit(1)).unionByName(guests)

    def connect(self, members: DataFrame) -> DataFrame:
        """Links (a, b) of all groups (grp, leader, key, pos), materialized; leaders are not among the keys."""
        links = []
        for depth in range(DEPTH + 1):
            groups = _dealt(members)
            found = self.linked(groups)
            links.append(found.where("grp IS NULL").select("a", "b"))
            apart = found.where("grp IS NOT NULL").select("grp", F.col("b").alias("key")).distinct()
            if apart.isEmpty():
                break
            many = apart.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("turns"))
            deep = many.where(F.lit(depth < DEPTH) & (F.col("turns") > FEW))
            shallow = many.join(deep.select("grp"), "grp", "left_anti")
            links.append(self.linked(self.visits(groups, apart, shallow)).select("a", "b"))
            if deep.isEmpty():
                break
            # the leader has met all of its members, so its group goes on without it
            frontier = members.join(deep, "grp", "left_semi").withColumns({"salt": F.lit(0), "turn": F.lit(0)})
            carried = self.with_sets(self.placed(frontier, "pos")).select("grp", "pos", "key", "data")
            posts = carried.mapInArrow(_extend(self.buckets, depth, self.held), "bucket int, data binary")
            lists = materialize(self.indexed(posts, _deeper(depth), "grp long, leader long, key long, pos int"), "lists")
            members = lists.where("key <> leader")
        out = links[0]
        for more in links[1:]:
            out = out.unionByName(more)
        return out


def _doc(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"], F.lit(LAST))


def _hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"])


def class_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc, hash, n, d1, d2) of the documents, classes (d1, d2, rep, hash) and links (a, b) of their d1."""
    join = _Join(docs)
    groups = join.pairs().select(F.col("leader").alias("grp"), "leader", F.col("member").alias("key"), F.lit(-1).alias("pos"))
    return join.rows, join.classes, join.connect(groups)


def near_components(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    rows, classes, links = class_links(docs)
    of_key = classes.select(F.col("d1"), "rep")
    named = (
        links.join(of_key.withColumnsRenamed({"d1": "a", "rep": "ra"}), "a")
        .join(of_key.withColumnsRenamed({"d1": "b", "rep": "rb"}), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    stars = components(named)
    labelled = classes.join(stars.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = rows.join(labelled, ["d1", "d2"], "left")
    own = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(
        own("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, own("component")).otherwise(own("doc")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component of texts."""
    rows, _, links = class_links(docs)
    copies = rows.where("n > 0").groupBy("doc", "hash").agg(F.min("d1").alias("d1"), F.count("*").alias("copies"))
    copies = materialize(copies, "copies")
    stars = components(links).withColumnRenamed("node", "d1")  # of classes: an id may have texts of several
    firsts = copies.groupBy("d1").agg(F.min(F.struct("doc", "hash", "copies")).alias("first"))
    kept = firsts.join(stars, "d1", "left").groupBy(F.coalesce("component", "d1")).agg(F.min("first").alias("first"))
    kept = materialize(kept.select("first.*"), "kept")
    gone = materialize(copies.join(kept, ["doc", "hash"], "left_anti").select("doc", "hash"), "gone")
    left = docs.join(gone, (_doc(docs) == gone["doc"]) & (_hash(docs) == gone["hash"]), "left_anti")
    again = kept.where("copies > 1").select("doc", "hash")
    if again.isEmpty():
        return left
    same = (_doc(left) == again["doc"]) & (_hash(left) == again["hash"])
    one = left.join(again, same, "left_semi").withColumns({_DOC: _doc(left), _HASH: _hash(left)}).dropDuplicates([_DOC, _HASH])
    return left.join(again, same, "left_anti").unionByName(one.drop(_DOC, _HASH))
