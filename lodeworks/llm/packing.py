"""Harmonic packing of token sequences.

A piece of length n belongs to class k, the largest k with n <= capacity div k, and each sequence of class k holds k
pieces. A document's ids are cut into full sequences and a rest; the rest is cut on so that each cut leaves a
piece that fills its class's share exactly (the largest share that fits), unless the rest as a whole wastes at most ``WASTE``
of its share or is so short that its class is over ``MOST``. Classes go up to the capacity, so short pieces fill sequences too.

Workers fill bins independently. A full piece (class 1) is a sequence by itself. Any other class is dealt by hash into groups of
about ``GROUP`` pieces, 16 bins at least, and each group closes a bin after every k of its pieces. What the groups leave over, under k
pieces each, is dealt and packed the same way again; that is less than an eighth of the pieces plus k, so levels shrink geometrically
until a class is one group. The last bin of a class may stay part-filled, in a corpus of any size: at most one for each class (under
100). Those bins, as wholes, are merged into sequences, the fullest first. One law holds at every size, and no other packer is used.

Defined results: a null text is empty and is one end token; a null id is one id like any other for its own row; repeated
rows are packed once each; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialize, text_bytes
from .wordtok import word_encoder

#: What a sequence holds, the largest class that cuts aim at, the waste that a piece may leave of its share, pieces of a group.
CAPACITY, MOST, WASTE, GROUP = 2048, 64, 0.04, 256
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int"


def class_of(length: int, capacity: int = CAPACITY) -> int:
    return capacity // length


def cut(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    out = [(start, capacity) for start in range(0, tokens - capacity + 1, capacity)]
    start = len(out) * capacity
    while rest := tokens - start:
        share = capacity // class_of(rest, capacity)
        fits = share - rest <= WASTE * share or capacity // rest >= MOST
        length = rest if fits else capacity // (class_of(rest, capacity) + 1)
        out.append((start, length))
        start += length
    return out


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: PIECES, and with ``with_ids`` the ids as little-endian unsigned 32-bit bytes."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = word_encoder(tokenizer_path), struct.pack("<I", end_id)
        for batch in batches:
            for part in chunks(batch):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(text_bytes(part.column("text")))):
                    view = memoryview(ids + end)
                    n = len(view) // 4
                    for start, length in cut(n, capacity):
                        own = view[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(own), n, class_of(length, capacity), *([bytes(own)] if with_ids else [])))
                columns = list(zip(*rows)) or [()] * (6 + with_ids)
                kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * with_ids
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"] + ["ids"] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(pieces, PIECES + ", ids binary" * with_ids)


def groups_of(count: int, kind: int) -> int:
    """Into how many groups the pieces of a class are dealt."""
    return -(-count // max(GROUP, 16 * kind))


def harmonic_pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, start, length, class and any more) with sequence_id and offset."""
    columns = pieces.columns
    left = materialize(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    whole = left.where("class = 1").withColumns({"offset": F.lit(0), "sequence_id": _tagged(WHOLE, F.col("row"))})
    parts: list[DataFrame] = []
    done, left, level = [whole.select(*columns, "sequence_id", F.col("offset").cast("long").alias("offset"))], left.where("class > 1"), 0
    while counts := {r["class"]: r["count"] for r in left.groupBy("class").count().collect()}:  # under 100 rows
        dealt = left.withColumn("group", F.pmod(F.xxhash64("row", F.lit(level)), _by_class({k: groups_of(n, k) for k, n in counts.items()})).cast("int"))
        keys = Window.partitionBy("class", "group")
        size = F.count("*").over(keys)
        placed = dealt.withColumn("place", F.row_number().over(keys.orderBy("row")) - 1)
        last = [k for k, n in counts.items() if groups_of(n, k) == 1]  # these classes end here, with a part-filled bin
        full = (F.col("place") < size - size % F.col("class")) | F.col("class").isin(last)
        placed = placed.withColumns({"full": full, "bin": F.floor(F.col("place") / F.col("class")).cast("long")})
        before = keys.orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
        sums = placed.withColumn("before", F.coalesce(F.sum("length").over(before), F.lit(0)))
        bins = Window.partitionBy("class", "group", "bin")
        sums = sums.withColumns({"offset": F.col("before") - F.min("before").over(bins), "held": F.count("*").over(bins)})
        placed = materialize(sums.drop("place", "before"), f"level-{level}")
        closed = placed.where("full AND held = class")
        number = F.shiftleft(F.shiftleft(F.col("class").cast("long"), 34) + F.col("group"), 12) + F.col("bin")
        done.append(closed.select(*columns, _tagged(level, number).alias("sequence_id"), F.col("offset").cast("long").alias("offset")))
        parts.append(placed.where("full AND held < class"))
        left, level = placed.where("NOT full").select(*columns, "row"), level + 1
    if parts:
        done.append(_merged(reduce(DataFrame.unionByName, parts), capacity).select(*columns, "sequence_id", "offset"))
    return reduce(DataFrame.unionByName, done)


#: The highest five bits of a sequence's id: the level, or one of these.
MERGED, WHOLE = 30, 31


def _tagged(kind: int, number):
    return F.lit(kind).cast("long") * 2**58 + number


def _by_class(values: dict[int, int]):
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("class")]


def _merged(parts: DataFrame, capacity: int) -> DataFrame:
    """Pieces of part-filled bins, one bin for each class at most, with the sequences into which whole bins are merged."""
    totals = {r["class"]: r["total"] for r in parts.groupBy("class").agg(F.sum("length").alias("total")).collect()}  # under 100 rows
    used: list[int] = []
    sequence, shift = {}, {}
    for kind in sorted(totals, key=lambda k: (-totals[k], k)):
        at = next((i for i, n in enumerate(used) if n + totals[kind] <= capacity), len(used))
        if at == len(used):
            used.append(0)
        sequence[kind], shift[kind] = at, used[at]
        used[at] += totals[kind]
    if not totals:
        sequence, shift = {0: 0}, {0: 0}
    return parts.withColumns({"sequence_id": _tagged(MERGED, _by_class(sequence)), "offset": (F.col("offset") + _by_class(shift)).cast("long")})


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    packed = harmonic_pack(token_pieces(docs, tokenizer_path, end_id, capacity), capacity)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
