"""Token-id files with fixed-width bit packing.

Each id takes the fewest bits that hold the vocabulary. A block is a self-contained byte string: a header, the
ids of its documents' rows, each document's end, and the packed ids. Sixty-four ids fill exactly ``width`` 64-bit words,
so ids are unpacked by numpy in bulk, and id i of a block is read alone from group i div 64.

Blocks hold whole documents, ``BLOCK_IDS`` ids or a little more; a longer document is a block of its own. They are
the rows of a Parquet table, one file for each range of doc_id, with the columns (shard, block, ids_before, n_ids, first_doc,
last_doc, data): Spark's commit protocol makes the files safe against lost executors in any store that Spark can
write, and first_doc/last_doc let a reader skip blocks. The order is ascending doc_id, nulls first; a null text has no ids but
the end id; rows that repeat an id stand next to each other, by text. An empty table gives no block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, scratch, shuffle_partitions, text_bytes
from .wordtok import word_encoder

MAGIC, HEAD = b"LWB1", "<4sBxxxIQ"
BLOCK_IDS = 1 << 16
BLOCK_SCHEMA = "shard int, block int, ids_before long, n_ids long, first_doc long, last_doc long, data binary"
RESULT_SCHEMA = "doc_id long, shard int, in_shard long, n_tokens long, ids_crc32 long"


def width_of(vocabulary: int) -> int:
    """Bits that hold the ids 0..vocabulary-1."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids as little-endian fixed-width bits, filled up to whole groups of 64 ids."""
    groups = -(-len(ids) // 64)
    padded = np.zeros(groups * 64, np.uint64)
    padded[: len(ids)] = ids
    lanes, words = padded.reshape(groups, 64).T.copy(), np.zeros((width, groups), np.uint64)
    for j in range(64):
        word, off = divmod(j * width, 64)
        words[word] |= lanes[j] << np.uint64(off)
        if off + width > 64:
            words[word + 1] |= lanes[j] >> np.uint64(64 - off)
    return np.ascontiguousarray(words.T).astype("<u8").tobytes()


def unpack_bits(data: bytes, width: int, begin: int, end: int) -> np.ndarray:
    """Ids begin..end-1 of a packed string; only their groups are touched."""
    first, last = begin // 64, -(-end // 64)
    words = np.frombuffer(data, "<u8", (last - first) * width, first * width * 8).reshape(-1, width).T
    lanes, mask = np.empty((64, last - first), np.uint32), np.uint64(2**width - 1)
    for j in range(64):
        word, off = divmod(j * width, 64)
        x = words[word] >> np.uint64(off)
        if off + width > 64:
            x = x | (words[word + 1] << np.uint64(64 - off))
        lanes[j] = x & mask
    return lanes.T.reshape(-1)[begin - 64 * first : end - 64 * first]


def build_block(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    ends = np.cumsum([len(x) // 4 for x in ids])
    known = np.array([x is not None for x in doc_ids], np.uint8)
    numbers = np.array([x or 0 for x in doc_ids], "<i8")
    packed = pack_bits(np.frombuffer(b"".join(ids), "<u4"), width)
    return struct.pack(HEAD, MAGIC, width, len(ids), int(ends[-1])) + numbers.tobytes() + ends.astype("<u8").tobytes() + known.tobytes() + packed


class Block:
    """A block's documents; ``ids(i)`` reads one document's ids."""

    def __init__(self, data: bytes):
        magic, self.width, n, self.n_ids = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token block")
        at = struct.calcsize(HEAD)
        self.ends = np.frombuffer(data, "<u8", n, at + 8 * n).astype(np.int64)
        known = np.frombuffer(data, np.uint8, n, at + 16 * n)
        numbers = np.frombuffer(data, "<i8", n, at).tolist()
        self.doc_ids = [x if k else None for x, k in zip(numbers, known)]
        self.packed = data[at + 17 * n :]

    def all_ids(self) -> np.ndarray:
        return unpack_bits(self.packed, self.width, 0, self.n_ids)

    def ids(self, i: int) -> np.ndarray:
        return unpack_bits(self.packed, self.width, int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int) -> None:
    """Encode every text, append ``end_id`` and write the blocks, in ascending doc_id order, to ``path``."""
    ranges = shuffle_partitions(docs.sparkSession)
    ordered = docs.select("doc_id", "text").repartitionByRange(ranges, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, end = word_encoder(tokenizer_path), TaskContext.get().partitionId(), struct.pack("<I", end_id)
        width, block, before = width_of(max(encoder.size, end_id + 1)), 0, 0
        doc_ids, held, count = [], [], 0

        def row():
            return pa.RecordBatch.from_pydict(
                {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "ids_before": [before], "n_ids": [count], "first_doc": pa.array(doc_ids[:1], pa.int64()), "last_doc": pa.array(doc_ids[-1:], pa.int64()), "data": [build_block(doc_ids, held, width)]}
            )

        for batch in batches:
            for part in chunks(batch):
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(text_bytes(part.column("text")))):
                    n = len(ids) // 4 + 1
                    if held and count + n > BLOCK_IDS:
                        yield row()
                        block, before, doc_ids, held, count = block + 1, before + count, [], [], 0
                    doc_ids.append(doc)
                    held.append(ids + end)
                    count += n
        if held:
            yield row()

    ordered.mapInArrow(encode, BLOCK_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of a written folder."""
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def token_table(blocks: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, before, data in zip(batch.column("shard").to_pylist(), batch.column("ids_before").to_pylist(), batch.column("data")):
                block = Block(data.as_py())
                view, ends = memoryview(block.all_ids().astype("<u4").tobytes()), block.ends
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(block.doc_ids, pa.int64()), "shard": pa.array([shard] * len(ends), pa.int32()), "in_shard": begins + before, "n_tokens": ends - begins, "ids_crc32": pa.array([zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist())], pa.int64())}
                )

    sizes = dict(sorted((r[0], r[1]) for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect()))
    starts = blocks.sparkSession.createDataFrame(list(zip(sizes, [0, *accumulate(sizes.values())])), "shard int, _start long")
    found = blocks.select("shard", "ids_before", "data").mapInArrow(measure, RESULT_SCHEMA)
    return found.join(F.broadcast(starts), "shard").select(  # a row for each range of doc_id
        "doc_id", (F.col("_start") + F.col("in_shard")).alias("start"), "n_tokens", "ids_crc32"
    )


def encode_documents(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write the files into the shared folder, read them back and return ``token_table``."""
    path = f"{scratch(docs.sparkSession)}/{uuid.uuid4().hex}/token-files"
    write_token_files(docs, path, tokenizer_path, end_id)
    return token_table(read_token_files(docs.sparkSession, path))
