"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in ascending order of (doc_id, size, crc). A keyed Feistel network permutes [0, 4**h), the
smallest such domain that holds n; a value that falls outside [0, n) is permuted again until it falls inside (cycle
walking), which is a bijection of [0, n). The permuted number p gives shard = p mod shards and slot = p div shards, so the
shard counts differ by one at most, slots have no gaps, and both follow from the row number, n and the key alone: any worker can
compute them, and ``row_of`` inverts them, without a table.

The law is ``rows``. Copies are no groups here: a permutation of rows scatters them. Null texts have no bytes; null ids
are numbered first; rows that agree in id, size and crc are interchangeable; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

#: Bytes that each row takes besides its text.
ROW_BYTES = 16
ROUNDS, KEY = 6, 20_240_229


def _half_bits(n: int) -> int:
    h = 1
    while 4**h < n:
        h += 1
    return h


def _round(x: np.ndarray, i: int, key: int, mask: np.uint64) -> np.ndarray:
    """A keyed function of half a number; wrapping 64-bit arithmetic."""
    z = x + np.uint64((key * 0x9E3779B97F4A7C15 + i * 0xBF58476D1CE4E5B9) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) & mask


def _network(x: np.ndarray, h: int, key: int, backwards: bool) -> np.ndarray:
    half, mask = np.uint64(h), np.uint64(2**h - 1)
    left, right = x >> half, x & mask
    for i in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        if backwards:
            left, right = right ^ _round(left, i, key, mask), left
        else:
            left, right = right, left ^ _round(right, i, key, mask)
    return (left << half) | right


def permute(rows: np.ndarray, n: int, key: int = KEY, backwards: bool = False) -> np.ndarray:
    """The permuted place of each row number in [0, n), or with ``backwards`` the row number at each place."""
    h, out = _half_bits(n), np.asarray(rows).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _network(out[todo], h, key, backwards)
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def row_of(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, key: int = KEY) -> np.ndarray:
    """The row number that lies in a slot of a shard."""
    return permute(np.asarray(slot) * shards + np.asarray(shard), n, key, backwards=True)


def numbered(df: DataFrame, order: list[str], name: str = "row") -> tuple[DataFrame, int]:
    """``df`` with its global row number in ascending ``order``, and its row count.

    One range shuffle; what reaches the driver is a count for each partition.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    table = materialize(
        ranged.select("*", F.shiftright(place, 33).cast("int").alias("_part"), place.bitwiseAND(2**33 - 1).alias("_at")), "numbered"
    )
    counts = dict(sorted((r[0], r[1]) for r in table.groupBy("_part").count().collect()))
    starts = [0, *accumulate(counts.values())]
    offsets = spark.createDataFrame(list(zip(counts, starts)), "_part int, _start long")
    joined = table.join(F.broadcast(offsets), "_part")  # a row for each shuffle partition
    return joined.withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start"), starts[-1]


def shard_documents(docs: DataFrame, shards: int = 40, key: int = KEY) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(narrow, ["doc_id", "size", "text_crc32"])

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, key))

    return rows.withColumn("p", place("row")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("p") % shards).cast("int").alias("shard"),
        F.expr(f"p div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
