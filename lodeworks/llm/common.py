"""What the corpus operators share: durable intermediate tables, Arrow batches and text splitting."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace of every operator here, as a Java and Python regex class: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"

#: Text bytes that Python code takes from an Arrow batch at a time, so memory does not follow the batch's row count.
CHUNK_BYTES = 4 << 20

#: Seconds of writing from which finished shuffle files are worth a collection.
LONG_S = 3

_leaving: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset and the master is a plain local one (tests), a temporary folder is set. On a cluster an unset
    folder is an error: a machine-local one would lose tables with their executor.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="lodeworks-"))
    return context.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """This application's folder for intermediate tables; the store deletes it when the driver ends."""
    root = f"{shared_dir(spark).rstrip('/')}/lodeworks/{spark.sparkContext.applicationId}"
    if root not in _leaving:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
        _leaving.add(root)
    return root


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files that nothing refers to any more.

    It does so when the driver collects its garbage, which a driver with little to do may put off for long. A finished query
    takes two collections: the first only frees what its listeners and Python still hold.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, and executors may be lost.

    Shuffle files that only led to the table may go then; a table that took under ``LONG_S`` to write left few of them.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}/{name}"
    began = time.monotonic()
    df.write.parquet(path)
    if time.monotonic() - began > LONG_S:
        release(spark)
    return spark.read.schema(df.schema).parquet(path)


def text_total(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts, from which operators derive how many buckets they need."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES):
    """Slices of a batch with at most ``limit`` bytes of text each (one row at least)."""
    sizes = [n or 0 for n in pc.binary_length(batch.column(text)).to_pylist()]
    begin = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if len(sizes) > begin:
        yield batch.slice(begin)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def id_as_text_crc(column: str = "doc_id"):
    """Unsigned crc32 of an id written as text, the learning operators' split key."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """A bounded training sample (doc_id, text, label): for each value of ``label`` the ``per_class`` rows with the smallest hashed id.

    Only ids whose ``crc32(doc_id) mod 5`` is not 0 take part, with whole texts of any length. The id list has at most
    2 * per_class rows, so its broadcast is bounded whatever the corpus size, and an id that repeats gives one row, the one whose
    text has the smallest hash.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_as_text_crc() % 5 != 0))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    picked = None
    for value in (0, 1):
        one = ids.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    found = texts.join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
