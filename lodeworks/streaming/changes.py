"""Change logs in Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.points import latest

#: Parts of a state by hash of the key; a batch rewrites the parts that it touches.
PARTS = 64


def _versions(spark: SparkSession, root: str, batch: int) -> dict[int, int]:
    """Which version of each part the state after a batch consists of; PARTS rows at most."""
    if batch < 0:
        return {}
    return {r["part"]: r["version"] for r in spark.read.parquet(f"{root}/manifest/{batch}").collect()}


def _paths(root: str, versions: dict[int, int]) -> list[str]:
    return [f"{root}/v{version}/part={part}" for part, version in sorted(versions.items())]


def apply_changes(changes: DataFrame, root: str, checkpoint: str, key: str = "key", seq: str = "seq", parts: int = PARTS):
    """Start a query that keeps the last change of each key in a table under ``root``, dealt into parts by a hash of the key.

    A batch reads and rewrites only the parts that its keys fall in, and a small manifest names the version of every part. Versions and
    manifests are named by the batch, so a batch that is run again after a failure writes the same files: the state is exactly-once.
    Versions that neither this manifest nor the one before names are deleted.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        before = _versions(spark, root, number - 1)
        fresh = latest(batch, key, seq).select(*batch.columns, place.alias("part"))
        touched = sorted(r["part"] for r in fresh.select("part").distinct().collect())  # ``parts`` at most
        if old := _paths(root, {p: before[p] for p in touched if p in before}):
            schema = T.StructType([*batch.schema.fields])
            held = spark.read.schema(schema).parquet(*old).select(*batch.columns, place.alias("part"))
            fresh = latest(held.unionByName(fresh), key, seq).select(*batch.columns, "part")
        fresh.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/v{number}")
        now = before | dict.fromkeys(touched, number)
        rows = spark.createDataFrame(sorted(now.items()), "part int, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{number}")
        _forget(spark, root, number, set(now.values()) | set(before.values()))

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _forget(spark: SparkSession, root: str, number: int, used: set[int]) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for version in range(max(0, number - 200), number):
        if version not in used and files.exists(path(f"{root}/v{version}")):
            files.delete(path(f"{root}/v{version}"), True)


def read_state(spark: SparkSession, root: str, batch: int, schema: T.StructType) -> DataFrame:
    """The live rows after a batch."""
    paths = _paths(root, _versions(spark, root, batch))
    found = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return found.where(F.col("op") != "del")


def windowed_counts(changes: DataFrame, ts: str, every: str = "1 hour", late: str = "2 hours", *by: str) -> DataFrame:
    """Counts by event-time window with a watermark; late rows beyond it are dropped and finished windows leave the state."""
    return changes.withWatermark(ts, late).groupBy(F.window(ts, every), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def run_windows(batches: list[DataFrame], root: str, ts: str, every: str, late: str, *by: str) -> DataFrame:
    """``windowed_counts`` as a stream over tables that arrive one after the other, with the finished windows as a table."""
    spark = batches[0].sparkSession
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(f"{root}/in")  # a file each, taken in order of time
    source = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    counted = windowed_counts(source, ts, every, late, *by)
    running = counted.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.schema(counted.schema).parquet(f"{root}/out")
