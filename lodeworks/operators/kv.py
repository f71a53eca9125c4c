"""Key-value state as a fold of a change log (seq, key, op, value, expires_at_ms, ts_ms)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .points import latest


def state(log: DataFrame, now_ms: int | None = None, key: str = "key") -> DataFrame:
    """The latest row of each key that is no tombstone and, at ``now_ms``, has not expired."""
    found = latest(log, key, "seq").where(F.col("op") != "del")
    if now_ms is not None:
        found = found.where((F.col("expires_at_ms") == 0) | (F.col("expires_at_ms") > now_ms))
    return found


def get(log: DataFrame, key, now_ms: int | None = None) -> DataFrame:
    return state(log.where(F.col("key") == key), now_ms)


def put_batch(entries: DataFrame, batch: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """A table of entries after one batch of puts, in which the last of a key's entries counts."""
    fresh = latest(batch, key, seq)
    return entries.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(entries.columns))


def existed(log: DataFrame, span: int = 1_000_000) -> DataFrame:
    """For each delete, whether the key was there: the change before it was no delete.

    Changes are looked at in spans of sequence numbers, and the last change of a key's former span is carried over, so the changes of
    one very hot key are spread over tasks and only its spans' ends meet.
    """
    rows = log.select("seq", "key", "op", F.floor(F.col("seq") / span).alias("_span"))
    rows = rows.withColumn("_before", F.lag("op").over(Window.partitionBy("key", "_span").orderBy("seq")))
    ends = rows.groupBy("key", "_span").agg(F.max_by("op", "seq").alias("_end"))
    carried = ends.select("key", "_span", F.lag("_end").over(Window.partitionBy("key").orderBy("_span")).alias("_carried"))
    before = F.coalesce("_before", "_carried")
    joined = rows.where(F.col("op") == "del").join(carried, ["key", "_span"])
    return joined.select("seq", "key", (before.isNotNull() & (before != "del")).alias("existed"))


def increments(log: DataFrame, delta: Column, span: int = 1_000_000) -> DataFrame:
    """The running value of each counter after every change; a delete starts it over at 0.

    Each ``span`` of sequence numbers is summed on its own, and the ends of the spans are then summed by key, so the changes of
    one very hot key are spread over tasks and only its spans' ends meet.
    """
    dead = (F.col("op") == "del").cast("int")
    rows = log.withColumns({"_span": F.floor(F.col("seq") / span), "_amount": F.when(dead == 1, F.lit(0)).otherwise(delta)})
    rows = rows.withColumn("_era", F.sum(dead).over(Window.partitionBy("key", "_span").orderBy("seq")))
    rows = rows.withColumn("_own", F.sum("_amount").over(Window.partitionBy("key", "_span", "_era").orderBy("seq")))
    ends = rows.groupBy("key", "_span").agg(F.max("_era").alias("eras"), F.max_by("_own", "seq").alias("end"))
    order = Window.partitionBy("key").orderBy("_span")
    ends = ends.withColumn("_restart", F.sum((F.col("eras") > 0).cast("int")).over(order))
    ends = ends.withColumn("_total", F.sum("end").over(Window.partitionBy("key", "_restart").orderBy("_span")))
    carried = ends.select("key", "_span", F.lag("_total").over(order).alias("_carried"))
    joined = rows.join(carried, ["key", "_span"])
    before = F.when(F.col("_era") == 0, F.coalesce("_carried", F.lit(0))).otherwise(F.lit(0))
    return joined.withColumn("counter", F.col("_own") + before).select(*log.columns, "counter")


def evict(entries: DataFrame, most: int, by: str = "seq") -> DataFrame:
    """Ring buffer: the newest ``most`` entries, by a bounded heap."""
    return entries.orderBy(F.col(by).desc()).limit(most)


def compact(log: DataFrame) -> DataFrame:
    """The log with each key's last change only, tombstones gone."""
    return latest(log, "key", "seq").where(F.col("op") != "del")


def stats(log: DataFrame) -> DataFrame:
    return log.groupBy("op").agg(F.count("*").alias("n"))


def histogram(df: DataFrame, micros: Column) -> DataFrame:
    """Decade buckets of latencies: below 1, 10, ... 1e8 microseconds, and the rest; with count and sum."""
    bucket = F.lit(9)
    for i in reversed(range(9)):
        bucket = F.when(micros < 10**i, F.lit(i)).otherwise(bucket)
    return df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.sum(micros).alias("total"))
