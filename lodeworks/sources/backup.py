"""Backups: a table's copies under a root, by collection and time."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def save(df: DataFrame, root: str, collection: str, at_ms: int) -> str:
    """Write one backup; a time that exists is refused. Returns its path."""
    path = f"{root}/{collection}/{at_ms:020d}"
    df.write.parquet(path)
    return path


def times(spark: SparkSession, root: str, collection: str) -> list[int]:
    """The times of a collection's finished backups, oldest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(f"{root}/{collection}")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [str(f.getPath().getName()) for f in files.listStatus(at)]
    return sorted(int(x) for x in found if re.fullmatch(r"\d{20}", x) and files.exists(path(f"{root}/{collection}/{x}/_SUCCESS")))


def restore_latest(spark: SparkSession, root: str, collection: str) -> DataFrame:
    """The newest backup."""
    if not (found := times(spark, root, collection)):
        raise ValueError(f"no backup of {collection}")
    return spark.read.parquet(f"{root}/{collection}/{found[-1]:020d}")
