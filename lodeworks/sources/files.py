"""Text files as documents, and change logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings that are read as text.
TEXT_ENDINGS = ("txt", "md", "markdown", "rst", "csv", "json", "yaml", "yml", "html", "go", "py", "js", "ts", "java", "c", "h", "cpp", "rs", "sh", "sql")


def text_files(spark: SparkSession, path: str, endings: tuple[str, ...] = TEXT_ENDINGS) -> DataFrame:
    """(source, content) of all text files under a path; files that are not UTF-8 are skipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = found.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*endings))
    text = F.col("content").cast("string")
    return listed.where(F.is_valid_utf8(text)).select(F.col("path").alias("source"), text.alias("content"))


def list_objects(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """(path, length) of the objects under a path whose name begins with a prefix."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return found.where(F.regexp_extract("path", r"([^/]+)$", 1).startswith(prefix))


def strip_tags(html):
    """The text of a page: scripts, styles and tags gone, white space folded."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))
