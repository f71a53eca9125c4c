"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when identical after each run of white space becomes one space. Three combining stages compare the whole
normalised text, never a digest alone:

1. *locally*: Spark's partial aggregation merges equal texts inside each task, so a task sends one row for each text;
2. *salted*: rows of one (digest, text) meet under ``salt`` = a few bits of the hashed id, so that even a group that holds
   a third of all rows is merged by many tasks;
3. *globally*: at most ``SALTS`` winners of each text meet under the digest.

The merged groups are a narrow table (digest, smallest id, size). Documents find their group by digest; AQE splits the
join's partitions when one digest is hot. Should two different texts ever share a digest, the same join runs on the whole
text as well, so the result never rests on the digest.

Defined results: null text counts as empty; a null ``doc_id`` ranks before every other id, as in Spark's sort order. Rows
that repeat an id with an equal text get the same verdict in ``exact_groups``; ``drop_copies`` keeps one of them. An empty
table gives an empty result. Only ``doc_id`` and ``text`` are looked at; ``drop_copies`` carries all other columns along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

#: Parts into which the rows of one digest are dealt before they meet.
SALTS = 16


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", " ")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", normalised(F.col("text")).alias("content")).withColumn("digest", F.unhex(F.sha2("content", 256)))


def text_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: digest, content, keep_id, group_size."""
    salted = (
        _keyed(docs)
        .withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"), F.count("doc_id").alias("with_id"))
    )
    merged = salted.groupBy("digest", "content").agg(
        F.min("least").alias("least"), F.sum("rows").alias("group_size"), F.sum("with_id").alias("with_id")
    )
    first = F.when(F.col("with_id") == F.col("group_size"), F.col("least"))
    return merged.select("digest", "content", first.alias("keep_id"), "group_size")


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = text_groups(docs, salts)
    narrow = materialize(groups.select("digest", "keep_id", "group_size"), "text-groups")
    shared = narrow.groupBy("digest").count().where("count > 1").limit(1).count()
    keyed = _keyed(docs)
    if shared:
        found = keyed.join(groups, ["digest", "content"])
    else:
        found = keyed.drop("content").join(narrow, "digest")
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents that stay, with the columns of ``docs``: of rows with the kept id and equal text, one."""
    groups = text_groups(docs, salts)
    winners = materialize(groups.select("digest", "keep_id"), "winners")
    name = "_" * max(map(len, docs.columns)) + "digest"  # longer than any column's name
    keyed = docs.withColumn(name, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    same = (keyed[name] == winners["digest"]) & keyed["doc_id"].eqNullSafe(winners["keep_id"])
    kept = keyed.join(winners, same, "left_semi")
    if not docs.groupBy("doc_id").count().where("count > 1").isEmpty():  # ids that repeat, if any, may repeat a kept text
        kept = kept.dropDuplicates(["doc_id", name])
    return kept.select(docs.columns)
