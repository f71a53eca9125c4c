"""Point tables: scans, reads by id, writes as plans over change rows, payload edits and quotas."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.filters import FilterError, certain, compile_filter, fields_of, hollow


class WriteError(ValueError):
    """A write that is rejected whole."""


def live(df: DataFrame, now_ms: int, expires: str = "expires_at_ms") -> DataFrame:
    """Rows that have not expired; 0 or null never do. The clock is an argument, so that results can be replayed."""
    return df.where(F.coalesce(F.col(expires), F.lit(0)).isin(0) | (F.col(expires) > now_ms))


def live_keys(payload: Column, key_expiry: Column, now_ms: int) -> Column:
    """A payload map without its expired keys; a key without a deadline, or with 0, is permanent."""
    return F.map_filter(payload, lambda k, _: (F.coalesce(key_expiry[k], F.lit(0)) == 0) | (key_expiry[k] > now_ms))


def get(df: DataFrame, point_id: int, columns: Sequence[str] | None = None) -> DataFrame:
    found = df.where(F.col("id") == point_id)
    return found.select(*columns) if columns else found


def projected(df: DataFrame, with_vector: bool, with_payload: bool, vector: str = "vector") -> DataFrame:
    """Points with or without their vector and payload columns; what is left out is not read."""
    return df.select("id", *(c for c in df.columns if c != "id" and (with_vector if c == vector else with_payload)))


def get_batch(df: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Found points, and the wanted ids that have none."""
    wanted = ids.select("id").distinct()
    return df.join(wanted, "id", "left_semi"), wanted.join(df, "id", "left_anti")


def latest(df: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Last writer wins: max_by with a partial aggregation, so a hot key's changes are reduced before they move."""
    others = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(seq)).alias("_last"))
    return best.select(key, *(F.col("_last")[c].alias(c) for c in others))


def _order(rows: DataFrame, seq: str | None) -> DataFrame:
    """``rows`` with the sequence in which the batch holds them."""
    return rows.withColumn("_seq", F.col(seq) if seq else F.monotonically_increasing_id())


def _one(rows: DataFrame, pick) -> DataFrame:
    """One row of each id, the first (``min_by``) or the last (``max_by``) in sequence, combined before rows move."""
    others = [c for c in rows.columns if c != "id"]
    best = rows.groupBy("id").agg(pick(F.struct(*others), "_seq").alias("_one"))
    return best.select("id", *(F.col("_one")[c].alias(c) for c in others))


def insert(base: DataFrame, rows: DataFrame, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Create-only: the table with the new points, and the conflicts, which are rows whose id is live or was inserted by an earlier
    row of the batch. The sequence is the column ``seq`` or, without one, the order in which the batch is read."""
    timed = _order(rows, seq)
    new = _one(timed, F.min_by).join(base.select("id"), "id", "left_anti")
    clashes = timed.join(new.select("id", "_seq"), ["id", "_seq"], "left_anti")
    return base.unionByName(new.select(base.columns)), clashes.select(rows.columns)


def upsert(base: DataFrame, rows: DataFrame, seq: str | None = None) -> DataFrame:
    """Insert or replace; of rows with one id the last in sequence stays. Only kept base rows and the new ones are read again."""
    last = _one(_order(rows, seq), F.max_by)
    return base.join(last.select("id"), "id", "left_anti").unionByName(last.select(base.columns))


def compare_and_set(base: DataFrame, rows: DataFrame, seq: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``expected``: applied where it equals the point's version (0 if absent), bumping it; the rest are conflicts.

    A batch's writers have all seen the same version, so of those that expect it the first in sequence wins and the others lose to it.
    """
    timed = _order(rows, seq).join(base.select("id", F.col("version").alias("_now")), "id", "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    won = _one(timed.where(F.col("_now") == F.col("expected")), F.min_by)
    lost = timed.join(won.select("id", "_seq"), ["id", "_seq"], "left_anti")
    bumped = won.select("id").withColumn("_won", F.lit(1))
    lost = lost.join(bumped, "id", "left").select("id", "expected", (F.col("_now") + F.coalesce("_won", F.lit(0))).alias("actual"))
    kept = base.join(won.select("id"), "id", "left_anti")
    return kept.unionByName(won.withColumn("version", F.col("_now") + 1).select(base.columns)), lost


def delete(base: DataFrame, ids: DataFrame) -> DataFrame:
    return base.join(ids.select("id"), "id", "left_anti")


def delete_by_filter(base: DataFrame, tree: dict) -> DataFrame:
    """What stays; a filter that is empty is refused."""
    if hollow(tree):
        raise FilterError("an empty filter would delete everything")
    return base.where(~certain(compile_filter(tree, fields_of(base))))


def merge_payload(payload: Column, patch: Column) -> Column:
    """Key-wise overwrite of a map."""
    return F.map_concat(F.map_filter(payload, lambda k, _: ~F.array_contains(F.map_keys(patch), k)), patch)


def clear_payload(base: DataFrame, ids: DataFrame, payload: str = "payload") -> DataFrame:
    """The table with the payloads of some points gone."""
    marked = base.join(ids.select("id").distinct().withColumn("_clear", F.lit(True)), "id", "left")
    return marked.withColumn(payload, F.when(F.col("_clear").isNull(), F.col(payload))).select(base.columns)


def without_keys(payload: Column, keys: Sequence[str]) -> Column:
    return F.map_filter(payload, lambda k, _: ~k.isin(*keys))


def replace_source(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """Replace all chunks of each source that ``new`` holds."""
    return chunks.join(new.select("source").distinct(), "source", "left_anti").unionByName(new.select(chunks.columns))


def within_quota(rows: DataFrame, seq: str, most: int) -> DataFrame:
    """The first ``most`` rows of each collection, by sequence."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("collection").orderBy(seq))).where(F.col("_n") <= most).drop("_n")


def token_bucket(events: DataFrame, rate: float, key: str, at_ms: str, seq: str) -> DataFrame:
    """Events with ``admitted``: a bucket of ``rate`` tokens per key, refilled continuously.

    Each event's admission depends on all before it, so one key's events are decided in one task. They pass through it sorted (which spills) and a
    batch at a time, and what is held is one number for the key, so a hot key takes time but no memory.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, last, known = rate, None, object()
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key].to_numpy(), pdf[at_ms].to_numpy()):
                if k != known:
                    tokens, last, known = rate, None, k
                tokens = rate if last is None else min(rate, tokens + (t - last) / 1000 * rate)
                last = t
                out.append(tokens >= 1)
                tokens -= out[-1]
            yield pdf.assign(admitted=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
    return events.repartition(key).sortWithinPartitions(key, at_ms, seq).mapInPandas(fold, schema + ", admitted boolean")
