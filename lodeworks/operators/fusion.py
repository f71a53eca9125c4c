"""Fusion of ranked lanes. A lane is (id, distance, score): dense lanes rank by distance, score lanes by score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import clamp01

RRF_K, ALPHA = 60, 0.5


def lane(df: DataFrame, scored: bool) -> DataFrame:
    """(id, rank from 0, value, distance); ties by id. Lanes are bounded pools, so one window over each is small."""
    key = F.col("score").desc() if scored else F.col("distance").asc()
    rank = F.row_number().over(Window.orderBy(key, F.col("id").asc())) - 1
    value = F.col("score") if scored else F.col("distance")
    return df.select("id", rank.alias("rank"), value.cast("double").alias("value"), F.col("distance").cast("double").alias("distance"))


def _minmax(value: Column, inverted: bool) -> Column:
    every = Window.partitionBy()
    low, high = F.min(value).over(every), F.max(value).over(every)
    share = (high - value if inverted else value - low) / (high - low)
    return F.when(high == low, F.lit(1.0)).otherwise(share)


def _three_sigma(value: Column, inverted: bool) -> Column:
    every = Window.partitionBy()
    mean, sigma = F.avg(value).over(every), F.stddev_pop(value).over(every)
    x = clamp01((value - (mean - 3 * sigma)) / (6 * sigma))
    return F.when((sigma == 0) | (F.count(value).over(every) <= 1), F.lit(1.0)).otherwise(1.0 - x if inverted else x)


def alpha_of(alpha: float) -> float:
    """0 stands for the default."""
    return ALPHA if alpha == 0 else min(1.0, max(0.0, alpha))


def fuse(first: DataFrame, second: DataFrame, method: str = "rrf", k: int = 10, alpha: float = 0.0, rrf_k: int = 0, first_scored: bool = False, second_scored: bool = True) -> DataFrame:
    """(id, distance, score) of two lanes fused: rrf, weighted (min-max) or dbsf (three sigma); k best, ties by id."""
    a, b = lane(first, first_scored), lane(second, second_scored)
    if method == "rrf":
        c = rrf_k if rrf_k > 0 else RRF_K
        part = lambda df, scored: df.withColumn("part", 1.0 / (F.lit(float(c)) + F.col("rank") + 1))
        weights = (1.0, 1.0)
    else:
        scale = {"weighted": _minmax, "dbsf": _three_sigma}[method]
        part = lambda df, scored: df.withColumn("part", scale(F.col("value"), not scored))
        weights = (alpha_of(alpha), 1 - alpha_of(alpha))
    x = part(a, first_scored).select("id", F.col("part").alias("pa"), "distance")
    y = part(b, second_scored).select("id", F.col("part").alias("pb"))
    score = F.lit(weights[0]) * F.coalesce("pa", F.lit(0.0)) + F.lit(weights[1]) * F.coalesce("pb", F.lit(0.0))
    fused = x.join(y, "id", "full_outer").select("id", F.coalesce("distance", F.lit(0.0)).alias("distance"), score.alias("score"))
    return fused.orderBy(F.col("score").desc(), "id").limit(k)


def fold(lanes: Sequence[tuple[DataFrame, bool]], method: str, k: int, alpha: float = 0.0, rrf_k: int = 0) -> tuple[DataFrame, bool]:
    """Left fold of lanes (frame, scored); each step keeps k, and later lanes are read by their scores."""
    frame, scored = lanes[0]
    if len(lanes) == 1:
        key = F.col("score").desc() if scored else F.col("distance").asc()
        return frame.orderBy(key, "id").limit(k), scored
    for number, (other, other_scored) in enumerate(lanes[1:]):
        if method != "rrf" and not other_scored:
            other, other_scored = other.withColumn("score", F.lit(0.0)), True  # a dense lane has no score: all equal
            frame = fuse(frame, other, method, k, alpha, rrf_k, scored or number > 0, True)
            continue
        frame = fuse(frame, other, method, k, alpha, rrf_k, scored or number > 0, other_scored)
    return frame, True


def rag_fuse(dense: DataFrame, text: DataFrame, alpha: float, k: int) -> DataFrame:
    """Chunks (key, rank) of two lanes: rrf for a negative alpha, else alpha/(rank+1) + (1-alpha)/(rank+1); ties by first lane, then rank."""
    weight = (lambda c, w: 1.0 / (RRF_K + F.col(c) + 1)) if alpha < 0 else (lambda c, w: w / (F.col(c) + 1.0))
    x = dense.select("key", F.col("rank").alias("ra"))
    y = text.select("key", F.col("rank").alias("rb"))
    part = lambda c, w: F.coalesce(weight(c, w), F.lit(0.0))
    fused = x.join(y, "key", "full_outer").withColumn("score", part("ra", alpha) + part("rb", 1 - alpha))
    seen = F.coalesce(F.col("ra").cast("long"), F.lit(1 << 40) + F.col("rb"))
    return fused.orderBy(F.col("score").desc(), seen).limit(k).select("key", "score")


def lane_depth(k: int, own: int = 0) -> int:
    """How many hits each lane of a hybrid search brings: as asked for, or as many as wanted, fifty at least."""
    return own or max(k, 50)


def lanes(first: DataFrame, second: DataFrame, first_scored: bool = False, second_scored: bool = True) -> DataFrame:
    """Both lanes unfused, for a coordinator that fuses them itself: (lane, rank, id, distance, score), each lane in its own order."""
    out = []
    for name, frame, scored in (("first", first, first_scored), ("second", second, second_scored)):
        key = F.col("score").desc() if scored else F.col("distance").asc()
        rank = F.row_number().over(Window.orderBy(key, F.col("id").asc())) - 1  # a lane is a bounded pool
        out.append(frame.select(F.lit(name).alias("lane"), rank.alias("rank"), "id", "distance", "score"))
    return out[0].unionByName(out[1])


def hybrid(first: DataFrame, second: DataFrame, k: int, method: str = "rrf", **more) -> DataFrame:
    """``fuse``, but an empty lane leaves the other as it is, cut to k."""
    if second.isEmpty():
        return first.orderBy("distance", "id").limit(k)
    if first.isEmpty():
        return second.orderBy(F.col("score").desc(), "id").limit(k)
    return fuse(first, second, method, k, **more)


def merge_lanes(parts: Sequence[DataFrame], k: int, scored: bool) -> DataFrame:
    """The k best of one lane's hits in several partitions."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.orderBy(F.col("score").desc() if scored else F.col("distance").asc(), "id").limit(k)
