"""Vector retrieval: exact nearest neighbours and what builds on them. Points are (id, vector, ...); ties go to the smaller id."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.filters import compile_filter, fields_of

POOL = 50


class SearchError(ValueError):
    """A search that cannot be run."""


def pool_size(wanted: int, fetch_k: int = 0) -> int:
    """The candidates that diversifying and grouping work on."""
    return fetch_k if fetch_k >= wanted else max(4 * wanted, POOL)


def scored(points: DataFrame, query: Sequence[float], metric: str = "cosine", filter=None, vector: str = "vector") -> DataFrame:
    """Admitted points with their distance; filters run before scoring."""
    admitted = points.where(compile_filter(filter, fields_of(points))) if filter else points
    admitted = admitted.where(F.col(vector).isNotNull())
    return admitted.withColumn("distance", V.distance_to(metric, F.col(vector), query))


def knn(points: DataFrame, query: Sequence[float], k: int, metric: str = "cosine", filter=None, vector: str = "vector") -> DataFrame:
    """The k nearest, all columns and ``distance``: one pass and a bounded heap in each task."""
    return scored(points, query, metric, filter, vector).orderBy("distance", "id").limit(max(k, 0))


def ranked(hits: DataFrame, key: Column | None = None) -> DataFrame:
    """Bounded hits with their rank from 0."""
    order = [key] if key is not None else [F.col("distance").asc()]
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order, F.col("id").asc())) - 1)


#: Queries that meet the points in one pass, and points of one matrix product: a task holds QUERIES * (k + PRODUCT / 8) numbers or so.
QUERIES, PRODUCT = 4096, 2048
#: What a product in single precision may be off, for unit vectors and in units of the norms otherwise.
_SLACK = 1e-5


class _Heaps:
    """The k best points so far of each of some queries."""

    def __init__(self, metric: str, queries: np.ndarray, k: int):
        self.metric, self.queries, self.k = metric, queries, k
        self.small = np.ascontiguousarray(queries, np.float32)
        self.norm = np.linalg.norm(queries, axis=1)
        n = len(queries)
        self.distance, self.id = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def _rough(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of every query to every vector in single precision, and by how much they may be off."""
        product = self.small @ np.ascontiguousarray(vectors, np.float32).T
        norms = np.linalg.norm(vectors, axis=1)
        scale = self.norm[:, None] * norms[None]
        if self.metric == "cosine":
            return 1 - np.divide(product, scale, out=np.zeros_like(product), where=scale > 0), np.float64(_SLACK)
        if self.metric == "dot":
            return -product, _SLACK * scale
        whole = self.norm[:, None] ** 2 + norms[None] ** 2
        return whole - 2 * product, _SLACK * whole

    def add(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Whatever may be among the k best by the rough distance is measured in double precision and merged."""
        rough, slack = self._rough(vectors)
        limit = self.distance[:, -1]
        if len(ids) > self.k:
            limit = np.minimum(limit, np.partition(rough + slack, self.k - 1, axis=1)[:, self.k - 1])
        query, point = np.nonzero(rough - slack <= limit[:, None])
        if not len(query):
            return
        exact = _pairwise(self.metric, vectors[point], self.queries[query])
        touched, row = np.unique(query, return_inverse=True)
        names = np.concatenate([np.repeat(np.arange(len(touched)), self.k), row])
        distance = np.concatenate([self.distance[touched].ravel(), exact])
        own = np.concatenate([self.id[touched].ravel(), ids[point]])
        order = np.lexsort((own, distance, names))
        place = np.arange(len(order)) - np.searchsorted(names[order], names[order])
        best = order[place < self.k]
        self.distance[touched], self.id[touched] = distance[best].reshape(-1, self.k), own[best].reshape(-1, self.k)


def _pairwise(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows of ``a`` to rows of ``b``, in double precision."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    if metric == "l2":
        return ((a - b) ** 2).sum(1)
    dot = (a * b).sum(1)
    if metric == "dot":
        return -dot
    n = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
    return 1 - np.divide(dot, n, out=np.zeros_like(n), where=n > 0)


def _knn_pass(points: DataFrame, names: np.ndarray, vectors: np.ndarray, k: int, metric: str) -> DataFrame:
    """(query_id, id, distance): the k candidates of each task for at most QUERIES queries."""
    held = points.sparkSession.sparkContext.broadcast((names, vectors))  # bounded by QUERIES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, heaps = held.value[0], _Heaps(metric, held.value[1], k)
        for batch in batches:
            column = batch.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False)
            rows, ids = flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1)), batch.column("id").to_numpy(zero_copy_only=False)
            for begin in range(0, batch.num_rows, PRODUCT):
                heaps.add(ids[begin : begin + PRODUCT], rows[begin : begin + PRODUCT])
        found = np.isfinite(heaps.distance)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, found.sum(1))), pa.array(heaps.id[found]), pa.array(heaps.distance[found])], ["query_id", "id", "distance"])

    return points.where("vector IS NOT NULL").select("id", "vector").mapInArrow(run, "query_id long, id long, distance double")


def knn_batch(points: DataFrame, queries: DataFrame, k: int, metric: str = "cosine") -> DataFrame:
    """(query_id, rank, id, distance) for a stated set of queries (id, vector) against all points.

    Queries are taken ``QUERIES`` at a time, so neither driver nor broadcast grows with their number. In a task each run of points meets
    them in one matrix product, and a heap of k for each query lives through all of the task's points: a task leaves k candidates for each
    query, which are then ranked by query. Points never move.
    """
    lanes, last = [], None
    asked = queries.where("vector IS NOT NULL").select("id", "vector")
    while True:
        rows = (asked if last is None else asked.where(F.col("id") > last)).orderBy("id").limit(QUERIES).collect()
        if rows or not lanes:
            names = np.array([r["id"] for r in rows], np.int64)
            vectors = np.array([r["vector"] for r in rows], float) if rows else np.zeros((0, 1))
            lanes.append(_knn_pass(points if rows else points.limit(0), names, vectors, k, metric))
        if len(rows) < QUERIES:
            break
        last = rows[-1]["id"]
    found = reduce(DataFrame.unionByName, lanes)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")) - 1
    return found.withColumn("rank", rank).where(F.col("rank") < k)


def within(points: DataFrame, ids: DataFrame, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """k nearest of the points whose id is in ``ids``."""
    return knn(points.join(ids.select("id").distinct(), "id", "left_semi"), query, k, metric)


def top_per_group(rows: DataFrame, key: str, k: int) -> DataFrame:
    """(key, id, distance, rank) of the k nearest of each group. A partial top-k runs in each task (Spark's window group limit), so a
    group of any size moves k rows for each task."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("distance", "id"))
    return rows.select(key, "id", "distance", place.alias("_n")).where(F.col("_n") <= k).select(key, "id", "distance", (F.col("_n") - 1).alias("rank"))


def group_hits(pool: DataFrame, key: str, k: int, size: int = 1) -> DataFrame:
    """The best ``size`` hits of each of the k best groups of an ordered pool; rows without the key belong to none."""
    group = Window.partitionBy(key)
    hits = pool.where(F.col(key).isNotNull()).withColumn("hit_rank", F.row_number().over(group.orderBy("distance", "id")))
    hits = hits.withColumn("best", F.min(F.struct("distance", "id")).over(group)).where(F.col("hit_rank") <= size)
    return hits.withColumn("group_rank", F.dense_rank().over(Window.orderBy("best"))).where(F.col("group_rank") <= k).drop("best")


def search_groups(points: DataFrame, query: Sequence[float], key: str, k: int, size: int = 1, fetch_k: int = 0, metric: str = "cosine", filter=None) -> DataFrame:
    """Grouped search over a bounded pool."""
    return group_hits(knn(points, query, pool_size(k * size, fetch_k), metric, filter), key, k, size)


def _greedy(vectors: np.ndarray, relevance: np.ndarray, k: int, lam: float, similar) -> list[int]:
    chosen = [int(relevance.argmax())]
    nearest = similar(vectors, vectors[chosen[0]])
    while len(chosen) < min(k, len(vectors)):
        worth = lam * relevance - (1 - lam) * nearest
        worth[chosen] = -np.inf
        chosen.append(int(worth.argmax()))
        nearest = np.maximum(nearest, similar(vectors, vectors[chosen[-1]]))
    return chosen


def mmr(points: DataFrame, query: Sequence[float], k: int, lam: float = 0.5, fetch_k: int = 0, metric: str = "cosine", filter=None) -> DataFrame:
    """(rank, id, distance): greedy maximal marginal relevance over a bounded pool, which one task orders."""
    lam = 0.5 if lam <= 0 else min(lam, 1.0)
    pool = knn(points, query, pool_size(k, fetch_k), metric, filter).select("id", "distance", "vector")

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["distance", "id"], ignore_index=True)
        if len(rows) > k:
            v = np.stack(rows["vector"].to_numpy()).astype(float)
            rows = rows.iloc[_greedy(v, -rows["distance"].to_numpy(), k, lam, lambda m, one: -V.distances(metric, m, one[None])[:, 0])]
        return pd.DataFrame({"rank": np.arange(len(rows)), "id": rows["id"].to_numpy(), "distance": rows["distance"].to_numpy()})

    return pool.groupBy().applyInPandas(pick, "rank long, id long, distance double")


def vectors_of(points: DataFrame, ids: Sequence[int]) -> dict[int, list[float]]:
    """A stated handful of points' vectors."""
    return {r["id"]: list(r["vector"]) for r in points.where(F.col("id").isin(*ids)).select("id", "vector").collect()} if ids else {}


def mean_target(positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]] = (), metric: str = "cosine") -> list[float]:
    """Mean of the positive vectors minus mean of the negative ones, of unit length under cosine."""
    if not len(positive):
        raise SearchError("no positive example")
    target = np.mean(np.array(positive, float), 0)
    if len(negative):
        target = target - np.mean(np.array(negative, float), 0)
    n = np.linalg.norm(target)
    return (target / n if metric == "cosine" and n > 0 else target).tolist()


def target_vector(points: DataFrame, positive: Sequence[int], negative: Sequence[int], metric: str = "cosine") -> list[float]:
    """``mean_target`` of examples given by id; missing examples are skipped."""
    if not positive:
        raise SearchError("no positive example")
    found = vectors_of(points, [*positive, *negative])
    plus = [found[i] for i in positive if i in found]
    if not plus:
        raise SearchError("no positive example exists")
    return mean_target(plus, [found[i] for i in negative if i in found], metric)


def recommend(points: DataFrame, positive: Sequence[int], negative: Sequence[int] = (), k: int = 10, metric: str = "cosine", filter=None) -> DataFrame:
    """Average-vector recommendation; examples are left out."""
    target = target_vector(points, positive, negative, metric)
    return knn(points.where(~F.col("id").isin(*positive, *negative)), target, k, metric, filter)


def _best(metric: str, examples: list[list[float]]) -> Column:
    each = [V.similarity(metric, F.col("vector"), V.as_vector(e)) for e in examples]
    return F.greatest(*each) if len(each) > 1 else each[0]


def recommend_by_vectors(
    points: DataFrame, positive: Sequence[Sequence[float]], negative: Sequence[Sequence[float]] = (), k: int = 10, metric: str = "cosine", pool: int = 0, strategy: str = "best_score", filter=None
) -> DataFrame:
    """Recommendation from example vectors: by their mean, or by best score, where the closest positive counts unless a negative is
    closer, which counts against."""
    if strategy == "average":
        return knn(points, mean_target(positive, negative, metric), k, metric, filter)
    if metric == "l2" and len(negative):
        raise SearchError("best score under l2 takes no negatives")
    if not len(positive):
        raise SearchError("no positive example")
    near = knn(points, np.mean(np.array(positive, float), 0).tolist(), pool or max(4 * k, POOL), metric, filter)
    score = good = _best(metric, list(positive))
    if len(negative):
        bad = _best(metric, list(negative))
        score = F.when(good > bad, good).otherwise(-bad)
    return near.withColumn("score", score).orderBy(F.col("score").desc(), "distance", "id").limit(k)


def recommend_best_score(points: DataFrame, positive: Sequence[int], negative: Sequence[int] = (), k: int = 10, metric: str = "cosine", pool: int = 0) -> DataFrame:
    """Best-score recommendation from examples given by id, which are left out; missing ones are skipped."""
    if metric == "l2" and negative:
        raise SearchError("best score under l2 takes no negatives")
    found = vectors_of(points, [*positive, *negative])
    plus = [found[i] for i in positive if i in found]
    if not plus:
        raise SearchError("no positive example exists")
    others = points.where(~F.col("id").isin(*positive, *negative))
    return recommend_by_vectors(others, plus, [found[i] for i in negative if i in found], k, metric, pool)


def discover_by_vectors(points: DataFrame, pairs: Sequence[tuple[Sequence[float], Sequence[float]]], target: Sequence[float] | None = None, k: int = 10, metric: str = "cosine", pool: int = 0) -> DataFrame:
    """Context search: each (positive, negative) pair of vectors adds 1 if the positive is as close, else the difference."""
    if not len(pairs):
        raise SearchError("no context pair exists")
    seed = list(target) if target is not None else np.mean(np.array([p for p, _ in pairs], float), 0).tolist()
    near = knn(points, seed, pool or max(4 * k, POOL), metric)
    score = F.lit(0.0)
    for p, n in pairs:
        sp, sn = (-V.distance(metric, F.col("vector"), V.as_vector(x)) for x in (p, n))
        score = score + F.when(sp >= sn, F.lit(1.0)).otherwise(sp - sn)
    return near.withColumn("score", score).orderBy(F.col("score").desc(), "distance", "id").limit(k)


def discover(points: DataFrame, pairs: Sequence[tuple[int, int]], target: Sequence[float] | None = None, k: int = 10, metric: str = "cosine", pool: int = 0) -> DataFrame:
    """Context search by ids: pairs of which a point is missing are skipped, and their points are left out."""
    found = vectors_of(points, [i for p in pairs for i in p])
    known = [(found[p], found[n]) for p, n in pairs if p in found and n in found]
    others = points.where(~F.col("id").isin(*{i for p in pairs for i in p})) if pairs else points
    return discover_by_vectors(others, known, target, k, metric, pool)


def search_multivector(docs: DataFrame, query: list[list[float]], k: int, filter=None) -> DataFrame:
    """MaxSim over (id, tokens); both sides normalised."""
    unit = [V.unit(q) for q in query]
    admitted = docs.where(compile_filter(filter, fields_of(docs))) if filter else docs
    score = V.maxsim(unit, F.transform("tokens", lambda t: V.normalize(t)))
    return admitted.withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(k)


def search_named(points: DataFrame, space: str, query: Sequence[float], k: int, metric: str = "cosine", filter=None) -> DataFrame:
    """kNN in one space of (id, vectors map); points without the space are skipped."""
    return knn(points.withColumn("vector", F.col("vectors")[space]), query, k, metric, filter)


def sparse_dot(postings: DataFrame, query: dict[int | str, float]) -> DataFrame:
    """(id, score) of every point that shares a dimension: only rows of the query's dimensions are read, summed by id."""
    weights = F.create_map(*[F.lit(x) for d, w in query.items() for x in (d, float(w))])
    hits = postings.where(F.col("dim").isin(*query)).withColumn("part", F.col("weight").cast("double") * weights[F.col("dim")])
    return hits.groupBy("id").agg(F.sum("part").alias("score"))


def search_sparse(postings: DataFrame, query: dict[int | str, float], k: int) -> DataFrame:
    """The k best of (id, score) over postings (id, dim, weight)."""
    return sparse_dot(postings, query).orderBy(F.col("score").desc(), "id").limit(k)


def semantic_lookup(cache: DataFrame, query: Sequence[float], scope: str, threshold: float = 0.97) -> DataFrame:
    """The nearest cached entry of a scope, if 1 - distance reaches the threshold."""
    best = knn(cache.where(F.col("scope") == scope), query, 1)
    return best.withColumn("similarity", 1 - F.col("distance")).where(F.col("similarity") >= threshold)


def medoid(points: DataFrame, metric: str = "l2") -> DataFrame:
    """The point nearest to the mean."""
    mean = points.select(F.posexplode("vector")).groupBy("pos").agg(F.avg("col").alias("m")).orderBy("pos").collect()  # a row for each dimension
    return knn(points, [r["m"] for r in mean], 1, metric)
