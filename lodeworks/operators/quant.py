"""Trained quantization and inverted files: approximate pruning with an exact second look.

Training reads a bounded sample (``TRAINING`` vectors); codes, cells and searches cover all points. A pool of the best by codes, or of the
nearest cells, may lack some of the true nearest; ``completed`` finds those by what each code may be off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from . import search

#: Vectors that training reads at most (smallest hashed ids); encoding and assignment cover all.
TRAINING = 50_000


def training_matrix(points: DataFrame, most: int = TRAINING) -> np.ndarray:
    rows = points.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(most).toPandas()
    return np.stack(rows["vector"].to_numpy()).astype(float)


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = 7, unit: bool = False) -> np.ndarray:
    """Lloyd's algorithm from a k-means++ start; distinct points if there are no more than k."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    nearest = V.distances("l2", x, centres)[:, 0]
    while len(centres) < k:
        total = nearest.sum()
        one = x[rng.choice(len(x), p=nearest / total)] if total > 0 else x[rng.integers(len(x))]
        centres = np.vstack([centres, one])
        nearest = np.minimum(nearest, V.distances("l2", x, one[None])[:, 0])
    for _ in range(rounds):
        own = V.distances("l2", x, centres).argmin(1)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        if unit:
            n = np.linalg.norm(centres, axis=1, keepdims=True)
            centres = centres / np.where(n > 0, n, 1)
    return centres


def anisotropic_losses(x: np.ndarray, centres: np.ndarray, eta: float) -> np.ndarray:
    """Loss of coding each row by each centre: the error across the row's direction, plus ``eta`` times the error along it."""
    plain = V.distances("l2", x, centres)
    length = (x * x).sum(1)
    along = np.where(length[:, None] > 0, (length[:, None] - x @ centres.T) ** 2 / np.where(length > 0, length, 1)[:, None], 0.0)
    return plain + (eta - 1) * along


def anisotropic_kmeans(x: np.ndarray, k: int, eta: float = 4.0, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k-means whose error along a vector's own direction weighs ``eta`` times as much, since that part decides inner products.

    A centre minimises its rows' losses, sum (x - c)' (I + (eta - 1) u u') (x - c) with u the direction of x, which is a linear system of
    the vectors' width. With eta of 1 or less it is plain k-means.
    """
    if eta <= 1 or len(np.unique(x, axis=0)) <= k:
        return kmeans(x, k, rounds, seed)
    centres = kmeans(x, k, 0, seed)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
    for _ in range(rounds):
        own = anisotropic_losses(x, centres, eta).argmin(1)
        for c in np.unique(own):
            u, mine = unit[own == c], x[own == c]
            system = len(mine) * np.eye(x.shape[1]) + (eta - 1) * u.T @ u
            centres[c] = np.linalg.solve(system, mine.sum(0) + (eta - 1) * (u * (u * mine).sum(1, keepdims=True)).sum(0))
    return centres


def scalar_ranges(points: DataFrame) -> DataFrame:
    """(pos, low, high) of every dimension, by one partial aggregation."""
    return points.select(F.posexplode("vector")).groupBy("pos").agg(F.min("col").cast("double").alias("low"), F.max("col").cast("double").alias("high"))


def scalar_codes(points: DataFrame, bits: int = 8) -> DataFrame:
    """Points with ``codes``: levels of each dimension's range."""
    rows = scalar_ranges(points).orderBy("pos").collect()  # a row for each dimension
    low, high = V.as_vector([r["low"] for r in rows]), V.as_vector([r["high"] for r in rows])
    levels = 2**bits - 1
    share = F.transform("vector", lambda x, i: F.when(high[i] == low[i], F.lit(0.0)).otherwise((x.cast("double") - low[i]) / (high[i] - low[i])))
    return points.withColumn("codes", F.transform(share, lambda s: F.round(s * levels).cast("int")))


def train_pq(points: DataFrame, parts: int, centroids: int = 256, eta: float = 1.0) -> np.ndarray:
    """(parts, centroids, width) codebooks; with ``eta`` over 1 they are trained by ``anisotropic_kmeans``."""
    x = training_matrix(points)
    width = x.shape[1] // parts
    books = [anisotropic_kmeans(x[:, i * width : (i + 1) * width], centroids, eta, seed=11 + i) for i in range(parts)]
    return np.stack([np.vstack([b, np.repeat(b[-1:], centroids - len(b), 0)]) for b in books])


def pq_encode(points: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, codes) of every point."""
    held = points.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["vector"].to_numpy()).astype(float) if len(batch) else np.empty((0, books.shape[0] * books.shape[2]))
            parts = np.split(x, books.shape[0], axis=1)
            codes = np.stack([V.distances("l2", p, b).argmin(1) for p, b in zip(parts, held.value)], 1)
            yield pd.DataFrame({"id": batch["id"], "codes": list(codes.astype("int32"))})

    return points.select("id", "vector").mapInPandas(run, "id long, codes array<int>")


def pq_restored(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that the codes of ``x`` stand for."""
    return np.hstack([b[V.distances("l2", p, b).argmin(1)] for p, b in zip(np.split(x, len(books), axis=1), books)])


def pq_search(codes: DataFrame, books: np.ndarray, query: Sequence[float], k: int) -> DataFrame:
    """k best by table lookups of squared distances."""
    parts = np.split(np.asarray(query, float), books.shape[0])
    tables = F.array(*[V.as_vector(V.distances("l2", b, p[None])[:, 0]) for b, p in zip(books, parts)])
    total = F.aggregate(F.transform("codes", lambda c, i: F.element_at(tables[i], c + 1)), F.lit(0.0), lambda s, x: s + x)
    return codes.withColumn("distance", total).orderBy("distance", "id").limit(k)


def pq4_encode(points: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, codes): the numbers of at most 16 centroids, two to a byte, the first in the low half."""
    if books.shape[1] > 16:
        raise ValueError("four bits number 16 centroids")
    held = points.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["vector"].to_numpy()).astype(float)
            codes = np.stack([V.distances("l2", p, b).argmin(1) for p, b in zip(np.split(x, books.shape[0], axis=1), held.value)], 1).astype(np.uint8)
            if codes.shape[1] % 2:
                codes = np.hstack([codes, np.zeros((len(codes), 1), np.uint8)])
            yield pd.DataFrame({"id": batch["id"], "codes": [bytes(c) for c in codes[:, ::2] | codes[:, 1::2] << 4]})

    return points.select("id", "vector").mapInPandas(run, "id long, codes binary")


def byte_tables(books: np.ndarray, query: Sequence[float]) -> tuple[np.ndarray, float, float]:
    """Distances of a query's parts to all centroids in one byte each, with the step and the sum of the least ones that restore them."""
    exact = np.stack([V.distances("l2", b, p[None])[:, 0] for b, p in zip(books, np.split(np.asarray(query, float), books.shape[0]))])
    low = exact.min(1, keepdims=True)
    step = max(float((exact - low).max()) / 255, 1e-12)
    return np.round((exact - low) / step).astype(np.uint8), step, float(low.sum())


def pq4_search(codes: DataFrame, books: np.ndarray, query: Sequence[float], k: int) -> DataFrame:
    """k best by sums of byte-wide table entries, a batch of packed codes at a time; each task leaves k."""
    tables, step, least = byte_tables(books, query)
    wide = tables.astype(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            packed = np.frombuffer(b"".join(batch["codes"]), np.uint8).reshape(len(batch), -1)
            total = np.zeros(len(batch), np.int64)
            for i in range(len(wide)):
                total += wide[i][(packed[:, i // 2] >> (4 * (i % 2))) & 15]
            best = np.lexsort((batch["id"].to_numpy(), total))[:k]
            yield pd.DataFrame({"id": batch["id"].to_numpy()[best], "distance": least + step * total[best]})

    return codes.mapInPandas(run, "id long, distance double").orderBy("distance", "id").limit(k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(k, hits, recall) of two bounded lists of hits."""
    hits = found.select("id").join(exact.select("id"), "id", "left_semi").agg(F.count("*").alias("hits"))
    return exact.agg(F.count("*").alias("k")).crossJoin(hits).withColumn("recall", F.col("hits") / F.col("k"))  # one row each


def rescored(candidates: DataFrame, points: DataFrame, query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """Exact distances of a bounded candidate list."""
    return search.within(points, candidates, query, k, metric)


#: What sums in double precision may be off, in units of the distance and of 1.
_SLACK = 1e-9


def lower_bounds(metric: str, x: np.ndarray, coded: np.ndarray, query: np.ndarray) -> np.ndarray:
    """What the distances of ``x`` to the query are at least, by the vectors ``coded`` that stand for them and by how far off those are."""
    off = np.sqrt(((x - coded) ** 2).sum(1))
    if metric == "l2":
        return np.maximum(np.sqrt(((coded - query) ** 2).sum(1)) - off, 0.0) ** 2
    length = np.sqrt((query * query).sum())
    most = (coded * query).sum(1) + length * off
    if metric == "dot":
        return -most
    n = np.sqrt((x * x).sum(1)) * length
    return 1.0 - np.divide(most, n, out=np.zeros_like(n), where=n > 0)


def completed(hits: DataFrame, points: DataFrame, restore: Callable[[np.ndarray], np.ndarray], query: Sequence[float], k: int, metric: str = "cosine") -> DataFrame:
    """(id, distance) of the k nearest, exactly, from ``hits``, which an approximate search found and measured exactly.

    ``restore`` gives the vectors that stand for some vectors. A point whose lower bound by its code lies beyond the k-th hit is ruled out; any
    other one of ``points`` is measured, in one pass that moves k rows for each task. Where codes are coarse for how the points lie, few
    are ruled out and the pass measures most of them.
    """
    if k <= 0:
        return hits.select("id", "distance").limit(0)
    found = hits.select("id", "distance").orderBy("distance", "id").limit(k).collect()
    reach = found[-1]["distance"] if len(found) == k else np.inf
    known, q = np.array([r["id"] for r in found], np.int64), np.asarray(query, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, best = np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            flat, names = batch.column("vector").flatten().to_numpy(zero_copy_only=False), batch.column("id").to_numpy(zero_copy_only=False)
            for begin in range(0, batch.num_rows, search.PRODUCT):
                own = names[begin : begin + search.PRODUCT]
                x = flat[begin * len(q) : (begin + len(own)) * len(q)].reshape(len(own), len(q)).astype(float)
                limit = min(reach, best[-1]) if len(best) == k else reach
                open_ = ~(lower_bounds(metric, x, restore(x), q) > limit + _SLACK * (1 + abs(limit))) & ~np.isin(own, known)
                if open_.any():
                    ids, best = np.concatenate([ids, own[open_]]), np.concatenate([best, V.row_distances(metric, x[open_], q)])
                    order = np.lexsort((ids, best))[:k]
                    ids, best = ids[order], best[order]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best)], ["id", "distance"])

    rest = points.where("vector IS NOT NULL").select("id", "vector").mapInArrow(run, "id long, distance double")
    known_rows = points.sparkSession.createDataFrame([(r["id"], r["distance"]) for r in found], "id long, distance double")
    return rest.unionByName(known_rows).orderBy("distance", "id").limit(k)


def train_ivf(points: DataFrame, cells: int, metric: str = "cosine") -> np.ndarray:
    return kmeans(training_matrix(points), cells, unit=metric == "cosine")


def ivf_assign(points: DataFrame, centres: np.ndarray) -> DataFrame:
    """Points with ``cell``; written with partitionBy("cell"), a probe reads its cells only."""
    held = points.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float)
        return pd.Series(V.distances("l2", x, held.value).argmin(1).astype(np.int32))

    return points.withColumn("cell", nearest("vector"))


def probed(centres: np.ndarray, query: Sequence[float], probes: int) -> list[int]:
    """The cells nearest to the query."""
    return np.argsort(V.distances("l2", centres, np.asarray(query, float)[None])[:, 0], kind="stable")[:probes].tolist()


def ivf_search(assigned: DataFrame, centres: np.ndarray, query: Sequence[float], k: int, probes: int = 12, metric: str = "cosine") -> DataFrame:
    """Exact kNN within the nearest cells."""
    return search.knn(assigned.where(F.col("cell").isin(*probed(centres, query, probes))), query, k, metric)


def ivf_search_all(assigned: DataFrame, centres: np.ndarray, query: Sequence[float], k: int, probes: int = 12, metric: str = "cosine") -> DataFrame:
    """(id, distance): exact kNN. The nearest cells say how far the k-th hit is at most; a point of another cell is measured unless its
    distance to its centre rules it out."""
    near = ivf_search(assigned, centres, query, k, probes, metric)
    others = assigned.where(~F.col("cell").isin(*probed(centres, query, probes)))
    return completed(near, others, lambda x: centres[V.distances("l2", x, centres).argmin(1)], query, k, metric)


#: Growth of the table from which drift is looked at, and of the mean distance to the nearest centre from which cells are trained again.
GROWTH, DRIFT = 2.0, 1.5


def mean_cell_distance(points: DataFrame, centres: np.ndarray) -> float:
    """Mean squared distance of all points to their nearest centre, 0 of none: a task finds cells and distances in one go, some points at a
    time, and leaves a count and a sum."""
    held, width = points.sparkSession.sparkContext.broadcast(centres), centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0.0
        for batch in batches:
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
            for begin in range(0, batch.num_rows, search.PRODUCT):
                x = flat[begin * width : (begin + search.PRODUCT) * width].reshape(-1, width).astype(float)
                total += float(((x - held.value[V.distances("l2", x, held.value).argmin(1)]) ** 2).sum())
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total])], ["n", "total"])

    row = points.where("vector IS NOT NULL").select("vector").mapInArrow(run, "n long, total double").agg(F.sum("total") / F.sum("n")).first()
    return row[0] or 0.0


def drifted(trained_points: int, trained_error: float, points: int, error: float, growth: float = GROWTH, drift: float = DRIFT) -> bool:
    """Whether cells are to be trained again: the table has grown ``growth``-fold, and points lie ``drift`` times as far from their centres."""
    if growth <= 1 or drift <= 1:
        raise ValueError("growth and drift are over 1")
    return points >= growth * trained_points and error > drift * trained_error


def retrain_on_drift(old: DataFrame, new: DataFrame, centres: np.ndarray, growth: float = GROWTH, drift: float = DRIFT) -> tuple[np.ndarray, bool]:
    """The centres for ``new``, a grown table of which ``old`` was the trained part, and whether they were trained again."""
    sizes = old.count(), new.count()
    if not drifted(sizes[0], 0.0, sizes[1], np.inf, growth, drift):  # not grown enough, whatever the distances are
        return centres, False
    if drifted(sizes[0], mean_cell_distance(old, centres), sizes[1], mean_cell_distance(new, centres), growth, drift):
        return train_ivf(new, len(centres), "l2"), True
    return centres, False


def train_rotation(x: np.ndarray, parts: int, centroids: int = 16, rounds: int = 4, seed: int = 5) -> np.ndarray:
    """An orthogonal rotation that lowers product-quantization error: codebooks and Procrustes steps in turn, from a random one."""
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(x.shape[1], x.shape[1])))
    width = x.shape[1] // parts
    for number in range(rounds):
        turned = x @ rotation
        coded = np.empty_like(turned)
        for i in range(parts):
            part = turned[:, i * width : (i + 1) * width]
            book = kmeans(part, centroids, rounds=4, seed=number)
            coded[:, i * width : (i + 1) * width] = book[V.distances("l2", part, book).argmin(1)]
        u, _, v = np.linalg.svd(x.T @ coded)
        rotation = u @ v
    return rotation


def rotated(points: DataFrame, rotation: np.ndarray) -> DataFrame:
    """Points with their vectors rotated, by one matrix product per Arrow batch."""
    held = points.sparkSession.sparkContext.broadcast(rotation)

    @F.pandas_udf("array<double>")
    def turn(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(vectors.to_numpy()).astype(float) @ held.value))

    return points.withColumn("vector", turn("vector"))


def train_residual(points: DataFrame, parts: int, layers: int = 2, centroids: int = 16) -> list[np.ndarray]:
    """Codebooks of product quantization of what the layers before left over."""
    x, out = training_matrix(points), []
    width = x.shape[1] // parts
    for layer in range(layers):
        books = []
        for i in range(parts):
            part = x[:, i * width : (i + 1) * width]
            book = kmeans(part, centroids, seed=31 * layer + i)
            book = np.vstack([book, np.repeat(book[-1:], centroids - len(book), 0)])
            x[:, i * width : (i + 1) * width] = part - book[V.distances("l2", part, book).argmin(1)]
            books.append(book)
        out.append(np.stack(books))
    return out


def residual_restored(x: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    """The vectors that the layers' codes of ``x`` stand for."""
    out = np.zeros_like(x)
    for books in layers:
        width = books.shape[2]
        for i, book in enumerate(books):
            part = slice(i * width, (i + 1) * width)
            out[:, part] += book[V.distances("l2", x[:, part] - out[:, part], book).argmin(1)]
    return out


def residual_decode(points: DataFrame, layers: list[np.ndarray]) -> DataFrame:
    """(id, vector) as the layers' codes restore it."""
    held = points.sparkSession.sparkContext.broadcast(layers)

    @F.pandas_udf("array<double>")
    def restore(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(residual_restored(np.stack(vectors.to_numpy()).astype(float), held.value)))

    return points.select("id", restore("vector").alias("vector"))
