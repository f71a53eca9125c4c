"""Vector and geographic column functions, all inside the JVM unless they say otherwise."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
METRICS = ("cosine", "l2", "dot")


def as_vector(values) -> Column:
    """A literal array of doubles."""
    return F.array(*[F.lit(float(x)) for x in values])


def dot(a: Column, b: Column) -> Column:
    """Sum of products, folded left to right in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_squared(a: Column, b: Column) -> Column:
    def square(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, square), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """v / |v|; the zero vector stays."""
    n = norm(v)
    return F.when(n == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def distance(metric: str, v: Column, q: Column) -> Column:
    """cosine: 1 - cos, and 1 for a zero vector; l2: squared; dot: negated product."""
    if metric == "l2":
        return l2_squared(v, q)
    if metric == "dot":
        return -dot(v, q)
    if metric != "cosine":
        raise ValueError(f"unknown metric {metric!r}")
    n = norm(v) * norm(q)
    return F.lit(1.0) - F.when(n == 0, F.lit(0.0)).otherwise(dot(v, q) / n)


def row_distances(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``distance`` of each row to one vector, in double precision; rows are summed each on its own."""
    if metric == "l2":
        return ((x - q) ** 2).sum(1)
    dots = (x * q).sum(1)
    if metric == "dot":
        return -dots
    n = np.sqrt((x * x).sum(1)) * float(np.sqrt((q * q).sum()))
    return 1.0 - np.divide(dots, n, out=np.zeros_like(n), where=n > 0)


def distance_to(metric: str, v: Column, query) -> Column:
    """``distance`` of a column to one stated vector, an Arrow batch at a time; rows are summed each on its own, so equal vectors tie exactly.
    Null where the vector is null; a vector of another width is an error."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    q = np.asarray(query, float)

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        there = vectors.drop_null() if vectors.null_count else vectors
        flat = there.flatten().to_numpy(zero_copy_only=False)
        if len(flat) != len(there) * len(q):
            raise ValueError(f"vectors are not of {len(q)} dimensions")
        out = row_distances(metric, flat.reshape(len(there), len(q)).astype(float), q)
        if not vectors.null_count:
            return pa.array(out)
        known = vectors.is_valid().to_numpy(zero_copy_only=False)
        whole = np.zeros(len(vectors))
        whole[known] = out
        return pa.array(whole, mask=~known)

    return run(v)


def similarity(metric: str, v: Column, q: Column) -> Column:
    d = distance(metric, v, q)
    return F.lit(1.0) - d if metric == "cosine" else -d


def unit(v) -> list[float]:
    """A query vector of length 1; the zero vector stays."""
    x = np.asarray(v, float)
    return (x / (np.linalg.norm(x) or 1)).tolist()


def distances(metric: str, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The same distances for whole batches, by matrix products."""
    v, q = np.asarray(vectors, float), np.asarray(queries, float)
    if metric == "dot":
        return -(v @ q.T)
    if metric == "l2":
        return np.maximum((v * v).sum(1)[:, None] - 2 * (v @ q.T) + (q * q).sum(1)[None], 0.0)
    n = np.linalg.norm(v, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
    return 1.0 - np.divide(v @ q.T, n, out=np.zeros_like(n), where=n > 0)


def maxsim(query: list[list[float]], tokens: Column) -> Column:
    """Sum over the query's vectors of the best product with a token; an empty document scores 0."""

    def best(one: list[float]) -> Column:
        return F.coalesce(F.array_max(F.transform(tokens, lambda t: dot(t, as_vector(one)))), F.lit(0.0))

    return reduce(lambda a, b: a + b, map(best, query), F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def radius_box(lat: float, lon: float, metres: float) -> tuple[float, float, float, float] | None:
    """(min lat, min lon, max lat, max lon) that holds the circle; None where it meets a pole or the antimeridian."""
    d = math.degrees(metres / EARTH_M) * 1.001
    if lat - d <= -90 or lat + d >= 90:
        return None
    east = math.degrees(math.asin(min(1.0, math.sin(math.radians(d)) / math.cos(math.radians(lat))))) * 1.001
    if lon - east < -180 or lon + east > 180:
        return None
    return lat - d, lon - east, lat + d, lon + east


def grid_cell(lat: Column, lon: Column, bits: int = 8) -> Column:
    """A cell number of a 2**bits by 2**bits grid, latitude bits first."""
    n = 2**bits
    row = F.least(F.floor((lat + 90) / 180 * n), F.lit(n - 1))
    column = F.least(F.floor((lon + 180) / 360 * n), F.lit(n - 1))
    return (row * n + column).cast("long")


def in_polygon(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd ray cast over a fixed ring of (lat, lon)."""
    inside = F.lit(False)
    for (y1, x1), (y2, x2) in zip(ring, ring[-1:] + ring[:-1]):
        if y1 == y2:
            continue
        crosses = (F.lit(y1) > lat) != (F.lit(y2) > lat)
        inside = inside != (crosses & (lon < F.lit(x2 - x1) * (lat - y1) / F.lit(y2 - y1) + x1))
    return inside


def splitmix64(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = np.asarray(ids).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def partition_of(id_column: Column, partitions: int) -> Column:
    """splitmix64(id) mod partitions; an Arrow UDF, because wrapping products overflow in SQL."""

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series((splitmix64(ids.to_numpy(np.int64)) % np.uint64(partitions)).astype(np.int32))

    return place(id_column)


def fnv1a(data: bytes, bits: int = 32) -> int:
    prime, value = (0x01000193, 0x811C9DC5) if bits == 32 else (0x100000001B3, 0xCBF29CE484222325)
    for b in data:
        value = (value ^ b) * prime % 2**bits
    return value


def fnv1a_many(texts: list[bytes], bits: int = 64) -> np.ndarray:
    """FNV-1a of many texts at once, of 64 bits as signed numbers: all texts take a step together, but those over ``STEPS`` bytes, so that
    memory goes by the bytes there are."""
    prime, start, whole = (0x01000193, 0x811C9DC5, 0xFFFFFFFF) if bits == 32 else (0x100000001B3, 0xCBF29CE484222325, 2**64 - 1)
    size = np.array([len(x) for x in texts], np.int64)
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -STEPS) :]
    length, value = size[order], np.full(len(order), start, np.uint64)
    flat, first = np.frombuffer(b"".join([texts[i] for i in order]), np.uint8), np.cumsum(length) - length
    for i in range(int(length[0]) if len(order) else 0):
        live = np.searchsorted(-length, -i)
        value[:live] = (value[:live] ^ flat[first[:live] + i]) * np.uint64(prime) & np.uint64(whole)
    out = np.empty(len(texts), np.uint64)
    out[order] = value
    for i in np.flatnonzero(size > STEPS):
        out[i] = fnv1a(texts[i], bits)
    return out.view(np.int64)


#: The most bytes of a text that is hashed beside others.
STEPS = 64


# quantization


def sq8(v: Column) -> Column:
    """Signed bytes: round(clamp(x, -1, 1) * 127), halves away from zero."""
    return F.transform(v, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 127).cast("int"))


def sq8_distance(codes: Column, q: Column) -> Column:
    return F.lit(1.0) - dot(codes, q) / 127


def bq_words(v: Column, dim: int) -> Column:
    """Sign bits in 32-bit words, lowest bit first."""

    def word(w: int) -> Column:
        bits = [F.when(F.element_at(v, i + 1) > 0, F.lit(1 << (i % 32))).otherwise(F.lit(0)) for i in range(32 * w, min(dim, 32 * w + 32))]
        total = bits[0].cast("long")
        for b in bits[1:]:
            total = total + b
        return total

    return F.array(*[word(w) for w in range(-(-dim // 32))])


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
