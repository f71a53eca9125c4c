"""Multi-stage queries: a tree of retrieval leaves combined by fusion or rerank, built as one DataFrame plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fusion, search, text_search

MOST_LANE, MOST_DEPTH, MOST_SOURCES, DEFAULT_K = 10_000, 4, 64, 10


class QueryError(ValueError):
    """A query tree that is not valid."""


@dataclass(frozen=True)
class Leaf:
    """One retrieval: dense, sparse, recommend, discover, maxsim or text."""

    kind: str
    vector: Sequence | None = None
    sparse: dict | None = None
    text: str = ""
    positive: Sequence[int] = ()
    negative: Sequence[int] = ()
    pairs: Sequence[tuple[int, int]] = ()
    vectors: tuple[Sequence, Sequence] = ((), ())  # positive and negative examples by vector
    vector_pairs: Sequence[tuple[Sequence[float], Sequence[float]]] = ()
    strategy: str = "average"
    filter: dict | None = None
    lane_k: int = 0


@dataclass(frozen=True)
class Query:
    """A leaf with prefetch sources is a rerank; sources without a leaf are fused; a leaf alone is itself."""

    leaf: Leaf | None = None
    prefetch: Sequence["Query"] = ()
    method: str = "rrf"
    alpha: float = 0.0
    rrf_k: int = 0
    k: int = 0
    lane_k: int = 0


@dataclass
class Data:
    """What leaves read: points (id, vector, ...), sparse postings (id, dim, weight), token lists, and texts (id, content) or their postings."""

    points: DataFrame | None = None
    sparse: DataFrame | None = None
    tokens: DataFrame | None = None
    posts: DataFrame | None = None
    texts: DataFrame | None = None
    metric: str = "cosine"
    analyzer: str = "simple"
    cache: dict = field(default_factory=dict)


def validate(q: Query, depth: int = 1) -> None:
    if depth > MOST_DEPTH:
        raise QueryError(f"deeper than {MOST_DEPTH}")
    if len(q.prefetch) > MOST_SOURCES:
        raise QueryError(f"more than {MOST_SOURCES} sources")
    if q.leaf is None and not q.prefetch:
        raise QueryError("neither a leaf nor a source")
    if q.method not in ("rrf", "weighted", "dbsf"):
        raise QueryError(f"unknown method {q.method!r}")
    if q.leaf and q.leaf.kind not in ("dense", "sparse", "recommend", "discover", "maxsim", "text"):
        raise QueryError(f"unknown leaf {q.leaf.kind!r}")
    for x in q.prefetch:
        validate(x, depth + 1)


def wanted(k: int) -> int:
    return k if k > 0 else DEFAULT_K


def lane_pool(q: Query, k: int) -> int:
    return min(MOST_LANE, q.lane_k or q.k or max(k, search.POOL))


def rewrite(leaf: Leaf, data: Data) -> tuple[Leaf, tuple[int, ...]]:
    """An average recommendation is a dense leaf without its examples."""
    if leaf.kind != "recommend" or leaf.strategy != "average":
        return leaf, ()
    if len(leaf.vectors[0]):
        return replace(leaf, kind="dense", vector=search.mean_target(*leaf.vectors, data.metric)), ()
    target = search.target_vector(data.points, leaf.positive, leaf.negative, data.metric)
    return replace(leaf, kind="dense", vector=target), (*leaf.positive, *leaf.negative)


def run_leaf(leaf: Leaf, data: Data, k: int, among: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """(id, distance, score) of a leaf and whether it ranks by score; ``among`` narrows it to ids (a rerank root)."""
    leaf, excluded = rewrite(leaf, data)
    inside = lambda df: df.join(among.select("id").distinct(), "id", "left_semi") if among is not None else df
    zero = F.lit(0.0)
    if leaf.kind == "dense":
        points = inside(data.points)
        if excluded:
            points = points.where(~F.col("id").isin(*excluded))
        return search.knn(points, leaf.vector, k, data.metric, leaf.filter).select("id", "distance", zero.alias("score")), False
    if leaf.kind == "recommend" and len(leaf.vectors[0]):
        found = search.recommend_by_vectors(inside(data.points), *leaf.vectors, k, data.metric, pool=lane_pool(Query(leaf), k), filter=leaf.filter)
        return found.select("id", "distance", "score"), True
    if leaf.kind == "recommend":
        found = search.recommend_best_score(inside(data.points), leaf.positive, leaf.negative, k, data.metric, pool=lane_pool(Query(leaf), k))
        return found.select("id", "distance", "score"), True
    if leaf.kind == "discover" and len(leaf.vector_pairs):
        found = search.discover_by_vectors(inside(data.points), leaf.vector_pairs, leaf.vector, k, data.metric)
        return found.select("id", "distance", "score"), True
    if leaf.kind == "discover":
        found = search.discover(inside(data.points), leaf.pairs, leaf.vector, k, data.metric)
        return found.select("id", "distance", "score"), True
    if leaf.kind == "sparse":
        posts = inside(data.sparse)
        if leaf.filter and data.points is not None:
            from .filters import compile_filter, fields_of

            posts = posts.join(data.points.where(compile_filter(leaf.filter, fields_of(data.points))).select("id"), "id", "left_semi")
        return search.search_sparse(posts, leaf.sparse, k).select("id", zero.alias("distance"), "score"), True
    if leaf.kind == "maxsim":
        return search.search_multivector(inside(data.tokens), leaf.vector, k, leaf.filter).select("id", zero.alias("distance"), "score"), True
    source = data.posts if data.texts is None else data.texts
    terms = text_search.query_terms(leaf.text, data.analyzer, source.sparkSession)
    admitted = among.select("id").distinct() if among is not None else None
    if data.texts is not None:
        return text_search.search_texts(source, terms, k, data.analyzer, admitted=admitted).select("id", zero.alias("distance"), "score"), True
    return text_search.search(source, terms, k, admitted=admitted).select("id", zero.alias("distance"), "score"), True


def run(q: Query, data: Data, k: int = 0) -> tuple[DataFrame, bool]:
    """(id, distance, score) of a tree and whether it ranks by score."""
    validate(q)
    return _run(q, data, wanted(k or q.k))


def _run(q: Query, data: Data, k: int) -> tuple[DataFrame, bool]:
    if not q.prefetch:
        return run_leaf(q.leaf, data, k)
    lanes = [_run(x, data, lane_pool(x, k)) for x in q.prefetch]
    if q.leaf is None:
        return fusion.fold(lanes, q.method, k, q.alpha, q.rrf_k)
    ids = lanes[0][0].select("id")
    for frame, _ in lanes[1:]:
        ids = ids.unionByName(frame.select("id"))
    return run_leaf(q.leaf, data, k, among=ids)


def run_grouped(q: Query, data: Data, key: str, groups: int, size: int = 1) -> DataFrame:
    """Groups of the flat result's pool, best first."""
    pool, scored = run(q, data, search.pool_size(wanted(groups) * size))
    keyed = pool.join(data.points.select("id", key), "id")
    if scored:
        keyed = keyed.withColumn("distance", -F.col("score"))
    return search.group_hits(keyed, key, wanted(groups), size)
