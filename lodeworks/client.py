"""One object for a collection: reads, searches and writes over a catalog's tables.

    store = Store(spark, "/data/store")
    books = store.create("books", dim=64)
    books.upsert(df)                                  # id, vector, content and any payload columns
    books.search_docs(vector, k=10, filter={"op": "eq", "field": "lang", "value": "en"})

Searches return DataFrames; writes write a new version of the table, so running readers are undisturbed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import fusion, points, scroll, search, text_search
from .plans import query_api
from .plans.filters import compile_filter, fields_of, where
from .sources.catalog import Catalog, Config


class Store:
    """Collections under a root that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.catalog = spark, Catalog(spark, root)

    def create(self, name: str, dim: int, metric: str = "cosine", kind: str = "dense") -> "Collection":
        self.catalog.create(Config(name, dim, metric, kind))
        return Collection(self, name)

    def collection(self, name: str) -> "Collection":
        """A collection by its name or an alias."""
        return Collection(self, self.catalog.resolve(name))

    def drop(self, name: str) -> None:
        self.catalog.drop(name)

    def alias(self, name: str, target: str | None) -> None:
        self.catalog.swap_aliases([(name, target)])

    def names(self) -> list[str]:
        return self.catalog.names()


class Collection:
    """A collection's verbs."""

    def __init__(self, store: Store, name: str):
        self.store, self.name, self.config = store, name, store.catalog.config(name)

    # reads

    def table(self, version: int | None = None) -> DataFrame:
        return self.store.catalog.read(self.name, version)

    def get(self, point_id: int, with_vector: bool = True, with_payload: bool = True) -> DataFrame:
        return points.projected(points.get(self.table(), point_id), with_vector, with_payload)

    def get_batch(self, ids: Sequence[int] | DataFrame) -> tuple[DataFrame, DataFrame]:
        return points.get_batch(self.table(), self._ids(ids))

    def count(self, filter=None) -> int:
        return where(self.table(), filter).count()

    def scroll(self, limit: int, order: list[dict] | None = None, filter=None, cursor: str | None = None) -> tuple[list, str | None]:
        """A page's rows and the cursor of the next one."""
        return scroll.page(self.table(), limit, order or [{"field": "id"}], filter=filter, cursor=cursor)

    # searches

    def search(self, vector: Sequence[float], k: int = 10, filter=None) -> DataFrame:
        return self.search_docs(vector, k, filter).select("id", "distance")

    def search_docs(self, vector: Sequence[float], k: int = 10, filter=None) -> DataFrame:
        return search.knn(self.table(), vector, k, self.config.metric, filter).drop("vector")

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return search.knn_batch(self.table(), queries, k, self.config.metric)

    def search_groups(self, vector: Sequence[float], key: str, groups: int, size: int = 1, filter=None) -> DataFrame:
        return search.search_groups(self.table(), vector, key, groups, size, metric=self.config.metric, filter=filter).drop("vector")

    def search_text(self, text: str, k: int = 10, analyzer: str = "", filter=None) -> DataFrame:
        """(id, score) by BM25 over the column ``content``."""
        rows = self.table()
        terms = text_search.query_terms(text, analyzer, self.store.spark)
        admitted = compile_filter(filter, fields_of(rows)) if filter else None
        return text_search.search_texts(rows, terms, k, analyzer, admitted=admitted)

    def hybrid_text(self, vector: Sequence[float], text: str, k: int = 10, method: str = "rrf", alpha: float = 0.0, analyzer: str = "") -> DataFrame:
        depth = fusion.lane_depth(k)
        near = self.search(vector, depth).withColumn("score", F.lit(0.0))
        found = self.search_text(text, depth, analyzer).select("id", F.lit(0.0).alias("distance"), "score")
        return fusion.hybrid(near, found, k, method, alpha=alpha)

    def recommend(self, positive: Sequence[int], negative: Sequence[int] = (), k: int = 10, strategy: str = "average") -> DataFrame:
        call = search.recommend if strategy == "average" else search.recommend_best_score
        return call(self.table(), positive, negative, k, self.config.metric).drop("vector")

    def discover(self, pairs: Sequence[tuple[int, int]], target: Sequence[float] | None = None, k: int = 10) -> DataFrame:
        return search.discover(self.table(), pairs, target, k, self.config.metric).drop("vector")

    def mmr(self, vector: Sequence[float], k: int = 10, lam: float = 0.5) -> DataFrame:
        return search.mmr(self.table(), vector, k, lam, metric=self.config.metric)

    def query(self, tree: query_api.Query, k: int = 0, **lanes: DataFrame) -> DataFrame:
        """A query tree over the table; ``lanes`` are further tables of ``query_api.Data``."""
        rows = self.table()
        texts = {"texts": rows} if "content" in rows.columns else {}
        return query_api.run(tree, query_api.Data(points=rows, metric=self.config.metric, **{**texts, **lanes}), k)[0]

    # writes

    def _ids(self, ids: Sequence[int] | DataFrame) -> DataFrame:
        """A stated handful of ids, or a table of them, as a table."""
        return ids.select("id") if isinstance(ids, DataFrame) else self.store.spark.createDataFrame([(i,) for i in ids], "id long")

    def _now(self, rows: DataFrame) -> DataFrame:
        """The table, or an empty one of these rows' columns before the first write."""
        written = self.store.catalog.version(self.name)
        return self.table() if written else rows.limit(0)

    def _write(self, rows: DataFrame) -> int:
        return self.store.catalog.write(self.name, rows)

    def insert(self, rows: DataFrame, seq: str | None = None) -> DataFrame:
        """Create points; returns the rows that were refused because their id exists. It reads the version before, so it does not change."""
        new, refused = points.insert(self._now(rows), rows, seq)
        self._write(new)
        return refused

    def upsert(self, rows: DataFrame, seq: str | None = None) -> int:
        return self._write(points.upsert(self._now(rows), rows, seq))

    def delete(self, ids: Sequence[int] | DataFrame) -> int:
        return self._write(points.delete(self.table(), self._ids(ids)))

    def delete_by_filter(self, tree: dict) -> int:
        return self._write(points.delete_by_filter(self.table(), tree))

    def stage(self, rows: DataFrame) -> str:
        return self.store.catalog.stage(self.name, rows)

    def build(self, seq: str = "seq") -> int:
        return self.store.catalog.build(self.name, seq=seq)
