"""Application operators: prompts, caches, memories, request logs, partitions and named calls."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import fnv1a_many, partition_of
from . import points, search

_operators: dict[str, tuple[str, Callable]] = {}


def register(name: str, kind: str, handler: Callable) -> None:
    """Name an operator; kind is RO or RW."""
    if kind not in ("RO", "RW"):
        raise ValueError(f"unknown kind {kind!r}")
    if name in _operators:
        raise ValueError(f"{name} exists")
    _operators[name] = (kind, handler)


def registered() -> list[str]:
    return sorted(_operators)


def call(name: str, *args, **more) -> DataFrame:
    try:
        return _operators[name][1](*args, **more)
    except KeyError:
        raise ValueError(f"no operator {name}") from None


@dataclass(frozen=True)
class Procedure:
    """A registered version of a stored procedure."""

    name: str
    version: int
    kind: str
    fingerprint: str
    handler: Callable


_procedures: dict[str, list[Procedure]] = {}


def register_procedure(name: str, kind: str, source: str, handler: Callable) -> Procedure:
    """Register a procedure's next version. The same source again is the version that exists; a name keeps its kind."""
    if kind not in ("RO", "RW"):
        raise ValueError(f"unknown kind {kind!r}")
    versions, fingerprint = _procedures.setdefault(name, []), hashlib.sha256(source.encode()).hexdigest()
    if versions and versions[-1].kind != kind:
        raise ValueError(f"{name} is {versions[-1].kind}")
    if versions and versions[-1].fingerprint == fingerprint:
        return versions[-1]
    versions.append(Procedure(name, len(versions) + 1, kind, fingerprint, handler))
    return versions[-1]


def procedure_version(name: str, version: int = 0) -> Procedure:
    """A version of a procedure; 0 is the newest."""
    versions = _procedures.get(name, [])
    if not versions or version > len(versions):
        raise ValueError(f"no procedure {name} {version or ''}".strip())
    return versions[(version or len(versions)) - 1]


def prompt(contexts: DataFrame, question: str) -> DataFrame:
    """One numbered, cited context for a question out of a bounded list (rank from 0, source, content)."""
    line = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] ("), F.col("source"), F.lit(") "), F.col("content"))
    joined = contexts.agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return joined.select(F.concat(F.array_join(F.col("lines.line"), "\n"), F.lit("\n\nQuestion: " + question)).alias("prompt"))


def scope_key(*parts: Column) -> Column:
    """A hash of what makes cached answers interchangeable."""
    return F.xxhash64(*[F.coalesce(p.cast("string"), F.lit("\0")) for p in parts])


def memory_id(namespace: Column, key: Column) -> Column:
    """Equal namespace and key give an equal id, so remembering twice is an upsert."""
    return F.xxhash64(namespace, key)


def cacheable(temperature: Column, most: float = 0.0, stream: Column | None = None) -> Column:
    """Whether an answer may be cached: its temperature (0 if not given) is at most ``most``."""
    return F.coalesce(temperature, F.lit(0.0)) <= most


#: What a chat request is read as; a message's content may be a text or a list of parts, which only a text is cached for.
REQUEST = "model string, temperature double, n int, messages array<struct<role:string,content:variant>>, tools array<struct<function:struct<name:string>>>"

#: Members that are the prompt, or how the answer is sent, and do not part cached answers.
UNSCOPED = ("messages", "stream", "stream_options")


def cache_identity(log: DataFrame, column: str, most: float = 0.0, tenant_name: str = "") -> DataFrame:
    """``log`` with eligible, prompt and scope of each chat request, which is JSON text.

    The prompt is all messages but the system's, each as role, NUL, content and a record separator. Requests with equal scope may share answers: it
    is a hash of model, system messages, tool names in order of name, tenant and all other members of the body. A request is not eligible
    if its temperature is over ``most``, if it asks for several choices or stream options, if a content is no text, or if it is no request.
    """
    known = log.withColumns({"_r": F.from_json(column, REQUEST), "_body": F.from_json(column, "map<string,string>")})
    messages = F.coalesce(F.col("_r.messages"), F.array())
    is_text = lambda m: F.coalesce(F.schema_of_variant(m["content"]) == "STRING", F.lit(False))
    content = lambda m: F.try_variant_get(m["content"], "$", "string")
    spoken = F.transform(F.filter(messages, lambda m: m["role"] != "system"), lambda m: F.concat(m["role"], F.lit("\x00"), F.coalesce(content(m), F.lit("")), F.lit("\x1e")))
    system = F.transform(F.filter(messages, lambda m: m["role"] == "system"), content)
    tools = F.array_sort(F.transform(F.coalesce(F.col("_r.tools"), F.array()), lambda t: t["function"]["name"]))
    extra = F.array_sort(F.map_entries(F.map_filter("_body", lambda k, _: ~k.isin(*UNSCOPED))))
    eligible = F.col("_r.model").isNotNull() & (F.size(messages) > 0) & F.forall(messages, is_text) & (F.coalesce("_r.n", F.lit(1)) <= 1)
    eligible = eligible & ~F.coalesce(F.map_contains_key("_body", F.lit("stream_options")), F.lit(False)) & cacheable(F.col("_r.temperature"), most)
    scope = scope_key(F.col("_r.model"), F.to_json(system), F.to_json(tools), F.lit(tenant_name), F.to_json(extra))
    return known.withColumns({"eligible": F.coalesce(eligible, F.lit(False)), "prompt": F.array_join(spoken, ""), "scope": scope}).drop("_r", "_body")


def external_id(name: Column) -> Column:
    """A point id of an external one: digits stand for themselves as far as a long holds them, any other text for 64 bits of its SHA-256."""
    hashed = F.conv(F.substring(F.sha2(name, 256), 1, 16), 16, -10).cast("long")
    digits = F.when(name.rlike("^[0-9]{1,19}$"), name.try_cast("long"))
    return F.coalesce(digits, hashed)


def chunk_id(source: Column, index: Column) -> Column:
    """FNV-1a of 64 bits over source#index, as a signed long; 0, which means none, becomes 1. Arrow, because wrapping products overflow in SQL."""

    @F.pandas_udf("long")
    def number(names: pd.Series) -> pd.Series:
        return pd.Series(fnv1a_many([x.encode() for x in names])).where(lambda x: x != 0, 1)

    return number(F.concat(source, F.lit("#"), index.cast("string")))


class Embedder:
    """Texts -> vectors by a function over lists of texts, called once for each Arrow batch."""

    def __init__(self, dim: int, embed: Callable[[list[str]], np.ndarray]):
        self.dim, self.embed = dim, embed

    def column(self, text: Column) -> Column:
        dim, embed = self.dim, self.embed

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            found = np.asarray(embed([x or "" for x in texts]), float).reshape(len(texts), -1)
            if found.shape[1] != dim:
                raise ValueError(f"an embedder of {dim} dimensions gave {found.shape[1]}")
            return pd.Series(list(found))

        return run.asNondeterministic()(text)  # else a condition on the vector is moved below joins and embeds every text once more

    def one(self, text: str) -> list[float]:
        return np.asarray(self.embed([text]), float)[0].tolist()


def hash_embedder(dim: int = 64) -> Embedder:
    """Deterministic vectors without a model: each word adds 1 to the dimension that its FNV-1a number picks; unit length."""

    place: dict[str, int] = {}  # of the words so far; emptied when they are many

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for begin in range(0, len(texts), 16):
            words = [text.lower().split() for text in texts[begin : begin + 16]]
            if len(place) > 500_000:
                place.clear()
            fresh = [w for w in set().union(*words) if w not in place]
            place.update(zip(fresh, (fnv1a_many([w.encode() for w in fresh], 32) % dim).tolist()))
            for row, own in zip(out[begin:], words):
                row += np.bincount(np.fromiter(map(place.__getitem__, own), np.int64, len(own)), minlength=dim)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, length, out=out, where=length > 0)

    return Embedder(dim, embed)


class TextStore:
    """Texts in, texts out: a table (id, content, ...) searched by embedding."""

    def __init__(self, texts: DataFrame, embedder: Embedder, metric: str = "cosine"):
        self.texts, self.embedder, self.metric = texts, embedder, metric

    def add(self, rows: DataFrame, seq: str | None = None) -> "TextStore":
        return TextStore(points.upsert(self.texts, rows, seq), self.embedder, self.metric)

    def delete(self, ids: DataFrame) -> "TextStore":
        return TextStore(points.delete(self.texts, ids), self.embedder, self.metric)

    def _embedded(self) -> DataFrame:
        return self.texts.withColumn("vector", self.embedder.column(F.col("content")))

    def search(self, text: str, k: int = 10, filter=None) -> DataFrame:
        return search.knn(self._embedded(), self.embedder.one(text), k, self.metric, filter).drop("vector")

    def search_groups(self, text: str, key: str, k: int, size: int = 1) -> DataFrame:
        return search.search_groups(self._embedded(), self.embedder.one(text), key, k, size, metric=self.metric).drop("vector")


def merge_degraded(answers: DataFrame) -> DataFrame:
    """(degraded, missing) of partial answers (answered boolean, missing array): the partitions that any of them lacks, in order, once each."""
    return answers.select(F.explode_outer("missing").alias("m")).agg(F.array_sort(F.collect_set("m")).alias("missing")).select((F.size("missing") > 0).alias("degraded"), "missing")


def fan_out(parts: dict[int, DataFrame | None], k: int, strict: bool = False) -> tuple[DataFrame, list[int]]:
    """Hits of all partitions merged by distance, and the partitions that gave none because they were not there; ``strict`` fails instead."""
    missing = sorted(p for p, frame in parts.items() if frame is None)
    there = [frame for frame in parts.values() if frame is not None]
    if missing and strict or not there:
        raise ValueError(f"partitions {missing} are missing")
    return reduce(DataFrame.unionByName, there).orderBy("distance", "id").limit(k), missing


def tenant(name: Column, default: str = "default") -> tuple[Column, Column]:
    """<tenant>/<collection>; a bare name belongs to the default tenant."""
    slash = F.instr(name, "/")
    return F.when(slash > 0, F.substring_index(name, "/", 1)).otherwise(F.lit(default)), F.substr(name, slash + 1)


def partitioned(points: DataFrame, partitions: int) -> DataFrame:
    """Points with the partition that owns their id; writing with partitionBy("part") reshards them."""
    return points.withColumn("part", partition_of(F.col("id"), partitions))


def chat_requests(log: DataFrame, column: str) -> DataFrame:
    """Model, temperature and messages of logged chat requests."""
    schema = "model string, temperature double, stream boolean, messages array<struct<role:string,content:string>>"
    return log.withColumn("request", F.from_json(column, schema)).select("*", "request.*").drop("request")


def streamed_answers(deltas: DataFrame, request: str = "request_id", order: str = "index", text: str = "delta") -> DataFrame:
    """Streamed pieces of each answer joined in order."""
    pieces = deltas.groupBy(request).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("pieces"))
    return pieces.select(request, F.array_join(F.col(f"pieces.{text}"), "").alias("answer"))


def procedure(rows: DataFrame, key: str, handler: Callable, schema: str) -> DataFrame:
    """A stored procedure: ``handler`` gets the rows of one key as pandas and returns change rows.

    It sees a key's rows at once, so a key must fit in a task; reduce the rows of hot keys first where the handler allows it.
    """
    return rows.groupBy(key).applyInPandas(handler, schema)


def prometheus(stats: DataFrame, prefix: str, label: str) -> DataFrame:
    """Counters of a small statistics table as exposition lines."""
    names = [c for c in stats.columns if c != label]
    line = lambda c: F.format_string(f'{prefix}_{c}{{{label}="%s"}} %s', F.col(label).cast("string"), F.col(c).cast("string"))
    return stats.select(F.explode(F.array(*map(line, names))).alias("line"))


def pooled(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
    width = F.size(kept[0])
    total = F.aggregate(kept, F.array_repeat(F.lit(0.0), width), lambda s, t: F.zip_with(s, t, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.size(kept))


def savings(log: DataFrame) -> DataFrame:
    """Hits, misses and saved tokens of a cache log (hit boolean, tokens)."""
    return log.agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("tokens"))), F.lit(0)).alias("tokens_saved")
    )
