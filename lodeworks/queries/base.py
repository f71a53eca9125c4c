"""The registry, the fixtures that queries read, and SQL fragments that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register f(spark, sf_dir) under its own name, with DuckDB SQL where that can express it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "lang", "source", "n_chars")


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with labels that some lack."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return docs(spark, sf_dir).join(labels, "id", "left")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    geo = F.struct((key * 37 % 18000 / 100 - 90).alias("lat"), (key * 73 % 36000 / 100 - 180).alias("lon"))
    return table(spark, sf_dir, "customer").select(key.alias("id"), geo.alias("geo"))


PLACES = "(SELECT c_custkey AS id, (c_custkey * 37 % 18000) / 100 - 90 AS lat, (c_custkey * 73 % 36000) / 100 - 180 AS lon FROM customer)"


def multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as four vectors of 16."""
    parts = F.array(*[F.slice("vector", 16 * i + 1, 16) for i in range(4)])
    return dense(spark, sf_dir).select("id", parts.alias("tokens"), "label")


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spaces of 32; every seventh point lacks the second."""
    left, right = F.slice("vector", 1, 32), F.slice("vector", 33, 32)
    spaces = F.when(F.col("id") % 7 == 0, F.create_map(F.lit("left"), left)).otherwise(F.create_map(F.lit("left"), left, F.lit("right"), right))
    return dense(spark, sf_dir).select("id", spaces.alias("vectors"), "label")


NAMED = "(SELECT vec_id AS id, embedding[1:32] AS lft, CASE WHEN vec_id % 7 <> 0 THEN embedding[33:64] END AS rgt, label FROM embeddings)"


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: one type of event deletes, another sets a deadline of an hour."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    op = F.when(F.col("event_type") == "purchase", "del").when(F.col("event_type") == "click", "expire").otherwise("put")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("key"), op.alias("op"), F.col("value"), ms.alias("ts_ms"),
        F.when(op == "expire", ms + 3_600_000).otherwise(F.lit(0)).cast("long").alias("expires_at_ms"),
    )


KV = """(SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'purchase' THEN 'del' WHEN 'click' THEN 'expire' ELSE 'put' END AS op,
 value, (epoch_us(ts) // 1000) AS ts_ms, CASE WHEN event_type = 'click' THEN (epoch_us(ts) // 1000) + 3600000 ELSE 0 END AS expires_at_ms FROM events)"""


def vector(spark: SparkSession, sf_dir: str, point: int) -> list[float]:
    """One point's vector."""
    return list(dense(spark, sf_dir).where(F.col("id") == point).first()["vector"])


def tidy(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns, with doubles rounded to 6 places and ranks as long."""
    out = df.select(*columns)
    for name, kind in out.dtypes:
        if kind == "double":
            out = out.withColumn(name, F.round(name, 6))
        elif name in ("rank", "hit_rank", "group_rank"):
            out = out.withColumn(name, F.col(name).cast("long"))
    return out


def q(point: int) -> str:
    return f"(SELECT embedding FROM embeddings WHERE vec_id = {point})"


def dot(a: str, b: str) -> str:
    return f"list_inner_product(({a})::DOUBLE[], ({b})::DOUBLE[])"


def cosine(a: str, b: str) -> str:
    return f"(1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


def l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(({a})::DOUBLE[], ({b})::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def nearest(distance: str, k: int, where: str = "TRUE", source: str = "embeddings", point: str = "vec_id", more: str = "") -> str:
    """(id, distance, rank from 0, more) of the k nearest."""
    return f"""SELECT *, row_number() OVER (ORDER BY distance, id) - 1 AS rank FROM
 (SELECT {point} AS id, {distance} AS distance{more} FROM {source} WHERE {where} ORDER BY distance, id LIMIT {k})"""


TOKENS = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{Nd}}]+'), lambda w: w <> '')"


def words(text: str) -> str:
    return TOKENS.format(text)


POSTS = f"""(SELECT id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY id) AS dl
 FROM (SELECT doc_id AS id, unnest({words('text')}) AS term FROM documents) GROUP BY id, term)"""


def byte_list(text: str) -> str:
    """The UTF-8 bytes of a text in SQL."""
    h = f"hex(encode({text}))"
    digit = lambda i: f"(instr('0123456789ABCDEF', substr({h}, {i}, 1)) - 1)"
    return f"list_transform(range(1, 1 + length({h}) // 2), lambda i: {digit('2 * i - 1')} * 16 + {digit('2 * i')})"


def fnv32(text: str) -> str:
    return f"list_reduce(list_prepend(2166136261::UBIGINT, ({byte_list(text)})::UBIGINT[]), lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT"


WHOLE = "18446744073709551616::UHUGEINT"


def signed(x: str) -> str:
    """An unsigned 64-bit number as a signed one."""
    return f"(CASE WHEN ({x})::HUGEINT >= 9223372036854775808 THEN ({x})::HUGEINT - 18446744073709551616 ELSE ({x})::HUGEINT END)::BIGINT"


def fnv64(text: str) -> str:
    step = f"(xor(h::UBIGINT, b::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % {WHOLE}"
    return f"list_reduce(list_prepend(14695981039346656037::UHUGEINT, ({byte_list(text)})::UHUGEINT[]), lambda h, b: {step})"


def owner(source: str, parts: int) -> str:
    """(id, part) of the ids of a source: splitmix64 mod parts."""
    times = lambda x, c: f"((({x})::UHUGEINT * {c}::UHUGEINT) % {WHOLE})::UBIGINT"
    return f"""(SELECT id, (xor(z, z >> 31) % {parts})::INTEGER AS part FROM (SELECT id, {times('xor(z, z >> 27)', 10723151780598845931)} AS z FROM
 (SELECT id, {times('xor(z, z >> 30)', 13787848793156543929)} AS z FROM (SELECT id, ((id::UHUGEINT + 11400714819323198485::UHUGEINT) % {WHOLE})::UBIGINT AS z FROM {source}))))"""


def chunk_sql(source: str, target: int, overlap: int) -> str:
    """(source, index, content) of the chunks of (source, text): paragraphs packed in turn, a long one cut with an overlap."""
    step = max(1, target - max(0, min(overlap, target - 1)))
    join = lambda x: f"list_aggregate({x}, 'string_agg', ' ')"
    cut = f"list_transform(range(0, greatest(ceil((len(w) - {target}) / {step}::DOUBLE), 0)::BIGINT + 1), lambda i: {join(f'w[i * {step} + 1 : i * {step} + {target}]')})"
    gap = r"[ \t\n\x0b\f\r\x1c-\x1f\x85\xa0]+"
    return f"""(WITH RECURSIVE par AS (SELECT source, list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10) || chr(10)),
 lambda p: list_filter(string_split_regex(p, '{gap}'), lambda w: w <> '')), lambda w: len(w) > 0) AS ps FROM {source}),
 run AS (SELECT source, ps, 1 AS p, []::VARCHAR[] AS held, []::VARCHAR[] AS done FROM par
 UNION ALL SELECT source, ps, p + 1, CASE WHEN len(w) > {target} THEN [] WHEN len(held) > 0 AND len(held) + len(w) > {target} THEN w ELSE held || w END,
 (CASE WHEN len(held) > 0 AND len(held) + len(w) > {target} THEN list_append(done, {join('held')}) ELSE done END) || (CASE WHEN len(w) > {target} THEN {cut} ELSE []::VARCHAR[] END)
 FROM (SELECT *, ps[p] AS w FROM run WHERE p <= len(ps))),
 whole AS (SELECT source, CASE WHEN len(held) > 0 THEN list_append(done, {join('held')}) ELSE done END AS cs FROM run WHERE p > len(ps))
 SELECT source, (i - 1)::INTEGER AS index, cs[i] AS content FROM whole, range(1, 100000) r(i) WHERE i <= len(cs))"""
