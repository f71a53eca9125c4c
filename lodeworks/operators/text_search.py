"""BM25 full-text search over (id, content).

``search_texts`` reads texts directly: each row becomes its length and its counts of the query's terms, which is all that BM25 needs, so only
aggregates of a few numbers are shuffled. ``postings`` with ``search`` is for an index that many queries share and that is written once.
"""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LETTER, Analyzer, analyzer, is_token, one_of, stem, stems, token_pattern, tokens, without_stopwords

K1, B = 1.2, 0.75


def postings(docs: DataFrame, name: str = "") -> DataFrame:
    """(id, term, tf, dl): term counts and document length; stems are made once for each distinct term."""
    found = analyzer(name)
    held = docs.select("id", found.terms(F.col("content")).alias("_terms")).where(F.size("_terms") > 0)
    terms = held.select("id", F.size("_terms").cast("long").alias("dl"), F.explode("_terms").alias("term"))
    counted = terms.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    if found.stemming:
        stemmed = stems(counted.select("term").distinct())
        counted = counted.join(stemmed, "term").groupBy("id", "dl", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    return counted.select("id", "term", "tf", "dl")


def query_terms(text: str, name: str = "", spark=None) -> list[str]:
    """The distinct terms of a query, by the same analyzer."""
    found: Analyzer = analyzer(name)
    row = spark.range(1).select(tokens(F.lit(text)).alias("a"))
    if found.stopwords:
        row = row.select(without_stopwords(F.col("a"), found.stopwords).alias("a"))
    words = row.first()["a"]
    return list(dict.fromkeys(stem(w) if found.stemming else w for w in words))


#: Surface forms of one query's stems that are looked for inside texts; with more, postings are made.
MOST_FORMS = 2000


def _forms(docs: DataFrame, terms: list[str], found: Analyzer) -> dict[str, list[str]] | None:
    """The words of the texts that have each term as their stem; None if they are more than MOST_FORMS."""
    if not found.stemming:
        return {t: [t] * (t not in found.stopwords) for t in terms}
    # a stem begins as its word does; letters beyond ASCII are let through, as their lower case may differ
    begins = f"[{''.join(sorted({re.escape(t[0]) for t in terms if t}))}\\x{{80}}-\\x{{10FFFF}}]"
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("content"), F.lit(rf"(?<!{LETTER})(?={begins}){LETTER}++"), F.lit(0))).alias("term")).distinct()
    words = words.where(~F.col("term").isin(*found.stopwords)) if found.stopwords else words
    rows = stems(words).where(F.col("stem").isin(*terms)).limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS:
        return None
    return {t: sorted(r["term"] for r in rows if r["stem"] == t) for t in terms}


def counted_texts(docs: DataFrame, terms: list[str], name: str = "", keep: tuple[str, ...] = ()) -> DataFrame | None:
    """(id, keep, dl, tf0, tf1, ...): length and the counts of each query term in every text that has a term at all, one row a text."""
    found = analyzer(name)
    if (forms := _forms(docs, terms, found)) is None:
        return None
    # lengths and counts without making the tokens; conditions that Spark moves below them, and so works out again, are cheap ones
    token = F.lit(token_pattern(found.stopwords))
    low = docs.select("id", *keep, F.lower("content").alias("_text")).where(F.rlike("_text", token))

    def count(words: list[str]) -> Column:
        words = [w for w in words if is_token(w)]
        if not words:
            return F.lit(0)
        occurs = F.regexp_count("_text", F.lit(rf"(?<!{LETTER}){one_of(words)}(?!{LETTER})"))
        return F.when(F.contains("_text", F.lit(os.path.commonprefix(words))), occurs).otherwise(0)

    return low.select("id", *keep, F.regexp_count("_text", token).cast("long").alias("dl"), *(count(forms[t]).cast("long").alias(f"tf{i}") for i, t in enumerate(terms)))


def search_texts(docs: DataFrame, terms: list[str], k: int, name: str = "", k1: float = K1, b: float = B, admitted: Column | DataFrame | None = None, partition: str | None = None) -> DataFrame:
    """(id, score) of the k best texts; ``admitted``, a condition or a table of ids, narrows the hits but never the statistics; with
    ``partition`` each partition has its own statistics, as many rows as there are partitions."""
    k1, b = k1 or K1, b or B
    ids, admitted = (admitted, None) if isinstance(admitted, DataFrame) else (None, admitted)
    if not terms:
        return docs.select("id", F.lit(0.0).alias("score")).limit(0)
    keep = ([partition] if partition else []) + (["_admitted"] if admitted is not None else [])
    source = docs.withColumn("_admitted", admitted) if admitted is not None else docs
    rows = counted_texts(source, terms, name, tuple(keep))
    if rows is None:
        posts = postings(docs, name)
        inside = docs.where(admitted).select("id") if admitted is not None else ids
        return search(posts if not partition else posts.join(docs.select("id", partition), "id"), terms, k, k1, b, inside, partition)
    by = [partition] if partition else []
    found = [f"tf{i}" for i in range(len(terms))]
    stats = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.count_if(F.col(c) > 0).alias(f"df_{c}") for c in found))
    hits = rows.where(reduce(lambda x, y: x | y, [F.col(c) > 0 for c in found]))
    if admitted is not None:
        hits = hits.where("_admitted")
    if ids is not None:
        hits = hits.join(ids.select("id"), "id", "left_semi")
    joined = hits.join(F.broadcast(stats), by) if by else hits.crossJoin(F.broadcast(stats))  # one row, or one for each partition
    score = F.lit(0.0)
    for c in found:
        idf = F.log(1 + (F.col("n") - F.col(f"df_{c}") + 0.5) / (F.col(f"df_{c}") + 0.5))
        tf = F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        score = score + F.when(F.col(c) > 0, idf * tf).otherwise(F.lit(0.0))
    return joined.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def corpus_stats(posts: DataFrame, terms: list[str]) -> DataFrame:
    """(term, n, token_total, df): documents with a term at all, all tokens, and each query term's documents, 0 included."""
    spark = posts.sparkSession
    totals = posts.groupBy("id").agg(F.first("dl").alias("dl")).agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("token_total"))
    wanted = spark.createDataFrame([(t,) for t in terms], "term string")
    df = posts.where(F.col("term").isin(*terms)).groupBy("term").agg(F.count("*").alias("df"))
    return wanted.join(df, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")).join(F.broadcast(totals))


def search(posts: DataFrame, terms: list[str], k: int, k1: float = K1, b: float = B, admitted: DataFrame | None = None, partition: str | None = None) -> DataFrame:
    """(id, score) of the k best; ``admitted`` ids narrow the hits but never the statistics; with ``partition`` each partition has its own."""
    k1, b = k1 or K1, b or B
    if not terms:
        return posts.select("id", F.lit(0.0).alias("score")).limit(0)
    by = [partition] if partition else []
    lengths = posts.groupBy("id", *by).agg(F.first("dl").alias("dl")).groupBy(*by).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = posts.where(F.col("term").isin(*terms))
    df = hits.groupBy("term", *by).agg(F.count("*").alias("df"))
    stats = df.join(F.broadcast(lengths), by) if by else df.join(F.broadcast(lengths))
    joined = hits.join(F.broadcast(stats), ["term", *by])  # rows: query terms times partitions
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    wanted = list(dict.fromkeys(terms))
    parts = joined.groupBy("id").agg(*(F.sum(F.when(F.col("term") == t, idf * tf)).alias(f"_{i}") for i, t in enumerate(wanted)))
    # added in the order of the terms, so that equal texts have equal scores and tie
    scores = parts.select("id", reduce(lambda x, y: x + y, [F.coalesce(f"_{i}", F.lit(0.0)) for i in range(len(wanted))], F.lit(0.0)).alias("score"))
    if admitted is not None:
        scores = scores.join(admitted.select("id"), "id", "left_semi")
    return scores.orderBy(F.col("score").desc(), "id").limit(k)
