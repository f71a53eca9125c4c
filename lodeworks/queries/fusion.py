"""Hybrid search and query trees."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fusion, search, text_search
from ..plans import filters as L
from ..plans import query_api as A
from .base import NAMED, POSTS, cosine, dense, docs, multi, named, nearest, q, query, tidy, vector
from .text import ASKED, bm25

K = 50
DENSE = f"(SELECT vec_id AS id, {cosine('embedding', q(7))} AS distance FROM embeddings ORDER BY distance, id LIMIT {K})"
TEXT = f"(SELECT * FROM {bm25(POSTS)} ORDER BY score DESC, id LIMIT {K})"
# a sparse space: term counts of all documents
SPARSE = f"(SELECT id, sum(tf * CASE term WHEN 'the' THEN 0.5::DOUBLE WHEN 'von' THEN 2.0::DOUBLE WHEN 'from' THEN 1.5::DOUBLE END) AS score FROM {POSTS} WHERE term IN ('the', 'von', 'from') GROUP BY id ORDER BY score DESC, id LIMIT {K})"
WEIGHTS = {"the": 0.5, "von": 2.0, "from": 1.5}


def rrf(a: str, b: str, order_a: str = "distance", k: int = 10) -> str:
    return f"""(WITH a AS (SELECT *, row_number() OVER (ORDER BY {order_a}, id) AS r FROM {a}), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM {b})
 SELECT id, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score FROM a FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT {k})"""


def scaled(a: str, b: str, left: str, right: str, w: float, k: int = 10) -> str:
    return f"""(WITH a AS (SELECT id, {left} AS p FROM {a}), b AS (SELECT id, {right} AS p FROM {b})
 SELECT id, {w}::DOUBLE * coalesce(a.p, 0) + {1 - w}::DOUBLE * coalesce(b.p, 0) AS score FROM a FULL JOIN b USING (id) ORDER BY score DESC, id LIMIT {k})"""


def minmax(c: str, inverted: bool) -> str:
    top = f"max({c}) OVER () - {c}" if inverted else f"{c} - min({c}) OVER ()"
    return f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 1.0 ELSE ({top}) / (max({c}) OVER () - min({c}) OVER ()) END"


def sigma(c: str, inverted: bool) -> str:
    x = f"greatest(0, least(1, ({c} - (avg({c}) OVER () - 3 * stddev_pop({c}) OVER ())) / (6 * stddev_pop({c}) OVER ())))"
    return f"CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1.0 ELSE {'1 - ' + x if inverted else x} END"


OUT = "SELECT id, round(score, 6) AS score FROM "


def sparse(spark, d):
    posts = text_search.postings(docs(spark, d), "simple")
    return posts.select("id", F.col("term").alias("dim"), F.col("tf").cast("double").alias("weight"))


def dense_lane(spark, d):
    return search.knn(dense(spark, d), vector(spark, d, 7), K).select("id", "distance", F.lit(0.0).alias("score"))


def scored_lane(df):
    return df.select("id", F.lit(0.0).alias("distance"), "score")


def text_lane(spark, d):
    return scored_lane(text_search.search_texts(docs(spark, d), ASKED.split(), K, "simple"))


def sparse_lane(spark, d):
    return scored_lane(search.search_sparse(sparse(spark, d), WEIGHTS, K))


@query(f"SELECT row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, id, round(score, 6) AS score FROM {SPARSE} ORDER BY rank LIMIT 10")
def v17_sparse_search(spark, d):
    return tidy(search.ranked(search.search_sparse(sparse(spark, d), WEIGHTS, 10), -F.col("score")), "rank", "id", "score")


@query(OUT + rrf(DENSE, SPARSE))
def j1_rrf(spark, d):
    return tidy(fusion.fuse(dense_lane(spark, d), sparse_lane(spark, d)), "id", "score")


@query(OUT + scaled(DENSE, SPARSE, minmax("distance", True), minmax("score", False), 0.7))
def j2_weighted(spark, d):
    return tidy(fusion.fuse(dense_lane(spark, d), sparse_lane(spark, d), "weighted", alpha=0.7), "id", "score")


@query(OUT + scaled(DENSE, SPARSE, sigma("distance", True), sigma("score", False), 0.5))
def j3_dbsf(spark, d):
    return tidy(fusion.fuse(dense_lane(spark, d), sparse_lane(spark, d), "dbsf"), "id", "score")


@query(OUT + scaled(SPARSE, TEXT, minmax("score", False), minmax("score", False), 0.4))
def j4_score_lanes(spark, d):
    return tidy(fusion.fuse(sparse_lane(spark, d), text_lane(spark, d), "weighted", alpha=0.4, first_scored=True), "id", "score")


@query(OUT + rrf(DENSE, TEXT))
def t12_hybrid_text(spark, d):
    return tidy(fusion.fuse(dense_lane(spark, d), text_lane(spark, d)), "id", "score")


RIGHT = f"(SELECT id, {cosine('rgt', q(7) + '[33:64]')} AS distance FROM {NAMED} WHERE rgt IS NOT NULL ORDER BY distance, id LIMIT {K})"


@query(OUT + rrf(RIGHT, SPARSE))
def j7_named_hybrid(spark, d):
    near = search.search_named(named(spark, d), "right", vector(spark, d, 7)[32:], K).select("id", "distance", F.lit(0.0).alias("score"))
    return tidy(fusion.fuse(near, sparse_lane(spark, d)), "id", "score")


SIM = "greatest(" + ", ".join(f"1 - {cosine(f'embedding[{16 * t + 1}:{16 * t + 16}]', q(7) + '[1:16]')}" for t in range(4)) + ")"
MAXSIM = f"(SELECT vec_id AS id, {SIM} AS score FROM embeddings ORDER BY score DESC, id LIMIT {K})"


@query(OUT + rrf(MAXSIM, SPARSE, "score DESC"))
def j8_mv_hybrid(spark, d):
    near = scored_lane(search.search_multivector(multi(spark, d), [vector(spark, d, 7)[:16]], K))
    return tidy(fusion.fuse(near, sparse_lane(spark, d), first_scored=True), "id", "score")


def data(spark, d):
    return A.Data(points=dense(spark, d), sparse=sparse(spark, d), tokens=multi(spark, d), texts=docs(spark, d))


def leaf(kind, **more):
    return A.Query(A.Leaf(kind, **more), lane_k=K)


@query(OUT + rrf(rrf(DENSE, SPARSE), MAXSIM, "score DESC"))
def j9_query_fusion(spark, d):
    tree = A.Query(prefetch=[leaf("dense", vector=vector(spark, d, 7)), leaf("sparse", sparse=WEIGHTS), leaf("maxsim", vector=[vector(spark, d, 7)[:16]])])
    return tidy(A.run(tree, data(spark, d), 10)[0], "id", "score")


@query(OUT + rrf(f"(SELECT * FROM {rrf(DENSE, SPARSE, k=20)})", MAXSIM, "score DESC"))
def j9_nested_fusion(spark, d):
    inner = A.Query(prefetch=[leaf("dense", vector=vector(spark, d, 7)), leaf("sparse", sparse=WEIGHTS)], lane_k=20)
    tree = A.Query(prefetch=[inner, leaf("maxsim", vector=[vector(spark, d, 7)[:16]])])
    return tidy(A.run(tree, data(spark, d), 10)[0], "id", "score")


@query(f"SELECT id, round(distance, 6) AS distance FROM ({nearest(cosine('embedding', q(9)), 10, f'vec_id IN (SELECT id FROM {DENSE} UNION SELECT id FROM {SPARSE}) AND label <> 4')})")
def j10_query_rerank(spark, d):
    root = A.Leaf("dense", vector=vector(spark, d, 9), filter=L.ne("label", 4))
    tree = A.Query(root, prefetch=[leaf("dense", vector=vector(spark, d, 7)), leaf("sparse", sparse=WEIGHTS)])
    return tidy(A.run(tree, data(spark, d), 10)[0], "id", "distance")


@query(f"SELECT id, round(score, 6) AS score FROM {bm25(POSTS, f'id IN (SELECT id FROM {DENSE})')} ORDER BY score DESC, id LIMIT 10")
def j12_text_rerank(spark, d):
    tree = A.Query(A.Leaf("text", text=ASKED), prefetch=[leaf("dense", vector=vector(spark, d, 7))])
    return tidy(A.run(tree, data(spark, d), 10)[0], "id", "score")


@query(f"""WITH pool AS (SELECT f.id, -f.score AS distance, e.label FROM {rrf(DENSE, SPARSE, k=50)} f JOIN embeddings e ON e.vec_id = f.id),
 h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY distance, id) AS hit_rank, min(struct_pack(d := distance, i := id)) OVER (PARTITION BY label) AS best FROM pool)
 SELECT label, id, hit_rank, group_rank FROM (SELECT *, dense_rank() OVER (ORDER BY best) AS group_rank FROM h WHERE hit_rank <= 2) WHERE group_rank <= 3""")
def j14_grouped_query(spark, d):
    tree = A.Query(prefetch=[leaf("dense", vector=vector(spark, d, 7)), leaf("sparse", sparse=WEIGHTS)])
    return tidy(A.run_grouped(tree, data(spark, d), "label", 3, 2), "label", "id", "hit_rank", "group_rank")


MEAN = "SELECT list(m ORDER BY i) AS v FROM (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) WHERE vec_id IN (1, 2) GROUP BY i)"


@query(f"WITH t AS ({MEAN}) SELECT id, round(distance, 6) AS distance FROM ({nearest(cosine('embedding', '(SELECT v FROM t)'), 10, 'vec_id NOT IN (1, 2)')})")
def j15_recommend_rewrite(spark, d):
    return tidy(A.run(A.Query(A.Leaf("recommend", positive=[1, 2])), data(spark, d), 10)[0], "id", "distance")


@query(f"""WITH a AS (SELECT id, row_number() OVER (ORDER BY distance, id) - 1 AS r FROM {DENSE}), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM {SPARSE})
 SELECT id::VARCHAR AS key, round(coalesce(0.6::DOUBLE / (a.r + 1), 0) + coalesce(0.4::DOUBLE / (b.r + 1), 0), 6) AS score FROM a FULL JOIN b USING (id)
 ORDER BY coalesce(0.6::DOUBLE / (a.r + 1), 0) + coalesce(0.4::DOUBLE / (b.r + 1), 0) DESC, coalesce(a.r, 1099511627776 + b.r) LIMIT 10""")
def j19_rag_fuse(spark, d):
    keyed = lambda df: df.select(F.col("id").cast("string").alias("key"), "rank")
    near = keyed(search.ranked(dense_lane(spark, d)))
    text = keyed(search.ranked(sparse_lane(spark, d), -F.col("score")))
    return tidy(fusion.rag_fuse(near, text, 0.6, 10), "key", "score")


@query(f"SELECT DISTINCT id FROM (SELECT id FROM {DENSE} UNION ALL SELECT id FROM {SPARSE})")
def u1_candidate_union(spark, d):
    return dense_lane(spark, d).select("id").union(sparse_lane(spark, d).select("id")).distinct()


@query(f"SELECT id FROM {DENSE} INTERSECT SELECT id FROM {SPARSE}")
def u3_candidate_intersection(spark, d):
    return dense_lane(spark, d).select("id").intersect(sparse_lane(spark, d).select("id"))
