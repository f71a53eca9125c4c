"""Filter language, scans, scrolling and aggregates."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import kv, points, scroll
from ..plans import filters as L
from .base import PLACES, dense, docs, kv_log, multi, named, places, query, rated, table, tidy


def admitted(df, tree, *columns, nulls="absent"):
    return L.where(df, tree, nulls).select(*(columns or ("id",)))


DOCS = "(SELECT doc_id AS id, text AS content, lang, source, n_chars FROM documents)"
RATED = "(SELECT d.doc_id AS id, lang, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"SELECT id FROM {DOCS} WHERE lang = 'en' AND n_chars > 1000 AND TRUE")
def f1_and(spark, d):
    return admitted(docs(spark, d), L.and_(L.eq("lang", "en"), L.gt("n_chars", 1000), L.and_()))


@query(f"SELECT id FROM {DOCS} WHERE lang = 'fr' OR n_chars < 200 OR FALSE")
def f2_or(spark, d):
    return admitted(docs(spark, d), L.or_(L.eq("lang", "fr"), L.lt("n_chars", 200), L.or_()))


@query(f"SELECT id FROM {RATED} WHERE NOT coalesce(quality = 1, FALSE)")
def f3_not_matches_absent(spark, d):
    return admitted(rated(spark, d), L.not_(L.eq("quality", 1)))


@query(f"SELECT id FROM {RATED} WHERE quality = 0")
def f4_eq(spark, d):
    return admitted(rated(spark, d), L.eq("quality", 0))


@query(f"SELECT id FROM {RATED} WHERE quality IS NOT NULL AND quality <> 0")
def f5_ne_strict_exists(spark, d):
    return admitted(rated(spark, d), L.ne("quality", 0))


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice::DOUBLE >= 1000.5 AND o_totalprice::DOUBLE < 50000 AND o_orderstatus > 'F' AND o_orderstatus <= 'P'")
def f6_ranges(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_orderkey", "id")
    tree = L.and_(L.gte("o_totalprice", 1000.5), L.lt("o_totalprice", 50000), L.gt("o_orderstatus", "F"), L.lte("o_orderstatus", "P"))
    return admitted(orders, tree)


@query(f"SELECT id FROM {DOCS} WHERE lang IN ('de', 'es')")
def f7_in(spark, d):
    return admitted(docs(spark, d), L.in_("lang", ["de", "es", 3]))


@query("SELECT doc_id AS id FROM documents WHERE list_contains(string_split(lower(source), 'c'), '1')")
def f8_contains(spark, d):
    return admitted(docs(spark, d).withColumn("parts", F.split(F.lower("source"), "c")), L.contains("parts", "1"))


@query(r"SELECT doc_id AS id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'), ['the', 'of'])")
def f9_match(spark, d):
    return admitted(docs(spark, d), L.leaf("match", "content", "The, OF"))


@query(r"SELECT doc_id AS id FROM documents WHERE regexp_matches(text, '[Ll]icen[cs]ed? under')")
def f10_regex(spark, d):
    return admitted(docs(spark, d), L.leaf("regex", "content", "(?P<word>[Ll]icen[cs]ed?) under"))


@query(f"SELECT id FROM {RATED} WHERE toxic IS NULL")
def f11_is_empty(spark, d):
    return admitted(rated(spark, d), L.leaf("is_empty", "toxic"))


@query(f"SELECT id FROM {RATED} WHERE toxic IS NULL AND n_chars > 500")
def f12_is_null(spark, d):
    return admitted(rated(spark, d), L.and_(L.leaf("is_null", "toxic"), L.gt("n_chars", 500)), nulls="present")


@query("SELECT event_id AS id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:30:00'")
def f13_datetime(spark, d):
    events = table(spark, d, "events").withColumnRenamed("event_id", "id")
    return admitted(events, L.and_(L.leaf("dt_gte", "ts", "2024-01-05T00:00:00Z"), L.leaf("dt_lt", "ts", "2024-01-20T14:30:00+02:00")))


HAVERSINE = "2 * 6371000.0 * asin(sqrt(least(1.0, power(sin((radians({1}) - radians({0})) / 2), 2) + cos(radians({0})) * cos(radians({1})) * power(sin(radians({3} - ({2})) / 2), 2))))"


@query(f"SELECT id FROM {PLACES} WHERE {HAVERSINE.format('lat', '10', 'lon', '20')} <= 3000000")
def f14_geo_radius(spark, d):
    return admitted(places(spark, d), L.leaf("geo_radius", "geo", lat=10, lon=20, radius_m=3_000_000))


@query(f"SELECT id FROM {PLACES} WHERE lat BETWEEN -20 AND 35.5 AND lon BETWEEN -60 AND 40")
def f15_geo_box(spark, d):
    return admitted(places(spark, d), L.leaf("geo_bounding_box", "geo", min_lat=-20, max_lat=35.5, min_lon=-60, max_lon=40))


RING = [(0.0, 0.0), (60.0, 10.0), (30.0, 40.0), (55.5, 80.0), (-10.0, 70.0)]
EDGE = " + ".join(
    f"(CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < {x2 - x1} * (lat - {y1}) / ({y2 - y1}) + {x1} THEN 1 ELSE 0 END)" for (y1, x1), (y2, x2) in zip(RING, RING[-1:] + RING[:-1])
)


@query(f"SELECT id FROM (SELECT id, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM {PLACES}) WHERE ({EDGE}) % 2 = 1")
def f16_geo_polygon(spark, d):
    return admitted(places(spark, d), L.leaf("geo_polygon", "geo", polygon=[x for p in RING for x in p]))


@query(f"SELECT id FROM {DOCS} WHERE NOT (lang = 'en' OR n_chars BETWEEN 100 AND 900 AND source IN ('src0', 'src1'))")
def f18_json_tree(spark, d):
    """A nested tree in JSON, groups with their members under their own names and values tagged with their kinds."""
    leaf = lambda op, field, **value: {"op": op, "field": field, "value": value}
    inner = [leaf("gte", "n_chars", kind="int", int=100), leaf("lte", "n_chars", kind="float", flt=900.0), leaf("in", "source", kind="strings", strs=["src0", "src1"])]
    either = {"op": "or", "or": [leaf("eq", "lang", kind="string", str="en"), {"op": "and", "and": inner}], "value": {"kind": "none"}}
    return admitted(docs(spark, d), json.dumps({"op": "not", "not": either}))


@query(f"SELECT id FROM {PLACES} WHERE lat BETWEEN 0 AND 35.5 AND lon BETWEEN -60 AND 40 OR {HAVERSINE.format('lat', '10', 'lon', '0')} <= 1000000")
def f18_json_geo(spark, d):
    """Regions under ``geo``; a coordinate that is left out is 0."""
    box = {"op": "geo_bounding_box", "field": "geo", "geo": {"max_lat": 35.5, "min_lon": -60, "max_lon": 40}}
    circle = {"op": "geo_radius", "field": "geo", "geo": {"center_lat": 10, "radius_m": 1_000_000}}
    return admitted(places(spark, d), json.dumps({"op": "or", "or": [box, circle]}))


NOW = 1_705_000_000_000


@query(f"SELECT event_id AS id FROM events WHERE event_type <> 'click' OR (epoch_us(ts) // 1000) + 3600000 > {NOW}")
def f19_live_view(spark, d):
    return points.live(kv_log(spark, d), NOW).select(F.col("seq").alias("id"))


# scans and reads by id


@query("SELECT vec_id AS id, label, len(embedding)::INTEGER AS dim FROM embeddings")
def s1_scan_vectors(spark, d):
    return dense(spark, d).select("id", "label", F.size("vector").alias("dim"))


@query("SELECT vec_id AS id, 4 AS tokens, round(embedding[17]::DOUBLE, 6) AS second_token FROM embeddings")
def s2_scan_multivector(spark, d):
    return tidy(multi(spark, d), "id", F.size("tokens").alias("tokens"), F.col("tokens")[1][0].cast("double").alias("second_token"))


@query("SELECT doc_id AS id, text AS content, lang FROM documents WHERE doc_id = 0")
def s3_get(spark, d):
    return points.get(docs(spark, d), 0, ["id", "content", "lang"])


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id = 42")
def s4_get_projected(spark, d):
    return points.get(docs(spark, d), 42, ["id", "source"])


@query("SELECT w.id::BIGINT AS id, d.lang, d.doc_id IS NULL AS missing FROM (VALUES (1), (5), (-3), (99999999)) w(id) LEFT JOIN documents d ON d.doc_id = w.id")
def s5_get_batch(spark, d):
    found, missing = points.get_batch(docs(spark, d), spark.createDataFrame([(1,), (5,), (-3,), (99999999,)], "id long"))
    return found.select("id", "lang", F.lit(False).alias("missing")).unionByName(missing.select("id", F.lit(None).cast("string").alias("lang"), F.lit(True).alias("missing")))


@query("SELECT count(*) > 0 AS found FROM documents WHERE doc_id = 5")
def s6_exists(spark, d):
    return points.get(docs(spark, d), 5, ["id"]).agg((F.count("*") > 0).alias("found"))


@query(f"SELECT id FROM {DOCS} WHERE id > 100 AND lang = 'en' ORDER BY id LIMIT 21")
def s7_scroll_by_id(spark, d):
    return scroll.scroll(docs(spark, d), 20, filter=L.eq("lang", "en"), after_id=100).select("id")


@query("SELECT vec_id AS id, len(embedding[1:32])::INTEGER AS lft, vec_id % 7 <> 0 AS has_right FROM embeddings WHERE vec_id IN (7, 8)")
def s12_named_get(spark, d):
    rows = named(spark, d).where("id IN (7, 8)")
    return rows.select("id", F.size(F.col("vectors")["left"]).alias("lft"), F.col("vectors")["right"].isNotNull().alias("has_right"))


# orders and cursors

ORDERS = "(SELECT o_orderkey AS id, o_totalprice::DOUBLE AS price, o_orderstatus AS status, o_orderdate AS day FROM orders)"


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("day"))


def numbered(df, *keys):
    from pyspark.sql import Window

    return df.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))  # one page


@query(f"SELECT row_number() OVER (ORDER BY price DESC, id) AS rank, id, price FROM {ORDERS} ORDER BY rank LIMIT 26")
def o1_order_numeric(spark, d):
    page = scroll.scroll(orders(spark, d), 25, [{"field": "price", "desc": True}])
    return tidy(numbered(page, F.desc("price"), "id"), "rank", "id", "price")


@query(f"SELECT row_number() OVER (ORDER BY status, id) AS rank, id, status FROM {ORDERS} ORDER BY rank LIMIT 26")
def o2_order_string(spark, d):
    return tidy(numbered(scroll.scroll(orders(spark, d), 25, [{"field": "status", "kind": "string"}]), "status", "id"), "rank", "id", "status")


@query(f"SELECT row_number() OVER (ORDER BY status DESC, price, id) AS rank, id, status, price FROM {ORDERS} ORDER BY rank LIMIT 26")
def o3_order_multi(spark, d):
    page = scroll.scroll(orders(spark, d), 25, [{"field": "status", "kind": "string", "desc": True}, {"field": "price"}])
    return tidy(numbered(page, F.desc("status"), "price", "id"), "rank", "id", "status", "price")


@query(f"SELECT id, status, price FROM (SELECT *, row_number() OVER (ORDER BY status DESC, price, id) AS r FROM {ORDERS}) WHERE r BETWEEN 51 AND 101")
def o4_resume_cursor(spark, d):
    order = [{"field": "status", "kind": "string", "desc": True}, {"field": "price"}]
    _, cursor = scroll.page(orders(spark, d), 50, order)
    return tidy(scroll.scroll(orders(spark, d), 50, order, cursor=cursor), "id", "status", "price")


@query(f"SELECT id, price FROM {ORDERS} WHERE price <= 30000 ORDER BY price DESC, id LIMIT 11")
def o5_start_from(spark, d):
    return tidy(scroll.scroll(orders(spark, d), 10, [{"field": "price", "desc": True}], start_from=30000), "id", "price")


@query("SELECT count(*) > 40 AS has_more FROM documents WHERE lang = 'fr'")
def o9_has_more(spark, d):
    page = scroll.scroll(docs(spark, d), 40, filter=L.eq("lang", "fr"))
    return page.agg((F.count("*") > 40).alias("has_more"))


# aggregates


@query("SELECT count(*) AS points, count(*) FILTER (vec_id % 7 <> 0) AS with_right FROM embeddings")
def a1_counts(spark, d):
    return named(spark, d).agg(F.count("*").alias("points"), F.count_if(F.col("vectors")["right"].isNotNull()).alias("with_right"))


@query("SELECT CASE event_type WHEN 'purchase' THEN 'del' WHEN 'click' THEN 'expire' ELSE 'put' END AS op, count(*) AS n FROM events GROUP BY 1")
def a2_stats(spark, d):
    return kv.stats(kv_log(spark, d))


BUCKET = "CASE " + " ".join(f"WHEN m < {10**i} THEN {i}" for i in range(9)) + " ELSE 9 END"


@query(f"SELECT {BUCKET}::INTEGER AS bucket, count(*) AS n, sum(m)::BIGINT AS total FROM (SELECT n_chars * 37 AS m FROM documents) GROUP BY 1")
def a3_latency_histogram(spark, d):
    return kv.histogram(docs(spark, d), F.col("n_chars") * 37)


@query("SELECT lang, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS sigma FROM documents GROUP BY lang")
def a6_lane_statistics(spark, d):
    return tidy(docs(spark, d).groupBy("lang").agg(F.avg("n_chars").alias("mean"), F.stddev_pop("n_chars").alias("sigma")), "lang", "mean", "sigma")


@query("SELECT DISTINCT source AS namespace FROM documents")
def a9_list_namespaces(spark, d):
    return docs(spark, d).select(F.col("source").alias("namespace")).distinct()


@query(f"SELECT id, round({HAVERSINE.format('lat', '48.8566', 'lon', '2.3522')}, 3) AS metres FROM {PLACES}")
def c4_haversine(spark, d):
    geo = F.col("geo")
    return places(spark, d).select("id", F.round(V.haversine_m(geo["lat"], geo["lon"], F.lit(48.8566), F.lit(2.3522)), 3).alias("metres"))


@query(f"SELECT cell::BIGINT AS cell, count(*) AS n FROM (SELECT least(floor((lat + 90) / 180 * 256), 255) * 256 + least(floor((lon + 180) / 360 * 256), 255) AS cell FROM {PLACES}) GROUP BY 1")
def c5_grid_cells(spark, d):
    geo = F.col("geo")
    return places(spark, d).select(V.grid_cell(geo["lat"], geo["lon"]).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM embeddings WHERE label IN (1, 2)) GROUP BY label")
def u4_except(spark, d):
    every = dense(spark, d)
    return points.delete(every, every.where(F.col("label").isin(1, 2))).groupBy("label").agg(F.count("*").alias("n"))
