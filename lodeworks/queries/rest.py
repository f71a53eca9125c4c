"""Rows of the inventory that other queries only touch: lanes, forms of reads and writes, validation, identities and tiers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..client import Store
from ..functions import payload as P
from ..operators import apps, fusion, points, scroll, search, text_search
from ..plans import filters as L
from ..plans import query_api as A
from ..sources import files
from ..sources.catalog import Catalog, CatalogError, Config
from .base import POSTS, cosine, dense, docs, fnv32, multi, named, nearest, owner, places, q, query, rated, table, tidy, vector
from .filters import DOCS, ORDERS, RATED, orders
from .fusion import DENSE, K, MAXSIM, OUT, SPARSE, TEXT, WEIGHTS, data, dense_lane, leaf, minmax, rrf, scaled, scored_lane, sparse, sparse_lane, text_lane
from .more import LEFT
from .state import scratch
from .text import ASKED, bm25
from .vectors import CONTEXT, SEED

# reads


@query(f"SELECT id, price, status FROM {ORDERS} ORDER BY status, price DESC, id LIMIT 61")
def s8_scroll_ordered(spark, d):
    return tidy(scroll.scroll(orders(spark, d), 60, [{"field": "status", "kind": "string"}, {"field": "price", "desc": True}]), "id", "price", "status")


TOKENS4 = "SELECT vec_id AS id, t - 1 AS token, i - 1 AS pos, round(embedding[16 * (t - 1) + i]::DOUBLE, 6) AS value FROM embeddings, range(1, 5) a(t), range(1, 17) b(i)"


def flat_tokens(df):
    """Every number of every token of (id, tokens)."""
    rows = df.select("id", F.posexplode("tokens").alias("token", "v")).select("id", "token", F.posexplode("v").alias("pos", "value"))
    return tidy(rows, "id", F.col("token").cast("long").alias("token"), F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


@query(f"{TOKENS4} WHERE vec_id = 17")
def s13_multivector_get(spark, d):
    return flat_tokens(points.get(multi(spark, d), 17, ["id", "tokens"]))


@query(f"SELECT id, term AS dim, tf::DOUBLE AS weight FROM {POSTS} WHERE id = 42")
def s13_sparse_get(spark, d):
    return points.get(sparse(spark, d), 42, ["id", "dim", "weight"])


@query("SELECT r_regionkey || '.txt' AS name, length(r_name)::BIGINT AS length FROM region WHERE r_regionkey = 1 UNION ALL SELECT 'total', sum(length(r_name))::BIGINT FROM region")
def s16_list_objects(spark, d):
    """Objects of a store by prefix and altogether; a file for each region."""
    root = scratch(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in table(spark, d, "region").collect():
        out = store.create(path(f"{root}/{r['r_regionkey']}.txt"), False)
        out.write(bytearray(r["r_name"].encode()))
        out.close()
    one = files.list_objects(spark, root, "1").select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "length")
    return one.unionByName(files.list_objects(spark, root).agg(F.lit("total").alias("name"), F.sum("length").alias("length")))


@query("SELECT r_name AS content FROM region WHERE r_regionkey <> 2")
def s16_read_objects(spark, d):
    """Text objects read back; one that is not UTF-8 and one with another ending are skipped."""
    root = scratch(spark)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in table(spark, d, "region").collect():
        for name, content in ((f"{r['r_regionkey']}.md", r["r_name"].encode() if r["r_regionkey"] != 2 else b"\xff\xfe"), (f"{r['r_regionkey']}.bin", b"no text")):
            out = store.create(path(f"{root}/{name}"), False)
            out.write(bytearray(content))
            out.close()
    return files.text_files(spark, root).select("content")


@query("SELECT w.id::BIGINT AS id, e.vec_id IS NULL AS missing FROM (VALUES (3), (3), (17), (-1), (88888888)) w(id) LEFT JOIN embeddings e ON e.vec_id = w.id GROUP BY ALL")
def u5_missing_ids(spark, d):
    found, missing = points.get_batch(dense(spark, d), spark.createDataFrame([(3,), (3,), (17,), (-1,), (88888888,)], "id long"))
    return found.select("id", F.lit(False).alias("missing")).unionByName(missing.select("id", F.lit(True).alias("missing")))


@query("SELECT vec_id AS id, 'vector' AS part, i - 1 AS pos, round(embedding[i]::DOUBLE, 6) AS value FROM embeddings, range(1, 65) r(i) WHERE vec_id IN (5, 6) UNION ALL SELECT vec_id, 'label', 0, label::DOUBLE FROM embeddings WHERE vec_id IN (5, 7)")
def p2_with_flags(spark, d):
    """Point 5 with both, 6 with its vector only, 7 with its payload only."""
    every = dense(spark, d)
    get = lambda ids, vector, payload: points.projected(every.where(F.col("id").isin(*ids)), vector, payload)
    both, vectors, payloads = get([5], True, True), get([6], True, False), get([7], False, True)
    long = lambda df: df.select("id", F.lit("vector").alias("part"), F.posexplode("vector").alias("pos", "value"))
    plain = lambda df: df.select("id", F.lit("label").alias("part"), F.lit(0).alias("pos"), F.col("label").alias("value"))
    rows = [long(both), long(vectors), plain(both), plain(payloads)]
    out = rows[0].union(rows[1]).union(rows[2]).union(rows[3])
    return tidy(out, "id", "part", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value"))


@query(f"SELECT id, source FROM {DOCS} WHERE n_chars % 2 = 1 AND lang = 'en' OR n_chars > 1500 AND lang = 'en'")
def p4_live_metadata(spark, d):
    """A payload key that has expired is seen neither by a filter nor in the result."""
    payload = F.create_map(F.lit("lang"), "lang", F.lit("source"), "source")
    deadline = F.create_map(F.lit("lang"), F.when(F.col("n_chars") % 2 == 0, F.col("n_chars")).otherwise(F.lit(0)))
    live = docs(spark, d).select("id", points.live_keys(payload, deadline, 1500).alias("payload"))
    flat = live.select("id", F.col("payload")["lang"].alias("lang"), F.col("payload")["source"].alias("source"))
    return L.where(flat, L.eq("lang", "en")).select("id", "source")


# tagged payloads


def tagged(spark, d):
    """Documents with a payload map of tagged values; ``mixed`` is an int, a text or null by row, ``rated`` is absent where there is no label."""
    df = rated(spark, d)
    mixed = F.when(F.col("id") % 3 == 0, P.tagged(F.col("n_chars"), "int")).when(F.col("id") % 3 == 1, P.tagged(F.col("lang"), "string")).otherwise(P.tagged(F.lit(None), "none"))
    fixed = P.tagged_map(lang=(F.col("lang"), "string"), n=(F.col("n_chars"), "int"), share=(F.col("n_chars") / 4, "float"), parts=(F.split("source", "c"), "strings"))
    rating = F.map_filter(F.create_map(F.lit("rated"), P.tagged(F.col("quality") == 1, "bool")), lambda _, v: v["kind"] != "none")
    return df.select("id", F.map_concat(fixed, F.create_map(F.lit("mixed"), mixed), rating).alias("payload"))


@query("""SELECT doc_id AS id, '{"lang":{"kind":"string","str":"' || lang || '"},"n":{"kind":"int","int":' || n_chars || '}}' AS payload FROM documents""")
def p5_tagged_json(spark, d):
    return docs(spark, d).select("id", P.to_json(P.tagged_map(lang=(F.col("lang"), "string"), n=(F.col("n_chars"), "int"))).alias("payload"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE n_chars END AS n, CASE WHEN doc_id % 3 = 0 THEN 'int' ELSE 'string' END AS kind, CASE WHEN doc_id % 3 <> 0 THEN '' END AS text FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, n_chars, 'string', '' FROM documents WHERE doc_id % 3 <> 0")
def p5_tagged_json_with_zero_values_left_out(spark, d):
    """A writer may leave out a zero value's member; the kind tells what was meant."""
    text = F.when(F.col("id") % 3 == 0, F.lit('{"n":{"kind":"int"},"x":{"kind":"int"}}')).otherwise(
        F.concat(F.lit('{"n":{"kind":"int","int":'), F.col("n_chars").cast("string"), F.lit('},"x":{"kind":"string"}}'))
    )
    read = docs(spark, d).select("id", P.from_json(text).alias("p"))
    return read.select("id", F.col("p")["n"]["int"].alias("n"), F.col("p")["x"]["kind"].alias("kind"), F.col("p")["x"]["str"].alias("text"))


MIXED = "(id % 3 = 0 AND n_chars > 800)"


@query(f"SELECT id FROM {RATED} WHERE ({MIXED} OR id % 3 = 1 AND lang = 'en') AND NOT (quality IS NOT NULL AND quality = 1) AND n_chars / 4 <= 5000")
def p5_tagged_filter(spark, d):
    """A filter in its JSON form over tagged payloads, where one field has several kinds."""
    tree = {
        "op": "and",
        "and": [
            {"op": "or", "or": [{"op": "gt", "field": "mixed", "value": {"kind": "int", "int": 800}}, {"op": "eq", "field": "mixed", "value": {"kind": "string", "str": "en"}}]},
            {"op": "not", "not": {"op": "eq", "field": "rated", "value": {"kind": "bool", "bool": True}}},
            {"op": "lte", "field": "share", "value": {"kind": "float", "flt": 5000.0}},
        ],
    }
    return L.where_tagged(tagged(spark, d), json.dumps(tree)).select("id")


@query(f"SELECT id FROM {RATED} WHERE id % 3 = 2 AND quality IS NULL OR id % 3 = 1 AND lang <> 'de' AND quality IS NOT NULL AND quality <> 1")
def p5_tagged_null_and_absent(spark, d):
    """An explicit null is present, an absent field is not; ``ne`` asks for presence."""
    null = L.and_(L.leaf("is_null", "mixed"), L.leaf("is_empty", "rated"), L.not_(L.leaf("is_null", "rated")))
    other = L.and_(L.in_("mixed", ["en", "fr", "es"]), L.ne("rated", True))
    return L.where_tagged(tagged(spark, d), L.or_(null, other)).select("id")


# filters


BAD = {
    "unknown operator": {"op": "near", "field": "n"},
    "no field": {"op": "eq", "value": 1},
    "empty not": {"op": "not"},
    "or without members": {"op": "or"},
    "members of another group": {"op": "and", "or": []},
    "unknown member": {"op": "eq", "field": "lang", "value": "en", "filters": []},
    "scalar for in": {"op": "in", "field": "lang", "value": "en"},
    "list for eq": {"op": "eq", "field": "lang", "value": ["en"]},
    "bad pattern": {"op": "regex", "field": "lang", "value": "("},
    "bad circle": {"op": "geo_radius", "field": "geo", "geo": {"center_lat": 91, "radius_m": 5}},
    "no radius": {"op": "geo_radius", "field": "geo", "geo": {"center_lat": 9}},
    "bad time": {"op": "dt_gt", "field": "n_chars", "value": "soon"},
    "bad kind": {"op": "eq", "field": "lang", "value": {"kind": "text", "str": "en"}},
}
GOOD = {"empty": {}, "zero": {"op": "and", "value": {"kind": "none"}}, "leaf": {"op": "eq", "field": "lang", "value": {"kind": "string", "str": "en"}}, "nothing": {"op": "or", "or": []}}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', TRUE)" for n in BAD) + ", " + ", ".join(f"('{n}', FALSE)" for n in GOOD) + ") v(name, rejected)")
def f17_validation(spark, d):
    """Which trees are rejected before anything is read."""
    fields = L.fields_of(docs(spark, d).join(places(spark, d), "id"))

    def rejected(tree) -> bool:
        try:
            L.compile_filter(json.dumps(tree), fields)
        except L.FilterError:
            return True
        return False

    return spark.createDataFrame([(n, rejected(t)) for n, t in {**BAD, **GOOD}.items()], "name string, rejected boolean")


@query(f"SELECT id FROM {DOCS} WHERE (lang = 'en' OR lang IN ('de', 'fr') AND n_chars >= 500) AND n_chars < 3000 AND NOT (source = 'src1') AND source <> 'src2' AND n_chars > 50 AND n_chars <= 2900")
def f20_helpers(spark, d):
    tree = L.and_(
        L.or_(L.eq("lang", "en"), L.and_(L.in_("lang", ["de", "fr"]), L.gte("n_chars", 500))),
        L.lt("n_chars", 3000), L.not_(L.eq("source", "src1")), L.ne("source", "src2"), L.gt("n_chars", 50), L.lte("n_chars", 2900),
    )
    return L.where(docs(spark, d), tree).select("id")


@query(f"SELECT id FROM {DOCS} WHERE lang IN ('en', 'de') AND n_chars >= 300 AND n_chars < 2000 OR source NOT IN ('src0', 'src1') AND lang = 'es'")
def f20_dollar_filters(spark, d):
    """A tree of a dictionary with dollar operators."""
    tree = L.from_equalities({"$or": [{"lang": ["en", "de"], "n_chars": {"$gte": 300, "$lt": 2000}}, {"source": {"$nin": ["src0", "src1"]}, "lang": "es"}]})
    return L.where(docs(spark, d), tree).select("id")


@query(f"SELECT id FROM {DOCS} WHERE (lang = 'en' OR lang = 'fr') AND n_chars > 200 AND NOT (source = 'src3') AND source NOT IN ('src4')")
def a11_filter_documents(spark, d):
    """A tree of a condition dictionary."""
    leaf = lambda f, op, v: {"field": f, "operator": op, "value": v}
    tree = L.from_conditions({"operator": "AND", "conditions": [
        {"operator": "OR", "conditions": [leaf("meta.lang", "==", "en"), leaf("meta.lang", "==", "fr")]}, leaf("meta.n_chars", ">", 200),
        {"operator": "NOT", "conditions": [leaf("meta.source", "==", "src3")]}, leaf("meta.source", "not in", ["src4"]),
    ]})
    return L.where(docs(spark, d), tree).select("id")


@query(r"SELECT doc_id AS id FROM documents WHERE list_has_all(string_split_regex(lower(text), '[^\p{L}\p{Nd}]+'), ['license', 'the'])")
def c7_filter_tokens(spark, d):
    """The words that a match filter compares."""
    wanted = L.words_of(F.lit("THE, license; the"))
    return docs(spark, d).where(F.size(F.array_except(wanted, L.words_of(F.col("content")))) == 0).select("id")


# writes


def staged(spark, d):
    """A catalog with a collection of even ids and two staged batches: one of all ids under 100, one of the odd ones over 50, which is later."""
    catalog = Catalog(spark, scratch(spark))
    catalog.create(Config("points", 64))
    every = dense(spark, d)
    catalog.write("points", every.where("id % 2 = 0"))
    catalog.stage("points", every.where("id < 100").withColumns({"label": F.lit(100), "seq": F.lit(1).cast("long")}))
    catalog.stage("points", every.where("id % 2 = 1 AND id > 50").withColumns({"label": F.lit(200), "seq": F.lit(2).cast("long")}))
    return catalog


STAGED = "CASE WHEN vec_id % 2 = 1 AND vec_id > 50 THEN 200 WHEN vec_id < 100 THEN 100 ELSE label END"


@query(f"SELECT 'before' AS moment, vec_id AS id, label FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'after', vec_id, {STAGED} FROM embeddings")
def w11_bulk_stage_and_build(spark, d):
    """Staged rows are not seen until they are built into one new version, in which the last row of an id stays."""
    catalog = staged(spark, d)
    before = catalog.read("points", 1).select(F.lit("before").alias("moment"), "id", "label")
    catalog.build("points")
    return before.unionByName(catalog.read("points").select(F.lit("after").alias("moment"), "id", "label"))


@query("SELECT TRUE AS wrong_width_rejected, TRUE AS empty_build_rejected")
def w11_bulk_checks(spark, d):
    catalog = Catalog(spark, scratch(spark))
    catalog.create(Config("points", 32))

    def rejected(f) -> bool:
        try:
            f()
        except CatalogError:
            return True
        return False

    rows = [(rejected(lambda: catalog.stage("points", dense(spark, d))), rejected(lambda: catalog.build("points")))]
    return spark.createDataFrame(rows, "wrong_width_rejected boolean, empty_build_rejected boolean")


@query("SELECT 'cold' AS name, vec_id AS id FROM embeddings WHERE label = 1 UNION ALL SELECT 'warm', vec_id FROM embeddings WHERE label = 2")
def w20_cold_tier(spark, d):
    """Of two collections the idle one is evicted by a sweep, cannot be read, and is the same after promotion."""
    catalog, cold = Catalog(spark, scratch(spark)), scratch(spark)
    for name, label, used in (("cold", 1, 1_000), ("warm", 2, 9_500)):
        catalog.create(Config(name, 64))
        catalog.write(name, dense(spark, d).where(F.col("label") == label).select("id"))
        catalog.touch(name, used)
    swept = catalog.sweep_idle(cold, now_ms=10_000, idle_ms=5_000)
    try:
        catalog.read("cold")
        swept = []  # a cold table must not be read
    except CatalogError:
        catalog.promote("cold")
    out = [catalog.read(n).select(F.lit(n).alias("name"), "id") for n in ("cold", "warm")]
    return out[0].unionByName(out[1]).where(F.lit(swept == ["cold"]))


@query(f"{TOKENS4} WHERE vec_id % 2 = 0 OR vec_id < 40")
def w16_multivector_add_if_absent(spark, d):
    """Documents that exist keep their tokens."""
    base = multi(spark, d).where("id % 2 = 0").select("id", "tokens")
    rows = multi(spark, d).where("id < 40").select("id", F.when(F.col("id") % 2 == 0, F.slice("tokens", 1, 1)).otherwise(F.col("tokens")).alias("tokens"))
    return flat_tokens(points.insert(base, rows)[0])


@query("SELECT vec_id AS id, CASE WHEN vec_id < 50 AND vec_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN vec_id < 50 AND vec_id % 3 = 0 THEN 1 ELSE 4 END::INTEGER AS tokens FROM embeddings")
def w16_multivector_add_versioned(spark, d):
    base = multi(spark, d).select("id", "tokens", F.lit(1).cast("long").alias("version"))
    rows = base.where("id < 50").withColumns({"tokens": F.slice("tokens", 1, 1), "expected": F.when(F.col("id") % 3 == 0, 1).otherwise(4).cast("long")})
    return points.compare_and_set(base, rows)[0].select("id", "version", F.size("tokens").alias("tokens"))


@query("SELECT w.id::BIGINT AS id, e.vec_id IS NULL AS missing, CASE WHEN e.vec_id IS NOT NULL THEN 4 END::INTEGER AS tokens FROM (VALUES (1), (5), (99999999)) w(id) LEFT JOIN embeddings e ON e.vec_id = w.id")
def s13_multivector_get_batch(spark, d):
    found, missing = points.get_batch(multi(spark, d), spark.createDataFrame([(1,), (5,), (99999999,)], "id long"))
    return found.select("id", F.lit(False).alias("missing"), F.size("tokens").alias("tokens")).unionByName(missing.select("id", F.lit(True).alias("missing"), F.lit(None).cast("int").alias("tokens")))


@query("SELECT w.id::BIGINT AS id, e.vec_id IS NULL AS missing, CASE WHEN e.vec_id IS NOT NULL THEN e.vec_id % 7 <> 0 END AS has_right FROM (VALUES (7), (8), (99999999)) w(id) LEFT JOIN embeddings e ON e.vec_id = w.id")
def s12_named_get_batch(spark, d):
    found, missing = points.get_batch(named(spark, d), spark.createDataFrame([(7,), (8,), (99999999,)], "id long"))
    has = F.map_contains_key("vectors", F.lit("right"))
    return found.select("id", F.lit(False).alias("missing"), has.alias("has_right")).unionByName(missing.select("id", F.lit(True).alias("missing"), F.lit(None).cast("boolean").alias("has_right")))


def with_payload(df):
    return df.withColumn("payload", F.create_map(F.lit("label"), F.col("label").cast("string"), F.lit("old"), F.lit("x")))


PATCHED = "SELECT vec_id AS id, label::VARCHAR AS label, NULL::VARCHAR AS old, 'y' AS new FROM embeddings"


@query(PATCHED)
def w7_multivector_payload(spark, d):
    """Set, then delete keys of documents' payloads; tokens stay."""
    df = with_payload(multi(spark, d)).withColumn("payload", points.merge_payload(F.col("payload"), F.create_map(F.lit("new"), F.lit("y"))))
    df = df.withColumn("payload", points.without_keys(F.col("payload"), ["old"])).where(F.size("tokens") == 4)
    return df.select("id", *(F.col("payload")[k].alias(k) for k in ("label", "old", "new")))


@query(PATCHED)
def w7_named_payload(spark, d):
    df = with_payload(named(spark, d)).withColumn("payload", points.merge_payload(F.col("payload"), F.create_map(F.lit("new"), F.lit("y"))))
    df = df.withColumn("payload", points.without_keys(F.col("payload"), ["old"])).where(F.map_contains_key("vectors", F.lit("left")))
    return df.select("id", *(F.col("payload")[k].alias(k) for k in ("label", "old", "new")))


@query("SELECT vec_id AS id, label FROM embeddings WHERE label <> 3 AND vec_id > 30 ORDER BY label DESC, vec_id LIMIT 26")
def s8_multivector_scroll(spark, d):
    return scroll.scroll(multi(spark, d).where("id > 30"), 25, [{"field": "label", "desc": True}], filter=L.ne("label", 3)).select("id", "label")


@query("SELECT vec_id AS id, vec_id % 7 <> 0 AS has_right FROM embeddings WHERE vec_id > 30 AND label <> 3 ORDER BY vec_id LIMIT 26")
def s7_named_scroll(spark, d):
    page = scroll.scroll(named(spark, d), 25, filter=L.ne("label", 3), after_id=30)
    return page.select("id", F.map_contains_key("vectors", F.lit("right")).alias("has_right"))


# orders and cursors


@query("SELECT * FROM (VALUES ('no field', TRUE), ('unknown kind', TRUE), ('repeated', TRUE), ('start of a text', TRUE), ('start of two', TRUE), ('plain', FALSE)) v(name, rejected)")
def o6_order_validation(spark, d):
    rows = orders(spark, d)
    price, status = {"field": "price"}, {"field": "status", "kind": "string"}
    cases = {
        "no field": lambda: scroll.parse_order([{"kind": "numeric"}]), "unknown kind": lambda: scroll.parse_order([{"field": "price", "kind": "geo"}]),
        "repeated": lambda: scroll.parse_order([price, price]), "start of a text": lambda: scroll.scroll(rows, 5, [status], start_from=1),
        "start of two": lambda: scroll.scroll(rows, 5, [price, status], start_from=1), "plain": lambda: scroll.scroll(rows, 5, [price], start_from=1),
    }

    def rejected(f) -> bool:
        try:
            f()
        except scroll.CursorError:
            return True
        return False

    return spark.createDataFrame([(n, rejected(f)) for n, f in cases.items()], "name string, rejected boolean")


@query(f"SELECT ((r - 1) // 15)::INTEGER AS page, id, price FROM (SELECT *, row_number() OVER (ORDER BY status, price DESC, id) AS r FROM {ORDERS}) WHERE r <= 60")
def o7_cursor_pages(spark, d):
    """Four pages of fifteen, each from the token of the one before."""
    order, token, out = [{"field": "status", "kind": "string"}, {"field": "price", "desc": True}], None, []
    for number in range(4):
        rows, token = scroll.page(orders(spark, d), 15, order, **({"cursor": token} if token else {}))
        out += [(number, r["id"], r["price"]) for r in rows]
    return spark.createDataFrame(out, "page int, id long, price double")


# lanes


def lane_sql(first: str, second: str, by: str = "distance") -> str:
    """Both lanes with ranks and what they rank by."""
    value = "distance" if by == "distance" else "score"
    return f"""SELECT 'first' AS lane, row_number() OVER (ORDER BY {by}, id) - 1 AS rank, id, round({value}, 6) AS value FROM {first}
 UNION ALL SELECT 'second', row_number() OVER (ORDER BY score DESC, id) - 1, id, round(score, 6) FROM {second}"""


def flat_lanes(df, scored=False):
    value = F.when((F.col("lane") == "first") & F.lit(not scored), F.col("distance")).otherwise(F.col("score"))
    return tidy(df, "lane", "rank", "id", value.alias("value"))


@query(lane_sql(DENSE, SPARSE))
def j6_hybrid_lanes(spark, d):
    """Both lanes of a hybrid search, unfused."""
    return flat_lanes(fusion.lanes(dense_lane(spark, d), sparse_lane(spark, d)))


@query(lane_sql(DENSE, TEXT))
def t12_hybrid_text_lanes(spark, d):
    return flat_lanes(fusion.lanes(dense_lane(spark, d), text_lane(spark, d)))


@query(lane_sql(MAXSIM, SPARSE, "score DESC"))
def j8_multivector_lanes(spark, d):
    near = scored_lane(search.search_multivector(multi(spark, d), [vector(spark, d, 7)[:16]], K))
    return flat_lanes(fusion.lanes(near, sparse_lane(spark, d), first_scored=True), scored=True)


@query(lane_sql(LEFT, SPARSE))
def j7_named_lanes(spark, d):
    near = search.search_named(named(spark, d), "left", vector(spark, d, 7)[:32], K).select("id", "distance", F.lit(0.0).alias("score"))
    return flat_lanes(fusion.lanes(near, sparse_lane(spark, d)))


@query(OUT + rrf(DENSE, SPARSE, k=15))
def j6_hybrid(spark, d):
    """Lanes as deep as the hits that are wanted, fifty at least."""
    depth = fusion.lane_depth(15)
    near = search.knn(dense(spark, d), vector(spark, d, 7), depth).select("id", "distance", F.lit(0.0).alias("score"))
    return tidy(fusion.hybrid(near, scored_lane(search.search_sparse(sparse(spark, d), WEIGHTS, depth)), 15), "id", "score")


@query(f"SELECT id, round(distance, 6) AS distance FROM ({nearest(cosine('embedding', q(7)), 15)})")
def j6_hybrid_with_an_empty_lane(spark, d):
    """A lane without hits leaves the other as it is."""
    nothing = scored_lane(search.search_sparse(sparse(spark, d), {"nosuchterm": 1.0}, K))
    return tidy(fusion.hybrid(dense_lane(spark, d), nothing, 15), "id", "distance")


@query(f"SELECT row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, id, round(score, 6) AS score FROM {SPARSE} ORDER BY rank LIMIT 7")
def j5_rank_and_truncate(spark, d):
    return tidy(search.ranked(sparse_lane(spark, d).orderBy(F.col("score").desc(), "id").limit(7), -F.col("score")), "rank", "id", "score")


@query(OUT + scaled(f"(SELECT * FROM {scaled(DENSE, SPARSE, minmax('distance', True), minmax('score', False), 0.3, 12)})", MAXSIM, minmax("score", False), minmax("score", False), 0.3, 12))
def j11_lane_fold(spark, d):
    """Three lanes folded from the left, twelve hits kept at each step."""
    near = scored_lane(search.search_multivector(multi(spark, d), [vector(spark, d, 7)[:16]], K))
    lanes = [(dense_lane(spark, d), False), (sparse_lane(spark, d), True), (near, True)]
    return tidy(fusion.fold(lanes, "weighted", 12, alpha=0.3)[0], "id", "score")


@query(f"SELECT row_number() OVER (ORDER BY distance, id) - 1 AS rank, id FROM ({nearest(cosine('embedding', q(7)), 60)}) ORDER BY rank LIMIT 60")
def j13_lane_pool(spark, d):
    """A lane brings as many hits as the tree wants where that is over fifty."""
    tree = A.Query(prefetch=[A.Query(A.Leaf("dense", vector=vector(spark, d, 7)))])
    return tidy(search.ranked(A.run(tree, data(spark, d), 60)[0]), "rank", "id")


FOUND = f"(SELECT p.id, {CONTEXT} AS score, p.distance FROM pool p JOIN embeddings e ON e.vec_id = p.id)"


@query(f"""WITH t AS ({SEED}), pool AS ({nearest(cosine('embedding', '(SELECT v FROM t)'), 200, 'vec_id NOT IN (1, 2, 3, 4)')}),
 ctx AS (SELECT id, score FROM {FOUND} ORDER BY score DESC, distance, id LIMIT {K}) SELECT id, round(score, 6) AS score FROM {rrf(DENSE, 'ctx')}""")
def j16_discover_leaf(spark, d):
    """A discovery whose examples are ids as one lane of a tree."""
    tree = A.Query(prefetch=[leaf("dense", vector=vector(spark, d, 7)), leaf("discover", pairs=[(1, 2), (3, 4)])])
    return tidy(A.run(tree, data(spark, d), 10)[0], "id", "score")


@query(f"""WITH t AS ({SEED}) SELECT id, round(distance, 6) AS distance FROM ({nearest(cosine('embedding', '(SELECT v FROM t)'), 10)})""")
def j15_recommend_vectors_leaf(spark, d):
    """An average recommendation from vectors as a tree: nothing is left out."""
    tree = A.Query(A.Leaf("recommend", vectors=([vector(spark, d, 1), vector(spark, d, 3)], [])))
    return tidy(A.run(tree, data(spark, d), 10)[0], "id", "distance")


@query(f"SELECT id, sum(tf * CASE term WHEN 'the' THEN 0.5::DOUBLE WHEN 'von' THEN 2.0::DOUBLE WHEN 'from' THEN 1.5::DOUBLE END) AS score FROM {POSTS} WHERE term IN ('the', 'von', 'from') GROUP BY id")
def v18_sparse_accumulate(spark, d):
    """The sums of all documents, before the best are taken."""
    return search.sparse_dot(sparse(spark, d), WEIGHTS)


@query(f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM {POSTS} GROUP BY term")
def a5_corpus_statistics(spark, d):
    """Document frequency and total of every term."""
    posts = text_search.postings(docs(spark, d), "simple")
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


# partial answers


@query("SELECT unnest([1, 3, 6])::INTEGER AS missing, TRUE AS degraded")
def u6_degraded_sets(spark, d):
    """The partitions that any phase of a query lacked."""
    phases = spark.createDataFrame([([3, 1],), ([],), ([6, 3],)], "missing array<int>")
    return apps.merge_degraded(phases).select(F.explode("missing").alias("missing"), "degraded")


THERE = f"vec_id IN (SELECT id FROM {owner('(SELECT vec_id AS id FROM embeddings)', 4)} WHERE part <> 2)"


@query(f"SELECT id, round(distance, 6) AS distance, 2 AS missing FROM ({nearest(cosine('embedding', q(7)), 10, THERE)})")
def x11_fan_out(spark, d):
    """Ten of three partitions, since the fourth is not there; the answer says so."""
    owned = apps.partitioned(dense(spark, d), 4)
    parts = {p: search.knn(owned.where(F.col("part") == p), vector(spark, d, 7), 10) if p != 2 else None for p in range(4)}
    found, missing = apps.fan_out(parts, 10)
    return tidy(found.withColumn("missing", F.lit(missing[0])), "id", "distance", "missing")


# calls and identities


@query("SELECT n_regionkey AS region, count(*) AS n FROM nation GROUP BY 1")
def d1_native_operator(spark, d):
    """An operator that the caller registers; a name is taken once and its kind is checked."""
    name = f"nations_{spark.sparkContext.applicationId}_{id(spark)}"
    count = lambda df: df.groupBy(F.col("n_regionkey").alias("region")).agg(F.count("*").alias("n"))
    if name not in apps.registered():
        apps.register(name, "RO", count)
    return apps.call(name, table(spark, d, "nation"))


@query("SELECT * FROM (VALUES ('first', 1), ('same source', 1), ('new source', 2), ('newest', 2)) v(step, version)")
def d4_procedure_versions(spark, d):
    """A procedure's versions by the fingerprint of its source."""
    name = f"sum_{scratch(spark).rsplit('/', 1)[-1]}"
    one = apps.register_procedure(name, "RO", "return sum", len)
    same = apps.register_procedure(name, "RO", "return sum", len)
    two = apps.register_procedure(name, "RO", "return sum + 1", len)
    rows = [("first", one.version), ("same source", same.version), ("new source", two.version), ("newest", apps.procedure_version(name).version)]
    return spark.createDataFrame(rows, "step string, version int")


SPLIT = r"list_filter(string_split_regex(lower(text), '[ \t\n\x0b\f\r]+'), lambda w: w <> '')"


@query(f"""WITH b AS (SELECT id, b, count(*)::DOUBLE AS c FROM (SELECT doc_id AS id, unnest(list_transform({SPLIT}, lambda w: {fnv32('w')} % 64)) AS b FROM documents) GROUP BY id, b),
 v AS (SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM b), q AS (SELECT b, x FROM v WHERE id = 3)
 SELECT id, round(1 - sum(v.x * q.x), 5) AS distance FROM v JOIN q USING (b) WHERE id % 2 = 1 GROUP BY id ORDER BY round(1 - sum(v.x * q.x), 9), id LIMIT 10""")
def d6_text_store(spark, d):
    """Texts searched by text through an embedder; the even ones are deleted first."""
    every = docs(spark, d).select("id", "content")
    asked = every.where("id = 3").first()["content"]
    store = apps.TextStore(every, apps.hash_embedder(64)).delete(every.where("id % 2 = 0"))
    near = store.search(asked, 30).withColumn("r", F.round("distance", 9)).orderBy("r", "id").limit(10)
    return near.select("id", F.round("distance", 5).alias("distance"))


@query("SELECT conv_id, turn, turn <= 3 AS cacheable FROM conversations")
def c16_cacheable(spark, d):
    heat = F.when(F.col("turn") == 0, F.lit(None)).otherwise(F.col("turn") / 10.0)
    return table(spark, d, "conversations").select("conv_id", "turn", apps.cacheable(heat.cast("double"), 0.3).alias("cacheable"))


@query("""SELECT conv_id, turn, turn % 4 <> 3 AS eligible,
 CASE WHEN role = 'system' THEN '' ELSE role || chr(0) || text || chr(30) END AS prompt,
 min(conv_id * 1000 + turn) OVER (PARTITION BY CASE WHEN role = 'system' THEN text END, turn % 2, turn % 4 = 3) AS first_of_scope FROM conversations""")
def c17_cache_identity(spark, d):
    """Eligibility, prompt and scope of requests; a fourth of them asks for two choices. Streaming does not part scopes, a seed does."""
    turn = F.col("turn")
    message = F.array(F.struct("role", F.col("text").alias("content")))
    body = F.struct(F.lit("m").alias("model"), F.lit(0).alias("temperature"), message.alias("messages"), (turn % 3 == 0).alias("stream"), (turn % 2).alias("seed"), F.when(turn % 4 == 3, 2).otherwise(1).alias("n"))
    known = apps.cache_identity(table(spark, d, "conversations").select("conv_id", "turn", F.to_json(body).alias("body")), "body")
    key = F.col("conv_id") * 1000 + F.col("turn")
    firsts = known.groupBy("scope").agg(F.min(key).alias("first_of_scope"))
    return known.join(firsts, "scope").select("conv_id", "turn", "eligible", "prompt", "first_of_scope")


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY source, lang) AS first_of_memory FROM documents")
def c18_memory_ids(spark, d):
    """Which documents are one memory, since namespace and key agree."""
    keyed = docs(spark, d).select("id", apps.memory_id(F.col("source"), F.col("lang")).alias("m"))
    return keyed.join(keyed.groupBy("m").agg(F.min("id").alias("first_of_memory")), "m").select("id", "first_of_memory")


@query("SELECT 'r' || r_regionkey AS name, CASE WHEN r_regionkey = 2 THEN 'a2' ELSE '' END AS aliases FROM region WHERE r_regionkey % 2 = 0")
def s14_create_and_drop(spark, d):
    """Collections of all kinds, of which every second is dropped with its alias."""
    catalog = Catalog(spark, scratch(spark))
    keys = [r["r_regionkey"] for r in table(spark, d, "region").orderBy("r_regionkey").collect()]
    for n in keys:
        catalog.create(Config(f"r{n}", 8, kind=("dense", "mv", "named")[n % 3]))
    catalog.swap_aliases([("a1", "r1"), ("a2", "r2")])
    for n in keys:
        if n % 2:
            catalog.drop(f"r{n}")
    left = catalog.aliases()
    return spark.createDataFrame([(name, ",".join(sorted(a for a, t in left.items() if t == name))) for name in catalog.names()], "name string, aliases string")


# one object for all of it


@query(f"""SELECT 'search' AS verb, id, round(distance, 6) AS value FROM ({nearest(cosine('embedding', q(7)), 5, 'vec_id % 3 <> 0 AND label <> 2')})
 UNION ALL SELECT 'text', id, round(score, 6) FROM (SELECT * FROM {bm25(f'(SELECT * FROM {POSTS} WHERE id IN (SELECT vec_id FROM embeddings) AND id % 3 <> 0)')} ORDER BY score DESC, id LIMIT 5)
 UNION ALL SELECT 'label', label, count(*)::DOUBLE FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id IN (SELECT doc_id FROM documents) AND label = 4 GROUP BY label""")
def z1_client(spark, d):
    """A collection is written twice and thinned out, and then searched by vectors and by text through an alias."""
    store = Store(spark, scratch(spark))
    rows = dense(spark, d).join(docs(spark, d).select("id", "content"), "id", "left")
    books = store.create("books", 64)
    books.upsert(rows.where("id % 2 = 0"))
    books.insert(rows)
    books.delete(rows.where("id % 3 = 0"))
    store.alias("shelf", "books")
    shelf = store.collection("shelf")
    near = shelf.search(vector(spark, d, 7), 5, L.ne("label", 2)).select(F.lit("search").alias("verb"), "id", F.col("distance").alias("value"))
    text = shelf.search_text(ASKED, 5, "simple").select(F.lit("text"), "id", "score")
    known = shelf.table().where("label = 4 AND content IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    return tidy(near.union(text).union(known.select(F.lit("label"), F.col("label").cast("long"), F.col("n").cast("double"))), "verb", "id", "value")
