"""Operators against independent small versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import text as T
from lodeworks.functions import vectors as V
from lodeworks.operators import apps, fusion, kv, points, quant, scroll, search, text_search
from lodeworks.plans import filters as L
from lodeworks.plans import query_api as A
from lodeworks.sources import files
from lodeworks.sources.catalog import Catalog, CatalogError, Config


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 16)).round(3)
    rows = [(i, [float(y) for y in v], i % 5) for i, v in enumerate(x)]
    return x, spark.createDataFrame(rows, "id long, vector array<float>, label int").cache()


@pytest.mark.parametrize("metric", V.METRICS)
def test_knn_and_batches_agree_with_numpy(corpus, metric):
    x, df = corpus
    x = x.astype(np.float32)
    for point in (0, 17):
        expected = np.argsort(V.distances(metric, x, x[point][None])[:, 0], kind="stable")[:7].tolist()
        assert [r["id"] for r in search.knn(df, x[point], 7, metric).collect()] == expected
        found = search.knn_batch(df, df.where(f"id = {point}"), 7, metric).orderBy("rank").collect()
        assert [r["id"] for r in found] == expected
    assert search.knn(df, x[0], 0, metric).count() == 0


@pytest.mark.parametrize("metric", V.METRICS)
@pytest.mark.parametrize("queries, product", [(4096, 2048), (7, 13)])
def test_batches_in_blocks_agree_with_numpy(corpus, monkeypatch, metric, queries, product):
    x, df = corpus
    monkeypatch.setattr(search, "QUERIES", queries)  # several passes
    monkeypatch.setattr(search, "PRODUCT", product)
    d = V.distances(metric, x.astype(np.float32), x.astype(np.float32)[::17])
    expected = {(17 * j, r): int(i) for j in range(d.shape[1]) for r, i in enumerate(np.lexsort((np.arange(400), d[:, j].round(12)))[:5])}
    rows = search.knn_batch(df, df.where("id % 17 = 0"), 5, metric).collect()
    assert {(r["query_id"], r["rank"]): r["id"] for r in rows} == expected
    assert search.knn_batch(df, df.limit(0), 5, metric).count() == 0 and search.knn_batch(df.limit(0), df.where("id = 3"), 5, metric).count() == 0


def test_batches_with_ties_and_few_points(spark):
    df = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(9)], "id long, vector array<float>")
    rows = search.knn_batch(df, df.where("id = 0"), 7).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [0, 2, 4, 6, 8, 1, 3]
    assert search.knn_batch(df, df.where("id = 0"), 50).count() == 9


@pytest.mark.parametrize("metric", V.METRICS)
def test_both_distances_agree(corpus, spark, metric):
    from pyspark.sql import functions as F

    x, df = corpus
    more = df.select("id", "vector").unionByName(spark.createDataFrame([(900, None), (901, [0.0] * 16)], "id long, vector array<float>"))
    rows = more.select(V.distance(metric, F.col("vector"), V.as_vector(x[3])).alias("a"), V.distance_to(metric, F.col("vector"), x[3]).alias("b")).collect()
    assert all((r["a"] is None) == (r["b"] is None) and (r["a"] is None or abs(r["a"] - r["b"]) < 1e-9) for r in rows) and sum(r["b"] is None for r in rows) == 1
    with pytest.raises(Exception):
        search.knn(df, [1.0, 2.0], 3, metric).collect()
    with pytest.raises(ValueError):
        search.knn(df, x[0], 3, "hamming")


def test_zero_vector_and_ties(spark):
    df = spark.createDataFrame([(2, [0.0, 0.0]), (1, [0.0, 0.0]), (0, [1.0, 0.0])], "id long, vector array<float>")
    rows = search.knn(df, [1.0, 0.0], 3).collect()
    assert [(r["id"], r["distance"]) for r in rows] == [(0, 0.0), (1, 1.0), (2, 1.0)]


def test_mmr_against_a_plain_greedy_choice(corpus):
    x, df = corpus
    x = x.astype(np.float32).astype(float)
    d = V.distances("cosine", x, x[3][None])[:, 0]
    pool = np.argsort(d, kind="stable")[:50].tolist()
    chosen = [pool[0]]
    while len(chosen) < 6:
        worth = {c: 0.4 * -d[c] - 0.6 * max(-V.distances("cosine", x[c][None], x[s][None])[0, 0] for s in chosen) for c in pool if c not in chosen}
        chosen.append(max(worth, key=worth.get))
    assert [r["id"] for r in search.mmr(df, x[3], 6, 0.4).orderBy("rank").collect()] == chosen


def test_recommend_errors(corpus):
    _, df = corpus
    for bad in (([], []), ([99999], [])):
        with pytest.raises(search.SearchError):
            search.recommend(df, *bad)
    with pytest.raises(search.SearchError):
        search.recommend_best_score(df, [1], [2], metric="l2")
    with pytest.raises(search.SearchError):
        search.discover(df, [(99998, 99999)])


def lanes(spark):
    dense = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3)], "id long, distance double").selectExpr("id", "distance", "0D AS score")
    text = spark.createDataFrame([(3, 9.0), (1, 5.0), (4, 1.0)], "id long, score double").selectExpr("id", "0D AS distance", "score")
    return dense, text


def test_hybrid_lanes(spark):
    dense, text = lanes(spark)
    assert [(r["lane"], r["rank"], r["id"]) for r in fusion.lanes(dense, text).orderBy("lane", "rank").collect()] == [("first", i, i + 1) for i in range(3)] + [("second", 0, 3), ("second", 1, 1), ("second", 2, 4)]
    assert [r["id"] for r in fusion.hybrid(dense, text.limit(0), 2).collect()] == [1, 2]
    assert [r["id"] for r in fusion.hybrid(dense.limit(0), text, 2).collect()] == [3, 1]
    assert [r["id"] for r in fusion.hybrid(dense, text, 2).collect()] == [1, 3]
    assert fusion.lane_depth(10) == 50 and fusion.lane_depth(80) == 80 and fusion.lane_depth(10, 5) == 5


def test_fusion_literals(spark):
    dense, text = lanes(spark)
    got = [(r["id"], r["score"]) for r in fusion.fuse(dense, text).collect()]
    expected = [(1, 1 / 61 + 1 / 62), (3, 1 / 63 + 1 / 61), (2, 1 / 62), (4, 1 / 63)]
    assert [g[0] for g in got] == [e[0] for e in expected]
    assert np.allclose([g[1] for g in got], [e[1] for e in expected])
    weighted = {r["id"]: r["score"] for r in fusion.fuse(dense, text, "weighted", alpha=1.0).collect()}
    assert weighted == {1: 1.0, 2: pytest.approx(0.5), 3: 0.0, 4: 0.0}
    assert fusion.alpha_of(0) == 0.5 and fusion.alpha_of(7) == 1.0
    flat = text.selectExpr("id", "distance", "2D AS score")
    assert {r["score"] for r in fusion.fuse(flat, flat, "dbsf", first_scored=True).collect()} == {1.0}


def test_query_bounds(corpus):
    _, df = corpus
    leaf = A.Query(A.Leaf("dense", vector=[1.0] * 16))
    deep = leaf
    for _ in range(4):
        deep = A.Query(prefetch=[deep])
    for bad in (deep, A.Query(), A.Query(prefetch=[leaf] * 65), A.Query(prefetch=[leaf], method="sum"), A.Query(A.Leaf("graph"))):
        with pytest.raises(A.QueryError):
            A.run(bad, A.Data(points=df))
    assert A.run(leaf, A.Data(points=df))[0].count() == A.DEFAULT_K


# Words and stems of the Snowball project's sample vocabulary.
STEMS = {"caresses": "caress", "ponies": "poni", "ties": "tie", "cats": "cat", "gas": "gas", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "generalizations": "general", "consistency": "consist", "consigned": "consign", "knightly": "knight", "kneeling": "kneel", "hopping": "hop", "hoping": "hope", "dying": "die", "skies": "sky", "succeeding": "succeed", "communities": "communiti", "generously": "generous", "electricity": "electr", "national": "nation", "by": "by", "say": "say", "cry": "cri", "luxuriated": "luxuri", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "feed": "feed"}


@pytest.mark.parametrize("word", STEMS)
def test_stems(word):
    assert T.stem(word) == STEMS[word]


def test_analyzers(spark):
    assert T.analyzer() is T.analyzer("english")
    with pytest.raises(ValueError):
        T.analyzer("klingon")
    row = spark.sql("SELECT 'Don''t STOP—the Füße 42' AS t").select(T.tokens("t").alias("w")).first()
    assert row["w"] == ["don", "t", "stop", "the", "füße", "42"]


def test_chunks():
    text = "a b c\r\n\r\nd e\n\n" + " ".join(map(str, range(10)))
    assert T.chunk_text(text, 5, 2) == ["a b c d e", "0 1 2 3 4", "3 4 5 6 7", "6 7 8 9"]
    assert T.chunk_text("", 5, 2) == []


def test_cursors_cover_everything_once(spark):
    rows = [(i, i % 3, None if i % 7 == 0 else float(i % 4), math.nan if i % 5 == 0 else 1.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a int, b double, c double")
    order = [{"field": "a", "desc": True}, {"field": "b"}]
    seen, cursor = [], None
    while True:
        page, cursor = scroll.page(df, 9, order, cursor=cursor)
        seen += [r["id"] for r in page]
        if cursor is None:
            break
    assert seen == [r[0] for r in sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[1], r[2], r[0]))]
    assert {r["id"] for r in scroll.scroll(df, 100, [{"field": "c"}]).collect()} == {r[0] for r in rows if not math.isnan(r[3])}
    token = scroll.encode_cursor(scroll.parse_order(order), [1, 2.0], 3)
    for bad in ("?", token):
        with pytest.raises(scroll.CursorError):
            scroll.decode_cursor(bad, scroll.parse_order(order[:1]))
    with pytest.raises(scroll.CursorError):
        scroll.scroll(df, 3, order, start_from=1)


def test_hashes():
    assert V.fnv1a(b"") == 0x811C9DC5 and V.fnv1a(b"a") == 0xE40C292C and V.fnv1a(b"a", 64) == 0xAF63DC4C8601EC8C

    def plain(x):
        m = 2**64
        z = (x + 0x9E3779B97F4A7C15) % m
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % m
        z = (z ^ z >> 27) * 0x94D049BB133111EB % m
        return z ^ z >> 31

    ids = np.array([0, 1, 2**63 - 1, -1])
    assert V.splitmix64(ids).tolist() == [plain(int(i) % 2**64) for i in ids]


def test_partitions_hold_each_point_once(spark):
    part = apps.partitioned(spark.range(1000), 8)
    counts = [r["count"] for r in part.groupBy("part").count().collect()]
    assert sum(counts) == 1000 and len(counts) == 8 and max(counts) < 200


def test_ann_recall(corpus):
    x, df = corpus
    books = quant.train_pq(df, 8)
    centres = quant.train_ivf(df, 8)
    assigned = quant.ivf_assign(df, centres).cache()
    codes = quant.pq_encode(df, books).cache()
    hits = {"pq": 0, "ivf": 0}
    for point in range(0, 400, 50):
        exact = {r["id"] for r in search.knn(df, x[point], 10, "l2").collect()}
        near = quant.rescored(quant.pq_search(codes, books, x[point], 100), df, x[point], 10, "l2")
        hits["pq"] += len(exact & {r["id"] for r in near.collect()})
        hits["ivf"] += len(exact & {r["id"] for r in quant.ivf_search(assigned, centres, x[point], 10, 6, "l2").collect()})
    assert hits["pq"] >= 0.9 * 80 and hits["ivf"] >= 0.9 * 80


@pytest.mark.parametrize("metric", V.METRICS)
def test_coarse_codes_and_cells_lose_no_neighbour(spark, corpus, metric):
    x, df = corpus
    x = x.astype(np.float32)
    far = df.withColumn("vector", F.transform("vector", lambda v: v + F.lit(100.0).cast("float"))).withColumn("id", F.col("id") + 1000)
    every = df.unionByName(far).union(spark.createDataFrame([(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float(v) for v in x[17]], 0)], df.schema))
    known = every.where("vector IS NOT NULL")
    books, layers, centres = quant.train_pq(df, 2, 4), quant.train_residual(df, 2, centroids=3), quant.train_ivf(df, 8, metric)
    rotation = np.linalg.qr(np.random.default_rng(1).normal(size=(16, 16)))[0]
    ways = [lambda v: quant.pq_restored(v, books), lambda v: quant.residual_restored(v, layers), lambda v: quant.pq_restored(v @ rotation, books) @ rotation.T]
    lost = 0
    for point in (0, 17):
        expected = [(r["id"], r["distance"]) for r in search.knn(every, x[point], 10, metric).collect()]
        near = quant.rescored(quant.pq_search(quant.pq_encode(known, books), books, x[point], 10), known, x[point], 10, metric)
        cells = quant.ivf_search(quant.ivf_assign(known, centres), centres, x[point], 10, 1, metric)
        lost += sum([(r["id"], r["distance"]) for r in hits.collect()] != expected for hits in (near, cells))
        found = [quant.completed(near, every, way, x[point], 10, metric) for way in ways]
        found += [quant.completed(near.limit(3), every, ways[0], x[point], 10, metric), quant.ivf_search_all(quant.ivf_assign(known, centres), centres, x[point], 10, 1, metric)]
        for hits in found:
            assert [(r["id"], r["distance"]) for r in hits.collect()] == expected
    assert lost  # what the pools alone give
    assert quant.completed(near, every, ways[0], x[0], 0, metric).count() == 0
    assert quant.completed(near, every, ways[0], x[0], 5000, metric).count() == known.count()


def test_codes_rule_out_what_lies_apart():
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(size=(50, 8)), rng.normal(size=(50, 8)) + 50])
    coded, asked = x.round(1), x[3]
    for metric in ("l2", "dot", "cosine"):
        low, exact = quant.lower_bounds(metric, x, coded, asked), V.row_distances(metric, x, asked)
        assert (low <= exact + 1e-9).all() and np.abs(low - exact).max() < 0.2 * (1 + np.abs(exact).max())
    assert (quant.lower_bounds("l2", x[50:], coded[50:], asked) > V.row_distances("l2", x[:50], asked).max()).all()


def test_scalar_codes(corpus):
    x, df = corpus
    row = quant.scalar_codes(df).where("id = 3").first()
    low, high = x.astype(np.float32).min(0), x.astype(np.float32).max(0)
    assert np.abs(np.array(row["codes"]) - (x[3] - low) / (high - low) * 255).max() <= 0.51


def test_token_bucket(spark):
    events = spark.createDataFrame([(1, "a", t) for t in (0, 100, 200, 1500, 1600)], "seq long, key string, ts_ms long")
    assert [r["admitted"] for r in points.token_bucket(events, 1.0, "key", "ts_ms", "seq").orderBy("ts_ms").collect()] == [True, False, False, True, False]


def test_token_bucket_query_admits_over_the_whole_log(spark, tmp_path):
    import datetime

    from lodeworks.queries.state import x15_token_bucket

    rng = np.random.default_rng(4)
    start = datetime.datetime(2024, 1, 1)
    events = [(i, int(rng.integers(0, 60)), start + datetime.timedelta(milliseconds=int(rng.integers(0, 60_000))), "view", 1.0) for i in range(600)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    expected, state = {}, {}
    for i, key, at, *_ in sorted(events, key=lambda e: (e[2], e[0])):
        ms = (at - start) // datetime.timedelta(milliseconds=1)
        tokens, last = state.get(key, (1.0, ms))
        tokens = min(1.0, tokens + (ms - last) / 1000)
        expected[i] = (key, tokens >= 1)
        state[key] = (tokens - (tokens >= 1), ms)
    assert {r["seq"]: (r["key"], r["admitted"]) for r in x15_token_bucket(spark, str(tmp_path)).collect()} == expected


def test_term_ids_query_covers_the_whole_text(spark, tmp_path):
    from lodeworks.queries.text import t4_term_ids

    words = [f"w{i % 17}" for i in range(40)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, "", "en", "s", 0), (3, "a", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in t4_term_ids(spark, str(tmp_path)).orderBy("id", "pos").collect():
        assert r["pos"] == len(got.setdefault(r["id"], []))
        got[r["id"]].append(r["term_id"])
    assert got == {1: [T.fnv1a(w.encode()) for w in words], 3: [T.fnv1a(b"a")]}


def test_deletes_are_guarded(corpus):
    with pytest.raises(L.FilterError):
        points.delete_by_filter(corpus[1], {})
    with pytest.raises(L.FilterError):
        points.delete_by_filter(corpus[1], L.or_())


def test_counter_restarts_after_delete(spark):
    log = spark.createDataFrame([(1, "a", "put"), (2, "a", "put"), (3, "a", "del"), (4, "a", "put")], "seq long, key string, op string")
    from pyspark.sql import functions as F

    assert [r["counter"] for r in kv.increments(log, F.lit(2)).orderBy("seq").collect()] == [2, 4, 0, 2]


def test_existed_across_spans(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "abc"[int(rng.integers(3))], "del" if rng.random() < 0.4 else "put") for i in range(200)]
    there, expected = {}, {}
    for i, key, op in rows:
        if op == "del":
            expected[i] = there.get(key, False)
        there[key] = op != "del"
    log = spark.createDataFrame(rows, "seq long, key string, op string").repartition(3)
    for span in (1, 7, 10_000):
        assert {r["seq"]: r["existed"] for r in kv.existed(log, span).collect()} == expected


def test_counters_across_spans(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    rows = [(i, "ab"[int(rng.integers(2))], "del" if rng.random() < 0.06 else "put", int(rng.integers(-3, 9))) for i in range(300)]
    now, expected = {"a": 0, "b": 0}, []
    for _, key, op, n in rows:
        now[key] = 0 if op == "del" else now[key] + n
        expected.append(now[key])
    log = spark.createDataFrame(rows, "seq long, key string, op string, n long")
    for span in (7, 50, 10_000):
        assert [r["counter"] for r in kv.increments(log, F.col("n"), span).orderBy("seq").collect()] == expected


def test_catalog(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    catalog.create(Config("a", 2))
    for bad in (lambda: catalog.create(Config("a", 2)), lambda: catalog.create(Config("b", 0)), lambda: catalog.swap_aliases([("x", "a"), ("y", "nowhere")]), lambda: catalog.drop("z")):
        with pytest.raises(CatalogError):
            bad()
    assert catalog.aliases() == {}
    catalog.swap_aliases([("x", "a")])
    catalog.write("x", spark.range(3))
    catalog.write("x", spark.range(5))
    assert catalog.read("a").count() == 5 and catalog.read("a", 1).count() == 3
    catalog.drop("a")
    assert catalog.aliases() == {}


def test_writers_of_one_catalog_lose_nothing(spark, tmp_path, monkeypatch):
    one, two = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    plain = one._read

    def overtaken():
        found = plain()
        if not any(n == "b" for n in found[1]["collections"]):
            two.create(Config("b", 2))  # after the read, before the write
        return found

    monkeypatch.setattr(one, "_read", overtaken)
    one.create(Config("a", 2))
    assert two.names() == ["a", "b"] and one._versions() == [1, 2]
    for i in range(12):
        two.swap_aliases([("x", "ab"[i % 2])])
    assert len(two._versions()) == Catalog.KEPT and two.aliases() == {"x": "b"}
    monkeypatch.setattr(one, "_write", lambda number, state: False)
    with pytest.raises(CatalogError):
        one.create(Config("c", 2))
    assert two.names() == ["a", "b"]


def test_a_lost_race_for_a_table_version_is_refused(spark, tmp_path):
    one, two = Catalog(spark, str(tmp_path)), Catalog(spark, str(tmp_path))
    one.create(Config("a", 2))

    class Racing:
        """A table whose writing takes so long that another writer is done first."""

        def __init__(self, df):
            self.df = df

        @property
        def write(self):
            two._change(lambda s: s["collections"]["a"].update(version=1))
            return self.df.write

    with pytest.raises(CatalogError):
        one.write("a", Racing(spark.range(3)))


def test_bulk_and_tiers(spark, tmp_path):
    from pyspark.sql import functions as F

    catalog = Catalog(spark, f"{tmp_path}/warm")
    catalog.create(Config("a", 2))
    for bad in (lambda: catalog.build("a"), lambda: catalog.evict("a", str(tmp_path)), lambda: catalog.promote("a")):
        with pytest.raises(CatalogError):
            bad()
    catalog.stage("a", spark.range(4).withColumn("seq", F.col("id") + 10))
    catalog.stage("a", spark.range(2).withColumn("seq", F.col("id")))
    assert catalog.build("a") == 1
    assert sorted((r["id"], r["seq"]) for r in catalog.read("a").collect()) == [(i, i + 10) for i in range(4)]
    catalog.touch("a", 50)
    assert catalog.sweep_idle(f"{tmp_path}/cold", 60, 20) == [] and catalog.sweep_idle(f"{tmp_path}/cold", 90, 20) == ["a"]
    with pytest.raises(CatalogError):
        catalog.read("a")
    catalog.promote("a")
    assert catalog.read("a").count() == 4


def test_backups(spark, tmp_path):
    from lodeworks.sources import backup

    with pytest.raises(ValueError):
        backup.restore_latest(spark, str(tmp_path), "a")
    for at in (900, 1000, 20):
        backup.save(spark.range(at), str(tmp_path), "a", at)
    assert backup.times(spark, str(tmp_path), "a") == [20, 900, 1000] and backup.restore_latest(spark, str(tmp_path), "a").count() == 1000
    with pytest.raises(Exception):
        backup.save(spark.range(1), str(tmp_path), "a", 20)


def test_repeated_ids_in_write_batches(spark):
    base = spark.createDataFrame([(1, "old", 1), (9, "old", 3)], "id long, v string, version long")
    rows = spark.createDataFrame([(1, "a", 0, 1, 5), (1, "b", 0, 1, 4), (2, "c", 0, 0, 7), (2, "d", 0, 0, 6), (9, "e", 0, 2, 1)], "id long, v string, version long, expected long, seq long").repartition(3)
    got = lambda df: sorted((r["id"], r["v"]) for r in df.collect())
    new, clashes = points.insert(base, rows, "seq")
    assert got(new) == [(1, "old"), (2, "d"), (9, "old")] and got(clashes) == [(1, "a"), (1, "b"), (2, "c"), (9, "e")]
    assert got(points.upsert(base, rows, "seq")) == [(1, "a"), (2, "c"), (9, "e")]
    now, lost = points.compare_and_set(base, rows, "seq")
    assert sorted((r["id"], r["v"], r["version"]) for r in now.collect()) == [(1, "b", 2), (2, "d", 1), (9, "old", 3)]
    assert sorted((r["id"], r["expected"], r["actual"]) for r in lost.collect()) == [(1, 1, 2), (2, 0, 1), (9, 2, 3)]
    assert got(points.upsert(base, base.limit(0))) == got(base)


def test_procedures_and_embedders(spark):
    with pytest.raises(ValueError):
        apps.procedure_version("nothing")
    apps.register_procedure("p", "RO", "x", len)
    with pytest.raises(ValueError):
        apps.register_procedure("p", "RW", "y", len)
    with pytest.raises(ValueError):
        apps.procedure_version("p", 2)
    texts = spark.createDataFrame([(1, "red fox"), (2, "blue sky"), (3, None)], "id long, content string")
    store = apps.TextStore(texts, apps.hash_embedder(32))
    assert [r["id"] for r in store.search("fox red", 1).collect()] == [1]
    more = store.add(spark.createDataFrame([(1, "green tree"), (4, "red fox")], "id long, content string"))
    assert [r["id"] for r in more.search("red fox", 1).collect()] == [4]
    with pytest.raises(Exception):
        apps.TextStore(texts, apps.Embedder(3, lambda t: np.zeros((len(t), 2)))).search("x").collect()


def test_anisotropic_kmeans():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    assert np.array_equal(quant.anisotropic_kmeans(x, 8, 1.0), quant.kmeans(x, 8))
    loss = lambda c: quant.anisotropic_losses(x, c, 4.0).min(1).mean()
    assert loss(quant.anisotropic_kmeans(x, 8, 4.0)) < loss(quant.kmeans(x, 8))
    c = rng.normal(size=(2, 4))
    slow = [[float(((v - k) ** 2).sum() + 3 * ((v - k) @ v) ** 2 / (v @ v)) for k in c] for v in x[:5]]
    assert np.allclose(quant.anisotropic_losses(x[:5], c, 4.0), slow)


def test_four_bit_codes(corpus):
    x, df = corpus
    books = quant.train_pq(df, 4, 16)
    codes = {r["id"]: bytes(r["codes"]) for r in quant.pq4_encode(df, books).collect()}
    tables, step, least = quant.byte_tables(books, x[3])
    total = {i: sum(int(tables[p][(c[p // 2] >> (4 * (p % 2))) & 15]) for p in range(4)) for i, c in codes.items()}
    best = sorted(total, key=lambda i: (total[i], i))[:9]
    found = quant.pq4_search(quant.pq4_encode(df, books), books, x[3], 9).collect()
    assert [r["id"] for r in found] == best and abs(found[0]["distance"] - (least + step * total[best[0]])) < 1e-9
    with pytest.raises(ValueError):
        quant.pq4_encode(df, np.zeros((2, 17, 8)))


def test_drift():
    assert quant.drifted(100, 1.0, 200, 1.6) and not quant.drifted(100, 1.0, 199, 9.0) and not quant.drifted(100, 1.0, 500, 1.5)
    with pytest.raises(ValueError):
        quant.drifted(1, 1.0, 2, 2.0, growth=1.0)


def test_stream_state_rewrites_only_touched_parts(spark, tmp_path):
    import glob

    from lodeworks.streaming import changes

    schema = "key long, seq long, op string, value double"
    batches = [[(k, k, "put", 1.0) for k in range(40)], [(3, 100, "put", 2.0), (3, 99, "put", 9.0)], [(5, 200, "del", 0.0)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        changes.apply_changes(stream, f"{tmp_path}/state", f"{tmp_path}/checkpoint", parts=8).awaitTermination()
    found = {r["key"]: (r["seq"], r["value"]) for r in changes.read_state(spark, f"{tmp_path}/state", 2, spark.createDataFrame([], schema).schema).collect()}
    assert found == {k: (k, 1.0) if k != 3 else (100, 2.0) for k in range(40) if k != 5}
    assert len(glob.glob(f"{tmp_path}/state/v1/part=*")) == 1 and len(glob.glob(f"{tmp_path}/state/v0/part=*")) == 8


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("héllo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "c.bin").write_text("no")
    assert [r["content"] for r in files.text_files(spark, str(tmp_path)).collect()] == ["héllo"]
    assert files.list_objects(spark, str(tmp_path), "b").count() == 1
    page = spark.sql("SELECT '<html><script>x<y</script><p>a&nbsp;b</p> <b>c</b></html>' AS h").select(files.strip_tags("h").alias("t")).first()
    assert page["t"] == "a&nbsp;b c"


def test_equal_postings_tie_whatever_order_their_terms_come_in(spark):
    words = ["alpha", "beta", "gamma", "delta"]
    rng = np.random.default_rng(2)
    kinds = [tuple(int(n) for n in rng.integers(1, 9, 4)) for _ in range(8)]
    rows = [(i, w, kinds[i % 8][j], 40 + i % 8) for i in range(400) for j, w in enumerate(words)]
    posts = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "id long, term string, tf long, dl long").repartition(7)
    found = text_search.search(posts, words + words[:1], 400).collect()
    assert len({r["score"] for r in found}) == 8
    assert [(-r["score"], r["id"]) for r in found] == sorted((-r["score"], r["id"]) for r in found)


def test_key_ttl_equals_sql_where_a_length_is_null_or_none(spark, tmp_path):
    import duckdb

    from lodeworks import registry

    rows = [(i, "x", "en", "s", n) for i, n in enumerate((0, None, 1, 2, 1499, 1500, 1501, 1502))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    found = registry.queries()["x2_key_ttl"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    expected = duck.execute(f"SELECT {', '.join(found.columns)} FROM ({registry.oracle_sql()['x2_key_ttl']}) ORDER BY id").fetchall()
    assert [tuple(r) for r in found.orderBy("id").collect()] == expected


def test_english_search_over_texts_agrees_with_postings(spark):
    texts = ["The licensed works of others", "the THE of", "", None, "licenses; license-licensing work", "worked_other 'others' theirs", "élan works don't", "workshop licensee otherwise", "l icense w ork 42 o"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string")
    for name, asked in (("english", "the licensed works of others"), ("english", "élan 42 lying"), ("stopped", "works the élan"), ("simple", "the works license")):
        terms = text_search.query_terms(asked, name, spark)
        one = text_search.search_texts(docs, terms, 40, name).collect()
        two = text_search.search(text_search.postings(docs, name), terms, 40).collect()
        assert [r["id"] for r in one] == [r["id"] for r in two] and len(one) >= 3
        assert np.allclose([r["score"] for r in one], [r["score"] for r in two])


def test_token_patterns_agree_with_tokens(spark):
    texts = ["a an the and ant thee", "can't we'll", "THE End_of x2 ²", "ｆｕｌｌ Ünï a", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for stops in ((), T.STOPWORDS, ("a", "ant", "c++", "The", "x2")):
        pattern = F.lit(T.token_pattern(stops))
        words = T.without_stopwords(T.tokens(F.col("t")), stops) if stops else T.tokens(F.col("t"))
        for r in rows.select(F.regexp_extract_all(F.lower("t"), pattern, F.lit(0)).alias("found"), words.alias("words")).collect():
            assert r["found"] == r["words"]
    assert T.one_of([]) == ""


def test_drift_is_the_mean_distance_to_the_nearest_centre(spark, corpus):
    x, df = corpus
    x = x.astype(np.float32).astype(float)
    centres = quant.train_ivf(df, 8, "l2")
    slow = V.distances("l2", x, centres).min(1).mean()
    assert math.isclose(quant.mean_cell_distance(df.repartition(3), centres), slow, rel_tol=1e-9)
    assert quant.mean_cell_distance(df.limit(0), centres) == 0.0
    assert quant.retrain_on_drift(df, df.where("id % 2 = 0"), centres)[1] is False


def test_chunks_are_cut_a_few_texts_at_a_time(spark, monkeypatch):
    texts = ["", None, "one two\n\nthree", " ".join(map(str, range(300)))] * 5
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string").coalesce(1)
    monkeypatch.setattr(T, "CHUNKED", 3)
    found = [tuple(r) for r in T.chunks(rows, "id", "content", 128, 16).orderBy(F.col("source").cast("long"), "index").collect()]
    assert found == [(str(i), n, c) for i, t in enumerate(texts) if t for n, c in enumerate(T.chunk_text(t, 128, 16))]


def test_a_text_is_embedded_once(spark):
    told = spark.sparkContext.accumulator(0)

    def embed(texts):
        told.add(len(texts))
        return np.array([[len(x), 1.0] for x in texts]).reshape(len(texts), 2)

    texts = spark.createDataFrame([(i, "x" * (i + 1)) for i in range(60)], "id long, content string")
    store = apps.TextStore(texts, apps.Embedder(2, embed)).delete(texts.where("id % 2 = 0"))
    told.value = 0
    assert store.search("xx", 5).count() == 5
    assert told.value <= 30 + 1  # the texts that are left, and the one that is asked for


def test_hash_embedder_counts_words_by_their_numbers():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"W{n}é" for n in rng.integers(0, 300, int(size))) for size in rng.integers(0, 60, 70)] + ["", "  ", "y" * 5000 + " b"]
    found = apps.hash_embedder(32).embed(texts)
    for row, text in zip(found, texts):
        slow = np.zeros(32)
        for word in text.lower().split():
            slow[V.fnv1a(word.encode()) % 32] += 1
        assert np.allclose(row, slow / (np.linalg.norm(slow) or 1), atol=0)
    words = [b"", b"a", b"y" * 70, b"y" * 64, b"y" * 65, "é".encode()]
    for bits in (32, 64):
        assert [int(n) % 2**bits for n in V.fnv1a_many(words, bits)] == [V.fnv1a(w, bits) for w in words]
    assert len(V.fnv1a_many([])) == 0


def test_stopwords_query_moves_texts_once(spark, capsys):
    from lodeworks import registry

    registry.queries()["t2_stopwords"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate")
