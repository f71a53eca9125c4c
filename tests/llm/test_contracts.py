"""The corpus operators against brute force, on a small corpus with every kind of trouble."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import accumulate

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lodeworks.llm import exact_dedup, license_scan, ngram_join, packing, quality_rules, queries, rank_bpe, sharding, sql, substring_dedup, token_files, toxicity
from lodeworks.llm.wordtok import word_encoder

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    """Copies, near copies, shared passages, nulls, empties, long and short texts, odd characters."""
    rng = np.random.default_rng(5)
    names = ["".join(rng.choice(list("abcdefghij"), 4)) for _ in range(300)]
    make = lambda n: " ".join(rng.choice(names, n))
    base = [make(120) for _ in range(12)]
    passage = make(30)
    texts = [None, "", " \n\t ", "one", "two words", "One", "a b 　 c", "x" * 3000, "MIT License\nthe mit license", "naïve Ünïcode ñ 日本語 🙂 <|endoftext|> y", "a\x1cb \x85 c", "tab\tand\r\nline  two   spaces ", make(6000)]
    for t in base:
        texts += [t, t, t.replace(" ", "\n", 3), t.upper()]
        words = t.split()
        for _ in range(4):
            edited = list(words)
            for i in rng.integers(0, len(words), rng.integers(1, 6)):
                edited[i] = rng.choice(names)
            texts.append(" ".join(edited))
        texts.append(make(20) + " " + passage + " " + make(15))
    texts += [make(40) for _ in range(30)]
    order = rng.permutation(len(texts))
    return [(int(i), texts[k], "en", "src0", len(texts[k] or "")) for i, k in enumerate(order)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# 1


def test_exact_groups(docs, rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(i)
    expected = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {i: tuple(r)[1:] for i, r in by_id(exact_dedup.exact_groups(docs)).items()} == expected
    assert {r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()} == {min(g) for g in groups.values()}


def test_exact_groups_with_null_and_repeated_ids(spark, empty):
    df = spark.createDataFrame([(None, "a  b"), (5, "a b"), (5, "a b"), (7, "c"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect()), key=repr)
    assert got == sorted([(None, None, 3, True), (5, None, 3, False), (5, None, 3, False), (7, 7, 1, True), (None, None, 1, True)], key=repr)
    twice = df.where("doc_id IS NOT NULL").withColumn("digest", df["text"])
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(twice).collect()) == [5, 7]
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def test_queries_equal_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    for name, text in sql.oracle_sql().items():
        ours, theirs = queries.queries()[name](spark, DATA), duck.sql(text)
        order = sorted(ours.columns)
        assert order == sorted(theirs.columns)
        a = sorted(tuple(r[c] for c in order) for r in ours.collect())
        assert a == sorted(tuple(r[theirs.columns.index(c)] for c in order) for r in theirs.fetchall())


def test_exact_dedup_runs_no_python(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2


def insulting(n, seed):
    rng = np.random.default_rng(seed)
    plain = ["word", "other", "thing", "place", "green", "blue", "walk", "talk", "house", "river"]
    out = []
    for i in range(n):
        sentences = [" ".join(rng.choice(plain, 6)) for _ in range(8)]
        if i % 4 == 0:
            sentences[3] += " " + rng.choice(["zorkface", "blatherskite"])
        out.append((i, ". ".join(sentences) + ".", int(i % 4 == 0)))
    return out


def test_toxicity_learns_from_documents_and_finds_the_sentence(spark, empty):
    rows = insulting(400, 1)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels)
    got = by_id(toxicity.score_documents(df, model))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == {r[0] for r in held}
    assert all(got[r[0]]["predicted"] == r[2] for r in held)
    assert all(got[r[0]]["worst_sentence"] == 3 for r in held if r[2])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    spans = {(r["doc_id"], r["sentence"]) for r in toxicity.toxic_sentences(df, model).collect()}
    assert spans == {(r[0], 3) for r in rows if r[2]}
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "...")], "doc_id long, text string")
    assert [r["score"] for r in toxicity.score_documents(odd, model).collect()] == [0.0, 0.0, 0.0]
    assert toxicity.score_documents(empty, toxicity.learn(empty, labels)).count() == 0


def plain_score(text, model):
    """The noisy-or of a text, by a loop over characters, sentences and words."""
    clean = 1.0
    for sentence in re.split(r"[.!?\n]", (text or "").translate(LOWER)):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", sentence)
        if not words:
            continue
        logit = model.bias
        for w in words:
            marked = f"^{w}$"
            pieces = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
            logit += sum(model.weights.get(x, 0.0) for x in pieces)
        clean *= 1 - 1 / (1 + np.exp(-max(logit, -500.0)))
    return 1 - clean


def test_toxicity_scores_equal_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(i, 1, int("mit" in (t or "").lower() or i % 9 == 0)) for i, t, *_ in rows], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    assert model.weights
    got = by_id(toxicity.score_documents(docs, model))
    for i, text, *_ in rows:
        assert abs(got[i]["score"] - plain_score(text, model)) < 1e-9
        assert got[i]["predicted"] == int(got[i]["score"] >= 0.5)


def test_toxicity_learns_from_long_texts_and_takes_any_id(spark):
    long = "plain words of a long text. " * 6000
    rows = [(i, (long if i % 2 else "short text. ") + ("you zorkface. " if i % 4 == 0 else "you friend. ")) for i in range(80)]
    rows += [(4, "repeated id"), (4, "repeated id"), (None, long)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, labels)
    found = toxicity.score_documents(df, model).collect()
    assert len(found) == len(rows) and dict(toxicity.score_documents(df, model).dtypes)["doc_id"] == "bigint"
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in found if r["doc_id"] not in (4, None))


def test_toxicity_query_on_held_out_labels(spark):
    got = by_id(queries.op2_noisy_or_toxicity(spark, "/root/testdata/sf0.1"))
    labels = by_id(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"))
    held = [(got[i]["score"], labels[i]["toxic"]) for i in labels if got[i]["held_out"]]
    good, bad = (np.array([x for x, y in held if y == k]) for k in (0, 1))
    area = ((bad[:, None] > good[None]).mean() + (bad[:, None] == good[None]).mean() / 2) if len(bad) else 0
    assert len(bad) > 20 and area >= 0.9 and (bad >= 0.5).mean() >= 0.85 and (good < 0.5).mean() >= 0.9


# 3


def stripped(rows):
    first, words = {}, {i: WORD.findall(t or "") for i, t, *_ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    out = {}
    for i, w in words.items():
        dead = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < i:
                dead.update(range(k, k + 13))
        out[i] = (len(w), len(dead), " ".join(x for k, x in enumerate(w) if k not in dead))
    return out


def test_substring_dedup(docs, rows, empty):
    got = {i: (r["n_words"], r["n_removed"], r["text"]) for i, r in by_id(substring_dedup.strip_repeats(docs)).items()}
    expected = stripped(rows)
    assert sum(v[1] for v in expected.values()) > 1000
    assert got == expected
    assert substring_dedup.strip_repeats(empty).count() == 0


@pytest.mark.parametrize("load, chunk", [(200, 10 << 20), (50, 4000), (1 << 30, 4000)])
def test_substring_dedup_with_split_cells_and_small_chunks(docs, rows, monkeypatch, load, chunk):
    monkeypatch.setattr(substring_dedup, "LOAD", load)
    monkeypatch.setattr(substring_dedup, "SPLIT_BYTES", chunk)
    got = {i: (r["n_words"], r["n_removed"], r["text"]) for i, r in by_id(substring_dedup.strip_repeats(docs)).items()}
    assert got == stripped(rows)


def test_layout_bounds_the_load_of_buckets():
    rng = np.random.default_rng(1)
    load = rng.integers(0, 100, 1000)
    load[17] = 100_000
    plan = substring_dedup.layout(load, 8, 1000)
    assert plan.splits[17] == 100 and (np.delete(plan.splits, 17) == 1).all()
    light = np.bincount(np.delete(plan.base, 17), np.delete(load, 17))
    assert light.max() <= 1100 and plan.buckets == len(light) + 100 and plan.base[17] == len(light)
    assert substring_dedup.layout(np.zeros(5, int), 8).buckets == 1


def test_windows_of_split_cells_meet_in_one_bucket():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 2**63, 40).astype(np.uint64)[rng.integers(0, 40, 3000)]
    values[1000:1200] = values[:200]
    plan = substring_dedup.Layout(np.arange(substring_dedup.CELLS, dtype=np.int32) * 7, np.full(substring_dedup.CELLS, 7, np.int32), 7 * substring_dedup.CELLS)
    begins = np.array([0, 900, 2000, 3000])
    first, windows, bucket = substring_dedup.placed_kmers(values, begins, plan)
    at = [(f + i, b) for f, n, b in zip(first.tolist(), windows.tolist(), bucket.tolist()) for i in range(n)]
    assert [i for i, _ in at] == substring_dedup.window_starts(begins, 13).tolist()
    home = {}
    for i, b in at:
        assert home.setdefault(tuple(values[i : i + 13].tolist()), b) == b


def test_substring_dedup_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text, 1), (4, text + " end", 2), (4, "start " + text, 3), (4, text + " end", 2)], "doc_id long, text string, spans int")
    got = sorted((r["spans"], r["n_removed"]) for r in substring_dedup.strip_repeats(df).collect())
    assert got == [(1, 20), (2, 0), (2, 0), (3, 0)]


def test_equal_hashes_of_different_windows_are_told_apart(monkeypatch):
    ids = np.array([*range(13), *range(13), *range(1, 14)], np.int64)
    monkeypatch.setattr(substring_dedup, "window_hashes", lambda v, n: np.zeros(len(v) - n + 1, np.uint64))
    member, group = substring_dedup._groups(ids, np.array([0, 13, 26]))
    found = defaultdict(list)
    for m, g in zip(member.tolist(), group.tolist()):
        found[g].append(m)
    assert sorted(map(sorted, found.values())) == [[0, 1], [2]]


# 4


def linked(rows):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                o = len(sets[a] & sets[b])
                if 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_components(docs, rows, empty):
    got = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.near_components(docs)).items()}
    expected = linked(rows)
    assert len(set(v[1] for v in expected.values())) < len(rows) - 40
    assert got == expected
    assert {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()} == {v[1] for v in expected.values()}
    assert ngram_join.near_components(empty).count() == 0


def chained(n=60, step=4, size=90):
    """Neighbours link, distant ones do not: a long chain in one component."""
    return [(i, " ".join(f"t{k}" for k in range(i * step, i * step + size))) for i in range(n)]


def test_chains_and_split_groups(spark, monkeypatch):
    rows = chained() + [(1000 + i, t) for i, t in chained(20, 30, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = linked(rows)
    whole = {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.near_components(df)).items()}
    assert whole == expected
    monkeypatch.setattr(ngram_join, "BLOCK", 3)  # every group is dealt out in blocks
    monkeypatch.setattr(ngram_join, "RARE", 2)  # most shingles count as frequent
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(ngram_join.near_components(df)).items()} == expected


def accidental(n, clusters=0):
    """Unrelated texts that share one passage of four words, which is rarer than nothing else; some of them in near-copy clusters."""
    rng = np.random.default_rng(n)
    rows = [(i, f"s{i} " + "the shared passage here " + " ".join(f"u{i}x{k}" for k in range(30))) for i in range(n)]
    for c in range(clusters):
        words = [f"c{c}w{k}" for k in range(60)]
        for i in range(n // clusters):
            own = list(words)
            own[int(rng.integers(0, 60))] = "zz"
            rows.append((100_000 + c * n + i, " ".join(own)))
    return rows


def second_pass(spark, monkeypatch, rows):
    """Rows of all tables that hold members of groups, and the largest task's group."""
    seen = []
    plain = ngram_join._Join.linked

    def counted(self, groups):
        spread = groups.selectExpr("grp", "explode(sequence(salt, last_salt)) AS salt", "turn", "last_turn").selectExpr("grp", "salt", "explode(sequence(turn, last_turn)) AS turn")
        sizes = [r["count"] for r in spread.groupBy("grp", "salt", "turn").count().collect()]
        seen.append((sum(sizes), max(sizes, default=0)))
        return plain(self, groups)

    monkeypatch.setattr(ngram_join._Join, "linked", counted)
    got = {i: r["component_id"] for i, r in by_id(ngram_join.near_components(spark.createDataFrame(rows, "doc_id long, text string"))).items()}
    monkeypatch.setattr(ngram_join._Join, "linked", plain)
    return got, sum(n for n, _ in seen), max(m for _, m in seen)


def test_groups_of_unrelated_sets_grow_linearly(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    work = []
    for n in (900, 1800):
        got, rows, largest = second_pass(spark, monkeypatch, accidental(n))
        assert got == {i: i for i in range(n)} and largest <= 4 * 16
        work.append(rows)
    assert work[1] <= 2.3 * work[0]


@pytest.mark.parametrize("few, depth", [(16, 3), (0, 3), (0, 1), (0, 0)])
def test_every_way_through_large_groups_is_exact(spark, monkeypatch, few, depth):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "DEPTH", depth)
    rows = accidental(40, 2) + [(5000 + i, t) for i, t in chained(40)] + [(9000 + i, t) for i, t in corpus_rows()]
    got, _, largest = second_pass(spark, monkeypatch, rows)
    assert got == {i: c for i, (_, c) in linked(rows).items()}
    assert largest <= 24


def test_hashes_are_found_by_their_bits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some, others = (rng.integers(-(2**63), 2**63, 2000).tolist() for _ in range(2))
    some += [0, 1, -1, 7, 8, 32767, 32768, 32769, 2**26, 2**26 - 1, -(2**63), 2**63 - 1]
    frame = lambda values: spark.createDataFrame([(x, str(x)) for x in values], "hash long, t string")
    for bits in (1 << 26, 1 << 15):
        monkeypatch.setattr(ngram_join, "BITS", bits)
        among = lambda values: {r["hash"] for r in ngram_join._among(frame(values), frame(some)).collect()}
        assert among(some) == set(some) and len(among(others)) < 200
    assert ngram_join._among(frame(some), frame([])).count() == 0


def corpus_rows():
    return [(i, t) for i, t, *_ in corpus()]


def test_list_blocks_find_all_partners():
    rng = np.random.default_rng(2)
    for _ in range(20):
        size = np.sort(rng.integers(5, 200, 300))
        rest = size - rng.integers(0, 1 + size // 7)
        ok = (np.minimum(rest[:, None], rest[None]) >= ngram_join.needed(size[:, None], size[None])) & (85 * np.maximum(size[:, None], size[None]) <= 100 * np.minimum(size[:, None], size[None]))
        np.fill_diagonal(ok, False)
        assert not (ok.any(1) & ~ngram_join.partnered(size, rest)).any()


def test_near_components_with_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (4, text.upper()), (4, "other"), (9, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_components(df).collect()), key=repr)
    assert got == sorted([(None, 17, 4), (4, 17, 4), (4, 1, 4), (9, 0, 9)], key=repr)


def near_copies(name, n=60):
    """A text and a near copy."""
    text = [f"{name}{i}" for i in range(n)]
    return " ".join(text), " ".join([*text[:-1], "end"])


def test_near_copies_among_null_and_repeated_ids(spark):
    pairs = {name: near_copies(name) for name in "abcdef"}
    rows = [(None, pairs["a"][0]), (None, pairs["a"][1]), (None, pairs["b"][0]), (None, pairs["b"][1])]
    rows += [(3, pairs["c"][0]), (3, pairs["d"][0]), (8, pairs["c"][1]), (9, pairs["d"][1])]
    rows += [(5, pairs["e"][0]), (5, pairs["e"][1]), (5, pairs["f"][0]), (6, pairs["f"][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_components(df).collect()), key=repr)
    component = {None: None, 3: 3, 8: 3, 9: 3, 5: 5, 6: 5}
    assert got == sorted(((i, 57, component[i]) for i, _ in rows), key=repr)


def test_one_of_each_component_stays_whatever_the_ids(spark):
    pairs = {name: near_copies(name) for name in "abcdefgh"}
    rows = [(None, pairs["a"][0]), (4, pairs["a"][1]), (None, pairs["b"][0])]  # an unrelated text without an id stays
    rows += [(None, pairs["c"][0]), (None, pairs["c"][1]), (None, pairs["c"][1]), (None, None), (None, " ")]
    rows += [(7, pairs["d"][0]), (7, pairs["e"][0]), (2, pairs["e"][1])]
    rows += [(None, pairs["f"][0]), (5, pairs["f"][1]), (6, pairs["g"][0]), (6, pairs["g"][1]), (1, pairs["h"][0]), (1, pairs["h"][0])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, hash int")
    found = [tuple(r) for r in ngram_join.one_of_each(df).collect()]
    assert {(i, t, k) for k, (i, t) in enumerate(rows)} >= set(found)
    left = [(i, t) for i, t, _ in found]
    for i, name, n in ((4, "a", 1), (None, "b", 0), (7, "d", 0), (2, "e", 1), (5, "f", 1), (1, "h", 0)):
        assert left.count((i, pairs[name][n])) == 1
    for i, name in ((None, "c"), (6, "g")):
        assert sum(left.count((i, t)) for t in pairs[name]) == 1
    assert (None, None) in left and (None, " ") in left and len(left) == 10


# 5


def test_license_phrases(docs, rows, empty):
    got = by_id(license_scan.scan_licenses(docs))
    for i, text, *_ in rows:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        places, base = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            at = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            places += at
            base |= {label} if at else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)))
        assert base <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(empty).count() == 0


def test_containment_join_is_exact():
    rng = np.random.default_rng(8)
    vocabulary = sorted({w for _, t in license_scan.TEMPLATES.values() for w in t.split()})
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, {w.encode(): int(n) for w, n in zip(vocabulary, rng.integers(0, 50, len(vocabulary)))}, 0.7)
    for _ in range(300):
        name = rng.choice(list(license_scan.TEMPLATES))
        words = license_scan.TEMPLATES[name][1].split()
        block = [w for w in words if rng.random() > 0.25] + list(rng.choice(vocabulary, 3))
        mine = {w.encode() for w in block}
        expected = {n: len(t & mine) / len(t) for n, t in index.sets.items() if len(t & mine) >= index.need[n]}
        assert index.matches([w.encode() for w in block]) == expected


def test_wrapped_license_statements_are_found(spark):
    import textwrap

    rows, names = [], list(license_scan.TEMPLATES)
    for width in (20, 45, 72):
        for name in names:
            lines = textwrap.wrap("Some code. " + license_scan.TEMPLATES[name][1] + ". More of it", width)
            rows.append((len(rows), "int x;\n\n * " + "\n * ".join(lines) + "\n\nint y;"))
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, _ in rows:
        name = names[i % len(names)]
        assert ("1.0", name) in {(str(b["containment"]), b["template"]) for b in got[i]["blocks"]} and got[i]["score"] == 1.0
        assert license_scan.TEMPLATES[name][0] in got[i]["labels"].split(",")
        assert all(b["line"] >= 2 for b in got[i]["blocks"])


def test_license_runs_equal_brute_force():
    rng = np.random.default_rng(3)
    vocabulary = sorted({w.encode() for _, t in license_scan.TEMPLATES.values() for w in t.split()})
    index = license_scan.TemplateIndex(license_scan.TEMPLATES, {w: int(n) for w, n in zip(vocabulary, rng.integers(0, 50, len(vocabulary)))})
    found = 0
    for _ in range(100):
        name = str(rng.choice(list(license_scan.TEMPLATES)))
        words = [w.encode() for w in license_scan.TEMPLATES[name][1].split() if rng.random() > 0.03]
        words = [*rng.choice(vocabulary, 30).tolist(), *words, b"zzz", *rng.choice(vocabulary, 10).tolist(), *words]
        lines = [words[i : i + 7] for i in range(0, len(words), 7)]
        got = index.blocks(b"\n".join(map(b" ".join, lines)))
        for n, mine in index.sets.items():
            shares = {i: len(mine & set(words[i : i + index.run[n]])) / len(mine) for i, w in enumerate(words) if w in mine}
            good = {i: c for i, c in shares.items() if c * len(mine) >= index.need[n] - 1e-9}
            own = [b for b in got if b[1] == n]
            assert bool(own) == bool(good)
            if good:
                found += 1
                assert max(b[2] for b in own) == max(good.values()) and {b[0] for b in own} <= {i // 7 for i in good}
    assert found > 100


def test_scattered_words_are_no_license(spark):
    line = "the software is used by a person, released in 2001; under new rules the editor got a license for the mit campus"
    spread = " and then some more ".join(license_scan.TEMPLATES["gpl-grant"][1].split())
    texts = [line, spread, "This work is licensed under the\nGNU General Public License", license_scan.TEMPLATES["mit-text"][1].replace(" software", "\n\n# software")]
    got = by_id(license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert [got[i]["blocks"] == [] for i in range(4)] == [True, True, False, False]
    assert got[2]["labels"] == "gpl" and "mit" in got[3]["labels"].split(",")


# 6


def test_shards(docs, rows, empty):
    got = by_id(sharding.shard_documents(docs, 7))
    counts = Counter(r["shard"] for r in got.values())
    assert sorted(counts) == list(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got.values():
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for number, (i, text, *_) in enumerate(sorted(rows, key=lambda r: r[0])):
        r = got[i]
        data = (text or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 16, zlib.crc32(data), "rows", None)
        assert sharding.row_of([r["shard"]], [r["slot"]], len(rows), 7).tolist() == [number]
    assert sharding.shard_documents(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    p = sharding.permute(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, backwards=True).tolist() == list(range(n))


# 7, 9: ids of the whole library


def library(name, rows, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {r[0]: e.ids + end for r, e in zip(rows, t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(docs, rows, empty):
    ids = library("word_bpe_49k.json", rows, [2])
    starts = dict(zip(sorted(ids), [0, *accumulate(len(ids[i]) for i in sorted(ids))]))
    got = by_id(token_files.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 2))
    assert {i: tuple(r)[1:] for i, r in got.items()} == {i: (starts[i], len(x), crc(x)) for i, x in ids.items()}
    assert token_files.encode_documents(empty, public_tokenizers.path("word_bpe_49k.json"), 2).count() == 0


@pytest.mark.parametrize("width", [1, 5, 13, 16, 17, 31, 32])
def test_bit_packing(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = rng.integers(0, 2**width, n)
        data = token_files.pack_bits(ids, width)
        assert len(data) == -(-n // 64) * width * 8
        assert token_files.unpack_bits(data, width, 0, n).tolist() == ids.tolist()
        if n > 5:
            assert token_files.unpack_bits(data, width, 3, n - 1).tolist() == ids[3 : n - 1].tolist()


def test_block_random_access():
    block = token_files.Block(token_files.build_block([3, None, 9], [np.array(x, "<u4").tobytes() for x in ([1, 2], [], [70000])], 17))
    assert block.doc_ids == [3, None, 9] and [block.ids(i).tolist() for i in range(3)] == [[1, 2], [], [70000]]


ODD = ["a\x1cb c\x85d", "<|endoftext|>x <|startoftext|>", "é ́x İstanbul ΣΑΣ. ς", "'s don't I'LL x'", "日本語 テスト🙂🙂", "x" * 3000, "<|endof text|>", "½ ²", "WORD!! (word) word.) ,", "ÀÉ ß ÿ µª", "a ́b", "﷽ ﬁ ǅ"]


def test_word_encoder_equals_library():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder = word_encoder(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(2):  # cold and from the cache
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([x.encode() for x in ODD])]
        assert got == [e.ids for e in t.encode_batch(ODD, add_special_tokens=False)]


def test_encoders_refuse_other_vocabularies():
    with pytest.raises(ValueError):
        word_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        rank_bpe.rank_bpe(public_tokenizers.path("word_bpe_49k.json"))


def test_word_encoder_equals_library_on_random_texts():
    rng = np.random.default_rng(6)
    pieces = [*"abcXYZ.,;:!?'\"()<|>-_ 5 \n\t", "H\u0331", "\u1e96", "é", "É", "İ", "ß", "ﬁ", "日本", " 's", "'S ", "don't", "<|endoftext|>", "<|EndOfText|>", "\u00a0", "\u0301", "A\u030a", "\x1c", "\x85", "½", "²", ", ", ". "]
    texts = ["".join(rng.choice(pieces, int(rng.integers(1, 60)))) for _ in range(4000)]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = word_encoder(public_tokenizers.path("word_bpe_49k.json")).encode([x.encode() for x in texts])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_packing(docs, rows, empty):
    ids = library("word_bpe_49k.json", rows, [1])
    pieces = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), 1).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert p["ids_crc32"] == crc(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]) and p["doc_tokens"] == len(ids[p["doc_id"]])
    for i, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *accumulate(p["length"] for p in own)][:-1] and sum(p["length"] for p in own) == len(ids[i])
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [0, *accumulate(p["length"] for p in own)][:-1] and sum(p["length"] for p in own) <= 2048
    assert set(by_doc) == set(ids)
    assert packing.pack_documents(empty, public_tokenizers.path("word_bpe_49k.json"), 1).count() == 0


def packed(spark, cuts):
    df = spark.createDataFrame([(d, s, n, packing.class_of(n)) for d, s, n in cuts], "doc_id long, start long, length long, class int")
    sequences = defaultdict(list)
    for r in packing.harmonic_pack(df).collect():
        sequences[r["sequence_id"]].append(r)
    assert sum(map(len, sequences.values())) == len(cuts)
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == [0, *accumulate(r["length"] for r in own)][:-1] and sum(r["length"] for r in own) <= 2048
    return sequences


def kinds(sequences):
    """Sequences of whole pieces, of full bins of one class, and of part-filled bins."""
    merged = {k: own for k, own in sequences.items() if k >> 58 == packing.MERGED}
    for k, own in sequences.items():
        if k not in merged:
            assert len({r["class"] for r in own}) == 1 and len(own) == own[0]["class"]  # as many as the class asks for
    return merged


def test_packing_levels_waste_little(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 50)
    cuts = [(d, s, n) for d in range(3000) for s, n in packing.cut(37 + d * 7919 % 5000)]
    sequences = packed(spark, cuts)
    assert 2048 * len(sequences) <= 1.03 * sum(n for _, _, n in cuts)
    assert len(kinds(sequences)) < 50 and len({k >> 58 for k in sequences}) > 3  # two levels at least


@pytest.mark.parametrize("documents", [40, 1000])
def test_small_tables_are_packed_by_classes_too(spark, documents):
    cuts = [(d, s, n) for d in range(documents) for s, n in packing.cut(37 + d * 7919 % 5000)]
    sequences = packed(spark, cuts)
    merged = kinds(sequences)
    classes = Counter(r["class"] for own in merged.values() for r in own)
    assert all(n < k for k, n in classes.items())  # one part-filled bin for each class at most
    assert sum(classes.values()) < (0.8 if documents < 100 else 0.25) * len(cuts)


def test_short_pieces_fill_sequences(spark):
    cuts = [(d, 0, 1 + d % 5) for d in range(30000)]
    sequences = packed(spark, cuts)
    assert 2048 * len(sequences) <= 1.1 * sum(n for _, _, n in cuts)


# 8


def counts(text):
    words, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))


def test_text_statistics(spark, docs, rows, empty):
    more = [(9000, "a b c d e f g h a b c d e f g h i\na b\na b\n \n \n#*$% <x>", "en", "s", 0), (9001, ("eins zwei drei vier fünf sechs sieben acht neun " * 9), "de", "s", 0)]
    every = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    got = by_id(quality_rules.text_statistics(every))
    for i, text, *_ in rows + more:
        assert tuple(got[i][c] for c in quality_rules.COUNTS[:5]) == counts(text), i
    assert quality_rules.text_statistics(empty).count() == 0


def test_rules_reject_what_labels_call_bad(spark, empty):
    rng = np.random.default_rng(4)
    good = lambda: " ".join(rng.choice(["plain", "words", "of", "some", "prose", "here"], 60) + rng.choice(list("abcdefghijklm"), 60))
    rows = [(i, good() if i % 3 else " | ".join(rng.choice(["cell", "table", "x"], 50) + rng.choice(list("abcdefghijklm"), 50)), i % 3) for i in range(600)]
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2] > 0), 0) for r in rows], "doc_id long, quality int, toxic int")
    rules = quality_rules.learn_rules(df, labels)
    assert rules and quality_rules.describe(rules)
    got = by_id(quality_rules.quality_verdicts(df, labels))
    assert all(got[r[0]]["kept"] == (r[2] > 0) for r in rows)
    assert "CASE WHEN" in str(quality_rules.verdict(rules)[1])
    assert quality_rules.learn_rules(empty, labels) == [] and quality_rules.quality_verdicts(empty, labels).count() == 0
    clash = df.withColumns({"n_words": df["doc_id"], "whole": df["text"]})
    assert sorted(r["n_words"] for r in quality_rules.keep_good(clash, labels).collect()) == [r[0] for r in rows if r[2] > 0]


def plain_verdict(text, rules):
    """Base check and rules of one text, by loops; the number of the rule that rejects."""
    text = text or ""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = counts(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    per = lambda n, d: n / max(d, 1)
    x = {
        "words": n_words, "word_length": per(word_chars, n_words), "symbol_share": per(n_symbols, word_chars), "dup_line_share": per(n_dup_lines, len(lines)),
        "repeat_share": per(n_repeat, n_words), "upper_share": per(len(re.findall("[A-Z]", text)), word_chars),
        "mark_share": per(len(re.findall(r"[!?|~^=+_{}\[\]\\]", text)), word_chars), "digit_share": per(len(re.findall("[0-9]", text)), word_chars),
    }
    failed = n_words < 20 or 100 * n_repeat > 30 * n_words
    fired = next((k for k, rule in enumerate(rules) if all((x[t.feature] >= t.threshold) if t.above else (x[t.feature] <= t.threshold) for t in rule)), None)
    return failed, not failed and fired is None, fired


def test_quality_verdicts_equal_brute_force(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    rules = quality_rules.learn_rules(table, labels)
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    got = by_id(quality_rules.quality_verdicts(table, labels))
    assert rules and {i: (r["base_failed"], r["kept"], r["rule"]) for i, r in got.items()} == {i: plain_verdict(t, rules) for i, t in texts.items()}
    known = [(r["quality"], got[r["doc_id"]]["kept"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(k for q, k in known if q) >= 0.9 * sum(q for q, _ in known)
    assert sum(not k for q, k in known if not q) >= 0.8 * sum(not q for q, _ in known)


def test_quality_rules_with_long_texts_and_repeated_ids(spark):
    long = " ".join(f"word{i}" for i in range(40_000))
    rows = [(i, long if i == 1 else "| ! " * 30 + str(i) if i % 2 else " ".join(f"w{i}x{k}" for k in range(40))) for i in range(200)] + [(3, long), (3, long), (None, None)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    found = quality_rules.quality_verdicts(df, labels).collect()
    assert len(found) == len(rows) and all(r["kept"] == (r["doc_id"] % 2 == 0) for r in found if r["doc_id"] not in (1, 3, None))


# 10


def test_rank_bpe(docs, rows, empty):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = by_id(rank_bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.json")))
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids
        assert got[i]["decoded"] == t.decode(ids, skip_special_tokens=False)
    assert rank_bpe.encode_texts(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


SPACES = ["a\n ", "a\n  b", "a \n b", "a   b", "a\n \nb", "a  b", "a  ", "a   b c", "é é", "\n", " ", "   ", "ab" * 3000 + " z", "　 x", "a   b", "<|endoftext|>  <|endoftext|>"]


def test_rank_bpe_takes_any_id(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, "a b")], "doc_id int, text string")
    assert sorted(((r["doc_id"], r["decoded"]) for r in rank_bpe.encode_texts(df, public_tokenizers.path("byte_bpe_50k.json")).collect()), key=repr) == [(1, ""), (1, "a b"), (None, "a b")]


def test_rank_bpe_on_odd_texts():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    bpe = rank_bpe.rank_bpe(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + SPACES
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in bpe.encode([x.encode() for x in texts])]
        assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    broken = np.array([0xE6 - 33 + 0, 50256, 100], "<u4")
    assert bpe.decode(broken.tobytes()).decode() == t.decode(broken.tolist(), skip_special_tokens=False)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    kept = {i for i, r in by_id(quality_rules.quality_verdicts(table, labels)).items() if r["kept"]}
    left = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] in kept}
    first = {}
    for i in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[i]), i)
    left = {i: left[i] for i in first.values()}
    left = {i: left[i] for i, (_, c) in linked(list(left.items())).items() if i == c}
    texts = [(i, v[2]) for i, v in stripped(list(left.items())).items()]
    ids = library("word_bpe_49k.json", texts, [1])
    got = defaultdict(int)
    for p in corpus_pipeline.run(spark, DATA).collect():
        got[p["doc_id"]] += p["length"]
        assert p["ids_crc32"] == crc(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]])
    assert dict(got) == {i: len(x) for i, x in ids.items()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "substring dedup", "packing"]


CLASHES = "digest content salt keep_id group_size doc hash key n d1 d2 spans bucket n_words class row".split()


def test_stages_keep_clashing_columns_and_take_empty_tables(spark, docs):
    import corpus_pipeline
    from pyspark.sql import functions as F

    clash = docs.drop("n_chars").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, DATA)
        assert out.columns == clash.columns, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in CLASHES), name
        assert stage(spark, clash.limit(0), DATA).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, clash.limit(0), DATA).count() == 0


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{DATA}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
