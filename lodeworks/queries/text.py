"""Text analysis, BM25 and ingestion queries."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import apps, points, search, text_search
from ..plans import filters as L
from ..sources import files
from .base import POSTS, chunk_sql, docs, fnv32, fnv64, query, signed, table, tidy, words


@query(f"SELECT id, (i - 1)::INTEGER AS pos, w[i] AS token FROM (SELECT doc_id AS id, {words('text')} AS w FROM documents), range(1, 100000) r(i) WHERE i <= len(w)")
def t1_tokenize(spark, d):
    """Every token of every text with its place."""
    return docs(spark, d).select("id", F.posexplode(T.tokens(F.col("content"))).alias("pos", "token"))


STOPS = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS if "'" not in w) + "]"


@query(f"SELECT id, token, count(*) AS n FROM (SELECT doc_id AS id, unnest(list_filter({words('text')}, lambda w: NOT list_contains({STOPS}, w))) AS token FROM documents) GROUP BY id, token")
def t2_stopwords(spark, d):
    """Texts move once, by id, so that their words, which take several times as much, are counted where they are."""
    left = docs(spark, d).select("id", "content").repartition("id").select("id", F.explode(T.without_stopwords(T.tokens(F.col("content")))).alias("token"))
    return left.groupBy("id", "token").agg(F.count("*").alias("n"))


@query()
def t3_stems(spark, d):
    terms = docs(spark, d).select(F.explode(T.tokens(F.col("content"))).alias("term")).distinct()
    return T.stems(terms)


@query(f"""WITH w AS (SELECT doc_id AS id, {words('text')} AS w FROM documents), known AS (SELECT term, {fnv32('term')} AS term_id FROM (SELECT DISTINCT unnest(w) AS term FROM w))
 SELECT id, pos, term_id FROM (SELECT id, (i - 1)::INTEGER AS pos, w[i] AS term FROM w, range(1, 100000) r(i) WHERE i <= len(w)) JOIN known USING (term)""")
def t4_term_ids(spark, d):
    """The FNV-1a number of every token of every text."""
    return docs(spark, d).select("id", F.posexplode(T.term_ids(T.tokens(F.col("content")))).alias("pos", "term_id"))


@query(f"SELECT id, term, tf, dl::BIGINT AS dl FROM {POSTS}")
def t5_postings(spark, d):
    return text_search.postings(docs(spark, d), "simple")


@query(f"SELECT count(DISTINCT id) AS n, sum(tf)::BIGINT AS token_total, count(DISTINCT term) AS terms FROM {POSTS}")
def t7_index_stats(spark, d):
    return text_search.postings(docs(spark, d), "simple").agg(F.countDistinct("id").alias("n"), F.sum("tf").alias("token_total"), F.countDistinct("term").alias("terms"))


ASKED = "license from restin"


def bm25(posts: str, where: str = "TRUE", by: str = "", terms: tuple[str, ...] = ("license", "from", "restin")) -> str:
    """id, score over postings with query terms, ``license from restin`` if not said; ``by`` names a partition column."""
    group = f"GROUP BY {by}" if by else ""
    using = f"USING ({by})" if by else "ON TRUE"
    term = f"term, {by}" if by else "term"
    return f"""(WITH p AS MATERIALIZED (SELECT * FROM {posts}),
 s AS (SELECT {by + ',' if by else ''} count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT id, dl {',' + by if by else ''} FROM p) {group}),
 f AS (SELECT {term}, count(*) AS df FROM p WHERE term IN ({', '.join(map(repr, terms))}) GROUP BY {term})
 SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM p JOIN f USING ({term}) JOIN s {using} WHERE {where} GROUP BY id)"""


@query(f"SELECT row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, id, round(score, 6) AS score FROM {bm25(POSTS)} ORDER BY rank LIMIT 20")
def t8_bm25(spark, d):
    found = text_search.search_texts(docs(spark, d), ASKED.split(), 20, "simple")
    return tidy(search.ranked(found, -F.col("score")), "rank", "id", "score")


@query(f"""SELECT b.id, round(b.score, 6) AS score, d.lang FROM (SELECT * FROM {bm25(POSTS, "id IN (SELECT doc_id FROM documents WHERE n_chars < 1500)")} ORDER BY score DESC, id LIMIT 15) b
 JOIN documents d ON d.doc_id = b.id""")
def t9_search_text_filtered(spark, d):
    every = docs(spark, d)
    found = text_search.search_texts(every, ASKED.split(), 15, "simple", admitted=L.compile_filter(L.lt("n_chars", 1500), L.fields_of(every)))
    return tidy(every.join(F.broadcast(found), "id"), "id", "score", "lang")  # fifteen hits


# Words of the texts that the English analyzer takes for the query's terms.
FORMS = {"licens": ("license", "licenses", "licensed", "licensing"), "work": ("work", "works", "worked", "working"), "other": ("other", "others")}
STEMMED = f"""(SELECT id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY id) AS dl FROM
 (SELECT id, CASE {' '.join(f"WHEN w IN ({', '.join(map(repr, v))}) THEN '{k}'" for k, v in FORMS.items())} ELSE '=' || w END AS term FROM
 (SELECT doc_id AS id, unnest(list_filter({words('text')}, lambda w: NOT list_contains({STOPS}, w))) AS w FROM documents)) GROUP BY id, term)"""


@query(f"SELECT id, round(score, 6) AS score FROM {bm25(STEMMED, terms=tuple(FORMS))} ORDER BY score DESC, id LIMIT 20")
def t9_search_text_english(spark, d):
    terms = text_search.query_terms("the licensed works of others", "english", spark)
    return tidy(text_search.search_texts(docs(spark, d), terms, 20, "english"), "id", "score")


@query(f"SELECT row_number() OVER (ORDER BY score DESC, id) - 1 AS rank, id, round(score, 6) AS score FROM {bm25(POSTS)} ORDER BY rank LIMIT 20")
def t8_bm25_over_postings(spark, d):
    """The same by postings, the form for an index that many queries share."""
    found = text_search.search(text_search.postings(docs(spark, d), "simple"), ASKED.split(), 20)
    return tidy(search.ranked(found, -F.col("score")), "rank", "id", "score")


@query(f"""SELECT w.term, coalesce(df, 0) AS df, n, token_total::BIGINT AS token_total FROM (VALUES ('license'), ('from'), ('nosuchword')) w(term)
 LEFT JOIN (SELECT term, count(*) AS df FROM {POSTS} GROUP BY term) USING (term), (SELECT count(DISTINCT id) AS n, sum(tf) AS token_total FROM {POSTS})""")
def t10_corpus_stats(spark, d):
    return text_search.corpus_stats(text_search.postings(docs(spark, d), "simple"), ["license", "from", "nosuchword"])


@query(f"SELECT id, round(score, 6) AS score FROM {bm25(f'(SELECT *, id % 4 AS part FROM {POSTS})', by='part')} ORDER BY score DESC, id LIMIT 20")
def t11_partition_idf(spark, d):
    return tidy(text_search.search_texts(docs(spark, d).withColumn("part", F.col("id") % 4), ASKED.split(), 20, "simple", partition="part"), "id", "score")


@query(r"""SELECT id, (i - 1)::INTEGER AS pos, p[i] AS paragraph FROM (SELECT doc_id AS id,
 list_filter(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS p FROM documents), range(1, 100000) r(i) WHERE i <= len(p)""")
def c13_paragraphs(spark, d):
    """Every paragraph; a full stop at a line's end is made a paragraph's end here, since the texts have few blank lines."""
    spaced = F.replace(F.col("content"), F.lit(".\n"), F.lit(".\n\n"))
    return docs(spark, d).select("id", F.posexplode(T.paragraphs(spaced)).alias("pos", "paragraph"))


DOCUMENTS = "(SELECT doc_id::VARCHAR AS source, text FROM documents)"


@query(f"SELECT * FROM {chunk_sql(DOCUMENTS, 128, 16)}")
def c12_chunks(spark, d):
    return T.chunks(docs(spark, d), "id", "content", 128, 16)


@query(f"SELECT source, index, {signed(fnv64('name'))} AS id FROM (SELECT source, index, source || '#' || index AS name FROM {chunk_sql(DOCUMENTS, 128, 16)})")
def c11_chunk_ids(spark, d):
    chunks = T.chunks(docs(spark, d), "id", "content", 128, 16)
    return chunks.select("source", "index", apps.chunk_id(F.col("source"), F.col("index")).alias("id"))


@query(f"SELECT term, {fnv32('term')} AS short, {signed(fnv64('term'))} AS long FROM (SELECT DISTINCT unnest({words('text')}) AS term FROM documents)")
def c8_fnv1a(spark, d):
    terms = docs(spark, d).select(F.explode(T.tokens(F.col("content"))).alias("term")).distinct()
    return terms.select("term", T.term_ids(F.array("term"))[0].alias("short"), T.term_ids(F.array("term"), bits=64)[0].alias("long"))


@query("""SELECT '[1] (0) ' || (SELECT left(text, 40) FROM documents WHERE doc_id = 0) || chr(10) || '[2] (3) ' || (SELECT left(text, 40) FROM documents WHERE doc_id = 3) || chr(10) || chr(10) || 'Question: why?' AS prompt""")
def c14_prompt(spark, d):
    rows = docs(spark, d).where("id IN (0, 3)").select((F.col("id") / 3).cast("int").alias("rank"), F.col("id").cast("string").alias("source"), F.left("content", F.lit(40)).alias("content"))
    return apps.prompt(rows, "why?")


PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(<script[^>]*>.*?</script>|<style[^>]*>.*?</style>)', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[ \t\n\x0b\f\r]+', ' ', 'g'))"


@query(f"SELECT * FROM {chunk_sql(f'(SELECT page_id::VARCHAR AS source, {PLAIN} AS text FROM pages)', 256, 32)}")
def s15_ingest_text(spark, d):
    pages = table(spark, d, "pages").select("page_id", files.strip_tags(F.col("html")).alias("content"))
    return T.chunks(pages, "page_id", "content", 256, 32)


@query("SELECT source, count(*) AS n FROM documents WHERE source <> 'src3' GROUP BY source UNION ALL SELECT 'src3' AS source, count(*) AS n FROM documents WHERE doc_id < 10")
def w22_replace_source(spark, d):
    every = docs(spark, d).select("id", "source", "content")
    new = every.where("id < 10").withColumn("source", F.lit("src3"))
    return points.replace_source(every, new.select("source", "id", "content")).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY lang, source) AS first_of_scope, count(*) OVER (PARTITION BY lang, source) AS n FROM documents")
def c15_scope_keys(spark, d):
    """With which documents each one shares its scope."""
    keyed = docs(spark, d).select("id", apps.scope_key(F.col("lang"), F.col("source")).alias("k"))
    groups = keyed.groupBy("k").agg(F.min("id").alias("first_of_scope"), F.count("*").alias("n"))
    return keyed.join(groups, "k").select("id", "first_of_scope", "n")


@query("SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'default' END AS tenant, source AS collection FROM documents")
def c19_tenant_split(spark, d):
    name = F.when(F.col("id") % 2 == 0, F.concat_ws("/", "lang", "source")).otherwise(F.col("source"))
    tenant, collection = apps.tenant(F.col("name"))
    return docs(spark, d).withColumn("name", name).select("id", tenant.alias("tenant"), collection.alias("collection"))
