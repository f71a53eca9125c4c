"""DuckDB SQL for those of the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY content) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY content) AS kept,
       sha256(content) AS text_sha256
FROM d
"""

_WORDS = r"list_filter(string_split_regex({0}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 12], ' ') AS w FROM (SELECT *, unnest(range(1, len(words) - 11)) AS i FROM d)),
firsts AS (SELECT w, min(doc_id) AS least FROM windows GROUP BY w),
dead AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (w) WHERE least < doc_id),
kept AS (SELECT doc_id, p, word FROM (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d) ANTI JOIN dead USING (doc_id, p)),
texts AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM kept GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN texts USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 3], ' ') AS s FROM (SELECT *, unnest(range(1, len(words) - 2)) AS i FROM d WHERE len(words) >= 4)
  UNION ALL SELECT doc_id, array_to_string(words, ' ') AS s FROM d WHERE len(words) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 85 * (x.n + y.n - o)),
reach AS (SELECT doc_id AS id, doc_id AS c FROM d UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.c)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT id, min(c) AS component_id FROM reach GROUP BY id) LEFT JOIN sizes ON sizes.doc_id = id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op3_super_kmer_dedup": OP3, "op4_ngram_jaccard_join": OP4}
