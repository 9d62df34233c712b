"""DuckDB twins of the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: A-Z and a-z, for folding as the contract has it.
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
w AS (SELECT doc_id, i, h[2 * i + 1 : 2 * i + 100] AS s FROM b, unnest(range(0, greatest(n - 49, 0))) AS t(i)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first_id FROM w),
c AS (SELECT doc_id, i, i + 50 AS e FROM f WHERE first_id < doc_id),
g AS (SELECT doc_id, i, e, coalesce(i > max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM c),
k AS (SELECT doc_id, i, e, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(e) AS e FROM k GROUP BY ALL),
keep AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM r
  UNION ALL SELECT b.doc_id, coalesce(m.e, 0), b.n FROM b LEFT JOIN (SELECT doc_id, max(e) AS e FROM r GROUP BY doc_id) m USING (doc_id)),
kept AS (SELECT doc_id, string_agg(h[2 * x + 1 : 2 * y], '' ORDER BY x) AS h FROM keep JOIN b USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(e - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: The given pages have one article each, of h1 and p blocks; character references in them are of four kinds.
OP3 = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?(?:h1|p)>') AS parts FROM pages),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(
  replace(replace(replace(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"', 'g'), '&lt;', '<'), '&gt;', '>'), '&#x27;', chr(39)), '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS raw FROM a)
SELECT page_id, url, regexp_replace(raw, '&amp;?', '&', 'g') AS text, CAST(length(regexp_replace(raw, '&amp;?', '&', 'g')) AS BIGINT) AS n_chars FROM t
"""

#: Words are runs of letters, digits and characters beyond ASCII.  Items of fewer than five words
#: are one shingle, which is met by documents with that run of words.
OP4 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all({_FOLD}, '[0-9a-z\x{{80}}-\x{{10ffff}}]+') AS w FROM benchmark),
i AS (SELECT item_id, item, len(w) AS n, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda p: array_to_string(w[p : p + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0),
own AS (SELECT item_id, item, n, k, s, count(*) AS c FROM i GROUP BY ALL),
kinds AS (SELECT DISTINCT k FROM own),
x AS (SELECT doc_id, k, len(w) AS m, unnest(range(0, len(w) - k + 1)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p : p + k - 1], ' '))) AS s FROM d, kinds WHERE len(w) >= k),
h AS (SELECT doc_id, m, p, item, item_id, n, o.k, s, c, least(n, m) - o.k + 1 AS size FROM x JOIN own o USING (k, s)),
a AS (SELECT doc_id, m, item, item_id, n, k, size, s, c, unnest(range(greatest(p - size + 1, 0), least(p, greatest(m - n, 0)) + 1)) AS start FROM h),
t AS (SELECT doc_id, item, item_id, n, m, k, size, start, s, least(count(*), any_value(c)) AS held FROM a GROUP BY ALL),
v AS (SELECT doc_id, item, item_id, least(n, m) AS n_words, start, CAST(sum(held) AS DOUBLE) / (n - k + 1 + size - sum(held)) AS similarity FROM t GROUP BY doc_id, item, item_id, n, m, k, size, start),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item ORDER BY similarity DESC, start) AS pick FROM v WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS first_word, CAST(n_words AS INTEGER) AS n_words FROM best WHERE pick = 1
"""

OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex({_FOLD}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id FROM s JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) m ON s.doc_id = m.id
"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS last_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> last_id THEN last_id END AS refers_to FROM g
"""

OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a),
m AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN m ON v.vec_id = m.id LEFT JOIN n ON v.vec_id = n.a
"""

ORACLES = {"op1_suffix_array_dedup": OP1, "op3_html_extraction": OP3, "op4_decontamination": OP4, "op5_ngram_jaccard": OP5, "op6_warc": OP6, "op7_embedding_dedup": OP7}
