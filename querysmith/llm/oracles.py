"""SQL equivalents of those operators that SQL can express, for small tables."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SHARDING = """
WITH t AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, range(0, 8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, ('0x' || md5('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15])::BIGINT AS h,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM documents, t),
r AS (SELECT *, (CAST(row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) AS DOUBLE) - 0.5) / CAST(count(*) OVER (PARTITION BY source) AS DOUBLE) AS f FROM d),
g AS (SELECT *, row_number() OVER (ORDER BY f, source, h, doc_id, text_crc32, size) - 1 AS g, count(*) OVER () AS n FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(g * 16 // n AS INTEGER) AS shard,
  CAST(g - (g * 16 // n * n + 15) // 16 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, source FROM g
"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
k AS (SELECT doc_id, i, w[i + 1] AS word, CASE WHEN i + 50 <= len(w) THEN array_to_string(w[i + 1 : i + 50], ' ') END AS key FROM p),
m AS (SELECT key, min(doc_id) AS least FROM k WHERE key IS NOT NULL GROUP BY key),
c AS (SELECT k.doc_id, k.i, k.word, max(CASE WHEN m.least < k.doc_id THEN 1 ELSE 0 END) OVER (PARTITION BY k.doc_id ORDER BY k.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM k LEFT JOIN m ON k.key = m.key),
s AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

#: Links in relation l(a, b), both ways round; the least id that each id reaches.
REACHED = """
r(id, root) AS (SELECT a, least(a, min(b)) FROM l GROUP BY a UNION SELECT l.a, r.root FROM r JOIN l ON l.b = r.id AND r.root < l.a),
c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
"""

EMBEDDINGS = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
l(a, b) AS (SELECT x.id, y.id FROM v x JOIN v y ON x.id <> y.id AND list_cosine_similarity(x.e, y.e) >= 0.9),
{REACHED}
SELECT v.id AS vec_id, (SELECT count(*) FROM l WHERE a = v.id) AS n_links, coalesce(c.root, v.id) AS component_id, coalesce(c.root, v.id) = v.id AS kept FROM v LEFT JOIN c ON v.id = c.id
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id AS id, {WORDS} AS w FROM documents),
s AS (SELECT id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS g FROM d),
u AS (SELECT id, len(g) AS n, unnest(g) AS x FROM s),
l(a, b) AS (SELECT p.id, q.id FROM u p JOIN u q ON p.x = q.x AND p.id <> q.id GROUP BY p.id, q.id, p.n, q.n HAVING 9 * count(*) >= 4 * (p.n + q.n)
  UNION ALL SELECT p.id, q.id FROM s p JOIN s q ON len(p.g) = 0 AND len(q.g) = 0 AND p.id <> q.id),
k AS (SELECT id, md5(array_to_string(list_sort(g), chr(10))) AS g FROM s),
f AS (SELECT g, min(id) AS class_id FROM k GROUP BY g),
{REACHED}
SELECT k.id AS doc_id, f.class_id, (SELECT count(*) FROM l WHERE a = k.id) AS n_links, coalesce(c.root, k.id) AS component_id, coalesce(c.root, k.id) = k.id AS kept FROM k JOIN f ON k.g = f.g LEFT JOIN c ON k.id = c.id
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(floor(64 * x) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20
"""
