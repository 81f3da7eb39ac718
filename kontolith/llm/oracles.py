"""DuckDB SQL of the training-data queries that SQL can say, by exhaustive comparison; meant for the small tables."""

WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
f AS (SELECT h, max(page_id) AS first FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first IS NOT DISTINCT FROM d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first IS DISTINCT FROM d.page_id THEN f.first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h AND d.n >= 1000
"""

_REACH = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, min(least(a, b)) AS c FROM reach GROUP BY a)
"""

JACCARD_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)),
{_REACH}
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(low.c, w.doc_id) AS component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN low ON w.doc_id = low.a
"""

EMBEDDING_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
      WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id AND list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.9),
{_REACH},
c AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(low.c, v.vec_id) AS component_id, coalesce(low.c, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN c ON v.vec_id = c.a LEFT JOIN low ON v.vec_id = low.a
"""
