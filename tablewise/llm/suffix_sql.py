"""op7 in SQL: every 400-byte string as hex (cut out of overlapping blocks), those that occur twice,
their union as spans, and what is left between the spans."""

SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, n, j, substr(h, CAST(800 * j + 1 AS BIGINT), 1600) AS block FROM (SELECT doc_id, h, length(h) // 2 AS n, unnest(range(0, length(h) // 800 + 1)) AS j FROM d)),
s AS (SELECT doc_id, 400 * j + t AS i, md5(substr(block, CAST(2 * t + 1 AS BIGINT), 800)) AS w FROM (SELECT doc_id, j, block, unnest(range(0, least(400, greatest(n - 399 - 400 * j, 0)))) AS t FROM blocks)),
r AS (SELECT doc_id, i FROM s WHERE w IN (SELECT w FROM s GROUP BY w HAVING count(*) > 1)),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS b FROM k GROUP BY doc_id, k),
cuts AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM spans
         UNION ALL SELECT d.doc_id, coalesce(max(b), 0), length(any_value(h)) // 2 FROM d LEFT JOIN spans ON spans.doc_id = d.doc_id GROUP BY d.doc_id),
kept AS (SELECT c.doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS h FROM cuts c JOIN d ON d.doc_id = c.doc_id GROUP BY c.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(length(d.h) // 2 AS BIGINT) AS n_bytes, CAST((length(d.h) - length(kept.h)) // 2 AS BIGINT) AS n_removed,
       CAST(coalesce(n.n, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256,
       CAST(length(kept.h) // 2 AS BIGINT) AS n_kept, length(kept.h) < length(d.h) AS has_repeats
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
