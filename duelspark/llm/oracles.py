"""DuckDB SQL of operators whose whole result SQL can express; rows must have a doc_id."""

PASSAGES = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT r, unnest(range(1, len(ws) - 33)) AS p, ws FROM w WHERE len(ws) >= 35),
named AS (SELECT r, p, array_to_string(list_slice(ws, p, p + 34), ' ') AS name FROM windows),
repeated AS (SELECT r, p FROM named QUALIFY count(*) OVER (PARTITION BY name) > 1),
words AS (SELECT r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
marked AS (SELECT words.r, words.p, word, coalesce(max(CASE WHEN repeated.p IS NOT NULL THEN 1 ELSE 0 END)
    OVER (PARTITION BY words.r ORDER BY words.p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM words LEFT JOIN repeated ON words.r = repeated.r AND words.p = repeated.p),
kept AS (SELECT r, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)
"""

NEAR_DUPS = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
positions AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS s FROM positions),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, r) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT reached.doc_id, edges.y FROM reached JOIN edges ON reached.r = edges.x),
least AS (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
