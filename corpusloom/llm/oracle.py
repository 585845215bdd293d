"""DuckDB SQL for the contracts that SQL can express, on whole tables and whole texts."""

from __future__ import annotations

SUBSTRING = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 win AS (SELECT doc_id, t.i, array_to_string(ws[t.i : t.i + 12], ' ') AS g FROM d, unnest(range(1, len(ws) - 11)) AS t(i)),
 own AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
 hit AS (SELECT doc_id, i FROM win JOIN own USING (g) WHERE m < doc_id),
 gone AS (SELECT DISTINCT doc_id, i + r.k AS i FROM hit, range(13) AS r(k)),
 word AS (SELECT doc_id, t.i, ws[t.i] AS w FROM d, unnest(range(1, len(ws) + 1)) AS t(i)),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
DECONTAMINATE = rf"""
WITH d AS (SELECT doc_id, {_PLAIN} AS ws FROM documents), b AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark),
 item AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[t.i : t.i + 9], ' ') AS g FROM b, unnest(range(1, greatest(len(ws) - 8, 2))) AS t(i) WHERE len(ws) > 0),
 size AS (SELECT DISTINCT n FROM item),
 win AS (SELECT doc_id, n, t.i, array_to_string(ws[t.i : t.i + n - 1], ' ') AS g FROM d, size, unnest(range(1, greatest(len(ws) - n + 2, 1))) AS t(i)),
 hit AS (SELECT doc_id, item_id, i, n FROM win JOIN item USING (n, g)),
 word AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT doc_id, i, unnest(range(n)) AS k FROM hit) GROUP BY doc_id),
 ids AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[t.i : t.i + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(i) WHERE len(ws) > 0),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 shared_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM shared_ JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 85 * (p.n + q.n - shared)),
 way AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
 reach AS (SELECT u AS doc_id, v AS other FROM way UNION SELECT r.doc_id, w.v FROM reach r JOIN way w ON w.u = r.other),
 least_ AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_ USING (doc_id)
"""
