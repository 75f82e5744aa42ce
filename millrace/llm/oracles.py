"""DuckDB SQL for the operators whose results it can express, by plain means: all pairs that share a shingle, all
strings of 100 bytes. For small tables only."""

from __future__ import annotations

import string

#: Result of op5: distinct shingles, pairs that share one, components by reachability.
NEAR_DEDUP = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
n AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, md5(unnest(s)) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * same >= 80 * (p.n + q.n - same)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM sides UNION SELECT reach.a, sides.b FROM reach JOIN sides ON reach.b = sides.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM n LEFT JOIN root ON doc_id = a
"""

#: Result of op8, over the hexadecimal digits of the texts' bytes.
SUFFIX_DEDUP = """
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS MATERIALIZED (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 99, 0))) AS i FROM h)),
first AS MATERIALIZED (SELECT x, min((doc_id, i)) AS origin FROM s GROUP BY x HAVING count(*) > 1),
again AS MATERIALIZED (SELECT doc_id, i FROM s JOIN first USING (x) WHERE (doc_id, i) <> origin),
runs AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
  SELECT doc_id, i, sum(CASE WHEN i <= before + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again)) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM runs UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
left_over AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (coalesce(hi, length(h) // 2) - lo)), '' ORDER BY lo) AS kept FROM gaps JOIN h USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM h LEFT JOIN sums USING (doc_id) LEFT JOIN left_over USING (doc_id)
"""
