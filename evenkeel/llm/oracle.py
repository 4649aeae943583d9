"""DuckDB SQL for those registered queries that SQL can express."""

OP5 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""


OP9 = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bs AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s + 1 : s + least(len(w), 13)], ' ') AS span
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS s FROM bw WHERE len(w) > 0)
), ds AS (
  SELECT doc_id, s, n, array_to_string(w[s + 1 : s + n], ' ') AS span
  FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM dw, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, s, n, span FROM ds WHERE span IN (SELECT span FROM bs)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
  FROM (SELECT DISTINCT h.doc_id, bs.item_id::varchar AS i FROM hits h JOIN bs USING (span)) GROUP BY 1
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


OP6 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(len(w), 4)], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(0, len(w) - least(len(w), 4) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 85 * (p.n + q.n - count(*))
), reach AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(min(r.y), d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.x = d.doc_id
GROUP BY d.doc_id, n.n
"""


OP2 = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS s FROM t WHERE length(h) >= 200)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS r FROM w) WHERE r > 1
), edges AS (
  SELECT doc_id, s, CASE WHEN s <= max(s + 100) OVER (PARTITION BY doc_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM later
), spans AS (
  SELECT doc_id, k, min(s) AS a, max(s) + 100 AS z FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM edges) GROUP BY 1, 2
), gaps AS (
  SELECT doc_id, k, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY k) AS p, a FROM spans
  UNION ALL SELECT doc_id, max(k) + 1, max(z), NULL FROM spans GROUP BY 1
), kept AS (
  SELECT t.doc_id, string_agg(substr(h, (2 * p + 1)::bigint, (2 * (coalesce(a, length(h) // 2) - p))::bigint), '' ORDER BY k) AS h FROM gaps g JOIN t ON t.doc_id = g.doc_id GROUP BY 1
), sums AS (
  SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM spans GROUP BY 1
)
SELECT t.doc_id, length(t.h) // 2 AS n_bytes, coalesce(n, 0)::bigint AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(kept.h, t.h))) AS kept_sha256
FROM t LEFT JOIN sums ON sums.doc_id = t.doc_id LEFT JOIN kept ON kept.doc_id = t.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": OP2, "op5_exact_dedup": OP5, "op6_ngram_jaccard": OP6, "op9_decontamination": OP9}
