"""SQL for the rows of the queries, where SQL can express them, as DuckDB runs it."""

from __future__ import annotations


ORACLE_SQL: dict[str, str] = {
    "op1_hamming_topk": """
WITH v AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code FROM embeddings WHERE embedding IS NOT NULL
), d AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(bit_count(xor(q.code, v.code)) AS BIGINT) AS distance FROM v AS q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank, vec_id, distance FROM d
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10
""",
    "op4_secret_entropy": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
p AS (SELECT * FROM (VALUES
  (0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 12),
  (1, 'AKIA[A-Z0-9]+', 0, 18), (2, '[0-9a-f]+', 0, 16), (3, '[A-Za-z0-9+/_=-]+', 0, 20)) AS x(kind, pattern, part, least)),
g AS (
  SELECT r, kind, least, unnest(string_split_regex(t, pattern)) AS gap, unnest(regexp_extract_all(t, pattern, 0)) AS whole,
         unnest(CASE WHEN kind = 0 THEN regexp_extract_all(t, pattern, 2) ELSE regexp_extract_all(t, pattern, 0) END) AS val,
         unnest(range(1, 2 + len(regexp_extract_all(t, pattern, 0)))) AS i FROM d, p),
s AS (
  SELECT r, kind, least, whole, val, CAST(sum(length(gap) + coalesce(length(whole), 0)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM g),
m AS (SELECT r, kind, whole AS val, stop - length(whole) AS start, stop FROM s WHERE length(val) >= least),
c AS (
  SELECT r, val, start, stop, CASE
    WHEN regexp_full_match(val, '[0-9a-fA-F]+') AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-fA-F]') THEN 3.0
    WHEN regexp_matches(val, '[0-9].*[0-9]') AND (regexp_full_match(val, '[a-z0-9]*[a-z][a-z0-9]*') OR regexp_full_match(val, '[A-Z0-9]*[A-Z][A-Z0-9]*')) THEN 3.6
    WHEN regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]') THEN 3.8 END AS need
  FROM m WHERE kind = 3 AND NOT EXISTS (SELECT 1 FROM m AS b WHERE b.r = m.r AND b.kind < 3 AND b.start < m.stop AND m.start < b.stop)),
e AS (
  SELECT r, 3 AS kind, start, stop FROM c WHERE need IS NOT NULL
    AND NOT regexp_full_match(val, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}')
    AND NOT regexp_matches(val, '^sha(256|384|512)-') AND NOT regexp_matches(lower(val), 'example|placeholder|changeme|dummy|sample|redacted|1234567|abcdefg')
    AND NOT list_bool_or(list_transform(range(1, length(val) - 4), lambda i: lower(substr(val, i, 6)) = repeat(lower(substr(val, i, 1)), 6)))
    AND list_max(list_transform(range(1, length(val) - 18), lambda i: list_aggregate(string_split(substr(val, i, 20), ''), 'entropy'))) >= need - 1e-9),
f AS (SELECT r, kind, start, stop FROM m WHERE kind < 3 UNION ALL SELECT r, kind, start, stop FROM e),
n AS (SELECT *, concat(['assign', 'access', 'hex', 'entropy'][kind + 1], ':', start, ':', stop) AS span FROM f)
SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN n USING (r) GROUP BY r, doc_id
""",
    "op5_simhash_windows": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4])) AS shingle FROM d WHERE len(w) >= 5),
its AS (
  SELECT item_id, l, shingle, count(*) AS c
  FROM (SELECT item_id, len(w) AS l, unnest(list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4])) AS shingle FROM b WHERE len(w) >= 5) GROUP BY ALL),
met AS (SELECT doc_id, n, item_id, l, pos, shingle, c FROM ds JOIN its USING (shingle)),
starts AS (SELECT doc_id, item_id, n, l, unnest(range(0, greatest(0, n - l) + 1)) AS s FROM (SELECT DISTINCT doc_id, item_id, n, l FROM met)),
counted AS (
  SELECT x.doc_id, x.item_id, x.n, x.l, x.s, shingle, least(count(*), any_value(c)) AS m FROM starts AS x
  JOIN met ON met.doc_id = x.doc_id AND met.item_id = x.item_id AND pos BETWEEN s AND s + x.l - 5 GROUP BY ALL),
summed AS (SELECT doc_id, item_id, n, l, s, CAST(sum(m) AS BIGINT) AS shared FROM counted GROUP BY ALL),
weighed AS (SELECT doc_id, item_id, s, shared, CAST(least(n, l) - 4 + l - 4 - shared AS BIGINT) AS total FROM summed)
SELECT doc_id, item_id, CAST(s AS BIGINT) AS at, shared, total, shared / total AS similarity FROM weighed WHERE 100 * shared >= 75 * total
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / total DESC, s) = 1
""",
    "op7_minhash_bbit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w] ELSE list_transform(range(1, len(w) - 3), lambda i: w[i : i + 4]) END) AS shingle FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS hits FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * hits >= 75 * (x.n + y.n - hits)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach AS r JOIN edge AS e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN least USING (doc_id) LEFT JOIN n USING (doc_id)
""",
    "op10_block_anchors": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY sha256(win)) AS first FROM win) WHERE first < doc_id),
starts AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 50)))) AS gone FROM hit GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j))), lambda j: w[j]) END AS kept
  FROM d LEFT JOIN starts USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
""",
    "op9_url_cascade": """
WITH listed AS (
  SELECT concat(name, '.example.', top) AS domain FROM (SELECT unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS name), (SELECT unnest(['com', 'net', 'org']) AS top)
), u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN EXISTS (SELECT 1 FROM listed WHERE host = domain OR ends_with(host, '.' || domain)) THEN 'block' ELSE 'allow' END AS verdict FROM r
""",
}
