"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from .queries import URL_RULES

_WORD = r"[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_WORD}') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS m, w[i:i + 9] AS words FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM win),
dw AS (SELECT rid, m, p, w[p:p + m - 1] AS words FROM (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS p FROM d, ms WHERE len(w) >= m)),
occ AS (SELECT DISTINCT rid, p, m, item FROM dw JOIN win USING (m, words)),
hit AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + m)) AS q FROM (SELECT DISTINCT rid, p, m FROM occ)) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP4 = rf"""
WITH r(r_host, r_path, v) AS (VALUES {_RULES}),
u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT rid, r_host || r_path AS rule, v, row_number() OVER (PARTITION BY rid ORDER BY length(r_host) + length(r_path) DESC, v DESC) AS k FROM p JOIN r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) USING (rid)
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), m AS (SELECT html, max(page_id) AS last FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (('0x' || substr(h, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4)) & 31)::INT, 1), '' ORDER BY i) FROM range(32) t(i)) AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, html, sha1(html) AS h FROM p) JOIN m USING (html)
"""

ORACLES = {"op2_decontamination": OP2, "op4_url_filter": OP4, "op7_warc": OP7}
