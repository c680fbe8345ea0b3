"""DuckDB SQL for the queries that SQL can express on the given tables."""

OP7 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN ws IS NULL OR len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.c AS component_id, s.doc_id = m.c AS kept
FROM s JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = s.doc_id
"""

#: A pass of the filling; passes end when nothing fits any more, and ten are more than the tables need.
_FILL = """
g{k} AS (SELECT sid, any_value(rest) - coalesce(sum(size) FILTER (got), 0) AS gap FROM d{j} GROUP BY sid),
f{k} AS (SELECT d.*, NOT d.got AND d.size > 0 AND d.size <= g.gap AS fits, g.gap FROM d{j} d JOIN g{k} g USING (sid)),
d{k} AS (
  SELECT doc_id, sid, size, source_size, target, whole, rest, xi, got OR (fits AND
    sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY sid ORDER BY xi, doc_id, size ROWS UNBOUNDED PRECEDING) <= gap) AS got
  FROM f{k})"""

OP1 = r"""
WITH z AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
v AS (SELECT *, 1 + sid % 3 AS weight, 3 * source_size AS lim FROM s),
l AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(lim) OVER o, 0) AS remain, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share
  FROM v WINDOW o AS (ORDER BY CAST(lim AS DOUBLE) / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
y AS (SELECT *, lim * share <= remain * weight AS is_full FROM l),
t AS (
  SELECT *, CASE WHEN is_full THEN CAST(lim AS DOUBLE)
    ELSE (SELECT CAST(remain AS DOUBLE) / CAST(share AS DOUBLE) FROM y WHERE NOT is_full ORDER BY share DESC LIMIT 1) * weight END AS target FROM y),
o AS (
  SELECT source, sid, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM o),
c AS (SELECT source, CAST(size AS DOUBLE) AS x, CAST(count(*) AS DOUBLE) AS n FROM z WHERE size > 0 GROUP BY source, size),
h AS (
  SELECT q.sid, c.x, q.rest - coalesce(sum(c.x * c.n) OVER (PARTITION BY q.sid ORDER BY c.x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
    sum(c.x * c.x * c.n) OVER (PARTITION BY q.sid ORDER BY c.x ROWS UNBOUNDED PRECEDING) AS squares
  FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source),
v1 AS (SELECT sid, max(x) AS level FROM h WHERE x * remain < squares GROUP BY sid),
v2 AS (SELECT h.sid, level, remain, squares FROM h JOIN v1 ON h.sid = v1.sid AND h.x = v1.level),
i AS (
  SELECT z.doc_id, q.sid, z.size, q.source_size, q.target, q.whole, q.rest,
    CASE WHEN z.size <= level THEN remain * z.size / squares WHEN z.size > level THEN 1.0 WHEN level IS NULL AND z.size > 0 AND rest > 0 THEN 1.0 ELSE 0.0 END AS incl,
    (CAST('0x' || substr(md5('mix' || coalesce(CAST(z.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM z JOIN q ON z.source IS NOT DISTINCT FROM q.source LEFT JOIN v2 USING (sid)),
d0 AS (
  SELECT doc_id, sid, size, source_size, target, whole, rest, FALSE AS got,
    CASE WHEN incl >= 1 THEN 0.0 WHEN incl > 0 THEN (u / (1 - u)) / (incl / (1 - incl)) ELSE 1e300 END AS xi FROM i),""" + ",".join(_FILL.format(k=k, j=k - 1) for k in range(1, 11)) + """
SELECT doc_id, size, source_size, target, CAST((whole + CAST(got AS BIGINT)) * size AS BIGINT) AS taken FROM d10
"""


OP4 = r"""
WITH src AS (SELECT 0 AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 1, item_id, text FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT side, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM src),
s AS (
  SELECT side, id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
k AS (SELECT DISTINCT len(ws) AS n FROM w WHERE side = 1 AND len(ws) BETWEEN 1 AND 4),
d AS (
  SELECT id, unnest(sh) AS g FROM s WHERE side = 0 UNION
  SELECT id, unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) FROM w, k WHERE side = 0 AND len(ws) >= n),
q AS (SELECT id, len(sh) AS n, unnest(sh) AS g FROM s WHERE side = 1),
f AS (SELECT d.id AS doc_id, q.id AS item_id, count(*) / n AS share FROM d JOIN q USING (g) GROUP BY d.id, q.id, n HAVING count(*) * 100 >= 75 * n),
p AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS items, max(share) AS containment FROM f GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, CAST(coalesce(containment, 0) AS DOUBLE) AS containment, n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN p USING (doc_id)
"""

OP8 = r"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (
  SELECT vec_id, x FROM v WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND list_dot_product(x, x) > 0),
p AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.id),
m AS (SELECT id, min(c) AS c FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN m ON m.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

OP9 = r"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    CASE WHEN role = 'assistant' THEN row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) END AS k,
    count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS ks
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
u AS (
  SELECT t.*, CASE WHEN t.k = t.ks THEN coalesce(o.text, '') ELSE t.text END AS other
  FROM t LEFT JOIN t o ON o.conv_id = t.conv_id AND o.k = t.ks - 1 AND t.k = t.ks),
f AS (SELECT *, coalesce(min(i) FILTER (text IS DISTINCT FROM other) OVER (PARTITION BY conv_id), n + 1) AS cut FROM u),
h AS (
  SELECT *, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS one, coalesce(other, '') || '<|end|>' || chr(10) AS two FROM f),
e AS (
  SELECT *, sum(length(head) + length(one)) FILTER (i >= cut) OVER w AS e1, sum(length(head) + length(two)) FILTER (i >= cut) OVER w AS e2
  FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY i))
SELECT conv_id AS pair_id, CAST(any_value(cut) - 1 AS BIGINT) AS n_prefix,
  coalesce(string_agg(head || one, '' ORDER BY i) FILTER (i < cut), '') AS prompt,
  coalesce(string_agg(head || one, '' ORDER BY i) FILTER (i >= cut), '') AS chosen,
  coalesce(string_agg(head || two, '' ORDER BY i) FILTER (i >= cut), '') AS rejected,
  coalesce(string_agg(CAST(e1 - length(one) AS BIGINT) || '-' || CAST(e1 AS BIGINT), ',' ORDER BY i) FILTER (i >= cut AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(e2 - length(two) AS BIGINT) || '-' || CAST(e2 AS BIGINT), ',' ORDER BY i) FILTER (i >= cut AND role = 'assistant'), '') AS rejected_mask
FROM e GROUP BY conv_id
"""


OP12 = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, strpos(url, '://') > 0 AS whole, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, string_split(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '&') AS given FROM u),
c AS (
  SELECT page_id, host, path, row_number() OVER () AS r,
    CASE WHEN whole THEN regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), '[.]*(:80|:443)?$', ''), '^www[.]', '') || regexp_replace(path, '/+(index[.]html?)?$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(given, lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&'), ''), '') END AS canonical
  FROM h),
listed AS (SELECT DISTINCT canonical AS name FROM c WHERE canonical IS NOT NULL AND regexp_matches(host, '(^|[.-])(ads|adult|bets|casino|pills|spam)([.-]|$)')),
rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT c.r, h || p AS rule, v FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY c.r ORDER BY length(h) + length(p) DESC) = 1)
SELECT page_id, host, path, canonical, rule, coalesce(v, CASE WHEN name IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN best USING (r) LEFT JOIN listed ON name = canonical
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mixing": OP1,
        "op4_minhash_containment": OP4,
        "op7_minhash_near_dedup": OP7,
        "op8_cross_polytope": OP8,
        "op9_preference_format": OP9,
        "op12_url_filter": OP12,
    }
