"""SQL twins of the conversation queries."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit (reflected polynomial 0xEDB88320)."""
    start = "4294967295::UBIGINT"
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::UBIGINT)"
    eight = "range(8)::UBIGINT[]"
    bit = "CASE WHEN (b & 1) = 1 THEN xor(b >> 1, 3988292384::UBIGINT) ELSE b >> 1 END"
    byte = f"list_reduce(list_concat([xor(a, x)], {eight}), lambda b, i: {bit})"
    return f"xor(list_reduce(list_concat([{start}], {codes}), lambda a, x: {byte}), {start})"


REPAIR = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r0, coalesce(text, ' ') AS t0,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations),
e AS (
  SELECT conv_id, turn, sha256(r0 || ':' || t0) AS tie, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy,
         CASE WHEN d = 4 THEN 'user' ELSE r0 END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN translate(t0, '.!?', '') ELSE t0 END AS text
  FROM c WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie, copy) AS i, left(role, 1) AS init FROM e),
f AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(init) OVER (PARTITION BY conv_id ORDER BY i) || init NOT IN ('su', 'ua', 'au') AS bad FROM o),
-- the grammar: what an added row leads to, and what a kept one may
a(q, n) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
k(q, init, n) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins AS (
  SELECT q, q AS n, 0 AS cost, '' AS s FROM a
  UNION ALL SELECT x.q, x.n, 5, 'I' FROM a x
  UNION ALL SELECT x.q, y.n, 10, 'II' FROM a x JOIN a y ON y.q = x.n
  UNION ALL SELECT x.q, z.n, 15, 'III' FROM a x JOIN a y ON y.q = x.n JOIN a z ON z.q = y.n),
step AS (
  SELECT i.q, i.n AS n, '' AS init, 2 AS cost, false AS keeps, i.s || 'D' AS s, i.cost AS more FROM ins i
  UNION ALL SELECT i.q, a.n, '', 1, true, i.s || 'R', i.cost FROM ins i JOIN a ON a.q = i.n
  UNION ALL SELECT i.q, k.n, k.init, 0, true, i.s || 'K', i.cost FROM ins i JOIN k ON k.q = i.n),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': ''}} AS w FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, q, min(w) FROM (
    SELECT dp.conv_id, f.i, s.n AS q,
           {{'cost': dp.w.cost + s.cost + s.more + CASE WHEN s.keeps AND f.cut THEN 5 ELSE 0 END, 'audit': dp.w.audit || s.s}} AS w
    FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1
    JOIN step s ON s.q = dp.q AND (s.init = '' OR s.init = f.init) AND (NOT s.keeps OR NOT (f.blank OR f.again)))
  GROUP BY conv_id, i, q),
n AS (SELECT conv_id, max(i) AS i FROM dp GROUP BY conv_id),
best AS (
  SELECT dp.conv_id, min({{'cost': dp.w.cost + ins.cost, 'audit': dp.w.audit || ins.s}}) AS w
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.i = dp.i JOIN ins ON ins.q = dp.q AND ins.n IN (0, 3) GROUP BY dp.conv_id),
l AS (SELECT conv_id, unnest(string_split(w.audit, '')) AS letter, generate_subscripts(string_split(w.audit, ''), 1) AS p FROM best WHERE w.audit <> ''),
m AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM l),
out AS (
  SELECT m.conv_id, m.p, m.letter, f.role, f.text, f.init,
         row_number() OVER (PARTITION BY m.conv_id ORDER BY m.p) AS place
  FROM m LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.i AND m.letter <> 'I' WHERE m.letter <> 'D'),
told AS (
  SELECT *, place - max(CASE WHEN place = 1 AND letter = 'K' AND init = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS turn FROM out),
fixed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS repaired_sha256
  FROM told GROUP BY conv_id),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT blank AND NOT again) AS truncated,
         count(*) FILTER (bad) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, b.w.cost::BIGINT AS cost, b.w.audit AS audit,
       coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM best b LEFT JOIN facts x ON x.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN fixed y ON y.conv_id IS NOT DISTINCT FROM b.conv_id
"""


TRIE = rf"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, max(pos) AS own, {crc32_sql("conv_id::VARCHAR")} % 6 AS h FROM o GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.own, 0)) AS b FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
r AS (
  SELECT p.conv_id, o.pos AS depth, role, text FROM p JOIN o ON o.conv_id = p.conv_id - p.conv_id % 100 AND o.pos <= p.b
  UNION ALL SELECT p.conv_id, p.b + o.pos - p.h, role, text FROM p JOIN o ON o.conv_id = p.conv_id AND o.pos > p.h),
q AS (SELECT p.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY depth) FILTER (depth IS NOT NULL), []) AS seq FROM p LEFT JOIN r ON r.conv_id = p.conv_id GROUP BY p.conv_id),
x AS (SELECT conv_id, len(seq) AS size, seq, unnest(range(0, len(seq) + 1)) AS depth FROM q),
k AS (SELECT conv_id, size, depth, seq[1:depth] AS key, CASE WHEN depth > 0 THEN length(seq[depth].text) ELSE 0 END AS n FROM x),
g AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n) AS saves,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256 FROM k GROUP BY key, depth),
u AS (SELECT key[1:depth - 1] AS key, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY 1),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf FROM g LEFT JOIN u ON u.key = g.key),
a AS (SELECT key, leaf, saves, unnest(range(0, depth + 1)) AS top FROM w),
s AS (SELECT key[1:top] AS key, sum(leaf) AS n_leaves, sum(saves) AS saved_tokens FROM a GROUP BY 1)
SELECT w.conv_id, w.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.key = w.key LEFT JOIN g up ON w.depth > 0 AND up.key = w.key[1:w.depth - 1]
"""
