"""Oracle SQL of the operators which SQL can express."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned crc32 of a decimal text: each character is followed by its eight shifts."""
    moves = f"flatten(list_transform(string_split(CAST({text} AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    step = "CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {moves}), lambda a, b: {step}), 4294967295)"


def _field(column: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({column} AS VARCHAR))) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


_LEAF = " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MANIFEST = f"""
WITH RECURSIVE own AS (
  SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({_LEAF} || {_field('text')}) AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_crc32('doc_id')} % 3 = 0 THEN sha256({_LEAF} || {_field(_LOWER)}) ELSE sha256({_LEAF} || {_field('text')}) END AS probe
  FROM documents
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM own
),
tree AS (
  SELECT g, 0 AS lvl, idx, leaf AS d, n FROM leaves
  UNION ALL
  SELECT g, lvl + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, lvl, idx // 8, n
),
subroots AS (SELECT g, lvl AS top, d AS subroot, row_number() OVER (ORDER BY g) - 1 AS spot, count(*) OVER () AS n_groups FROM tree WHERE n = 1),
upper AS (
  SELECT 0 AS lvl, spot AS idx, subroot AS d, n_groups AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 8, sha256(string_agg(d, '' ORDER BY idx)), (n + 7) // 8 FROM upper WHERE n > 1 GROUP BY lvl, idx // 8, n
),
nodes AS (
  SELECT g, lvl, idx, d, n FROM tree WHERE n > 1
  UNION ALL SELECT '/', lvl, idx, d, n FROM upper WHERE n > 1
),
steps AS (
  SELECT a.g, a.lvl, a.idx, coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS before,
    coalesce(string_agg(b.d, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS after
  FROM nodes a JOIN nodes b ON a.g = b.g AND a.lvl = b.lvl AND a.idx // 8 = b.idx // 8 GROUP BY a.g, a.lvl, a.idx
),
way AS (
  SELECT l.doc_id, l.g, l.idx, l.leaf, l.probe, s.subroot, s.top, s.spot, 0 AS k, l.probe AS cur, '' AS proof
  FROM leaves l JOIN subroots s USING (g)
  UNION ALL
  SELECT w.doc_id, w.g, w.idx, w.leaf, w.probe, w.subroot, w.top, w.spot, w.k + 1, sha256(s.before || w.cur || s.after), w.proof || s.before || s.after
  FROM way w JOIN steps s
    ON s.g = CASE WHEN w.k < w.top THEN w.g ELSE '/' END AND s.lvl = CASE WHEN w.k < w.top THEN w.k ELSE w.k - w.top END
    AND s.idx = CASE WHEN w.k < w.top THEN w.idx >> (3 * w.k) ELSE w.spot >> (3 * (w.k - w.top)) END
),
root AS (SELECT d AS root, lvl AS height FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM way, root WHERE k = top + height"""


TRIE = f"""
WITH turns AS (
  SELECT conv_id, digest, bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM (
    SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS digest,
      strlen(coalesce(text, '')) AS bytes
    FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_crc32('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
  SELECT c.conv_id, t.pos, t.digest, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.pos, t.digest, t.bytes FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
),
seqs AS (
  SELECT c.conv_id, coalesce(string_agg(digest, '' ORDER BY pos), '') AS key, count(pos) AS size, list(bytes ORDER BY pos) AS bytes
  FROM convs c LEFT JOIN built b USING (conv_id) GROUP BY c.conv_id
),
prefixes AS (
  SELECT *, substr(key, 1, 32 * depth) AS p FROM (SELECT conv_id, key, size, bytes, unnest(range(size + 1)) AS depth FROM seqs)
),
nodes AS (
  SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n, max(CASE WHEN depth > 0 THEN bytes[depth] ELSE 0 END) AS bytes,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends
  FROM prefixes GROUP BY p, depth
),
children AS (SELECT left(p, -32) AS p, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.p = c.p AND n.depth = c.depth),
above AS (SELECT *, substr(p, 1, 32 * up) AS q FROM (SELECT *, unnest(range(depth + 1)) AS up FROM full_nodes)),
sums AS (
  SELECT q AS p, up AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n - 1) * bytes) AS saved_tokens
  FROM above GROUP BY q, up
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n AS n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM full_nodes n JOIN sums s ON n.p = s.p AND n.depth = s.depth
LEFT JOIN nodes u ON n.depth > 0 AND u.depth = n.depth - 1 AND u.p = left(n.p, -32)"""

NEAR_COPIES = r"""
WITH RECURSIVE own AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM own
),
shingles AS (SELECT r, unnest(s) AS s FROM sets),
links AS (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r)
  JOIN sets p ON p.r = a JOIN sets q ON q.r = b WHERE 100 * n >= 85 * (len(p.s) + len(q.s) - n)
),
reach AS (SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
named AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN sets ON sets.r = b GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM sets JOIN named USING (r)"""
