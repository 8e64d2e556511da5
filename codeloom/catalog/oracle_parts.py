"""Common table expressions of the oracles (DuckDB SQL over the base tables).

They state the expected facts of the generated files straight from orders, lines and
parts; no operator and no parser is involved.
"""

from __future__ import annotations

from codeloom.functions import lexicons as lx


def _values(pairs: list[tuple[str, str]]) -> str:
    return ", ".join(f"({i}, '{t}', '{v}')" for i, (t, v) in enumerate(pairs))


def _hint_test(column: str, hints: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{h}')" for h in hints) + ")"


ENTRY_HINT = _hint_test("lower(short_name)", lx.ENTRY_POINT_HINTS)

BASE = f"""
etok(pos, token, tag) AS (VALUES {_values(lx.ENTITY_TOKENS)}),
ctok(pos, token, tag) AS (VALUES {_values(lx.CRUD_TOKENS)}),
o AS (
  SELECT 'run-' || (o_custkey % 32) AS run_id, o_orderkey AS k,
    CASE o_orderstatus WHEN 'F' THEN 'process' WHEN 'O' THEN 'create' ELSE 'review' END AS verb,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Payment' WHEN '2-HIGH' THEN 'Shipment'
      WHEN '3-MEDIUM' THEN 'Invoice' WHEN '4-NOT SPECIFIED' THEN 'Ledger' ELSE 'Account' END AS noun
  FROM orders),
l AS (
  SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r
  FROM lineitem GROUP BY 1),
allparts AS (
  SELECT 'run-' || (p_partkey % 32) AS run_id, p_partkey AS p, p_size AS sz,
    replace(p_name, ' ', '_') AS alias,
    CASE WHEN p_partkey % 32 = 0 THEN 'tests' ELSE 'parts' END AS dir,
    CASE WHEN p_size BETWEEN 41 AND 45 THEN 2 ELSE 1 END AS first
  FROM part),
pt AS (SELECT * FROM allparts WHERE sz NOT IN (47, 49, 50)),
names AS (SELECT DISTINCT alias FROM pt),
ae AS (SELECT alias, list_sort(list(DISTINCT tag)) AS ents FROM names JOIN etok ON contains(lower(alias), token) GROUP BY 1),
ac AS (SELECT alias, list_sort(list(DISTINCT tag)) AS crud FROM names JOIN ctok ON contains(lower(alias), token) GROUP BY 1),
fn AS (
  SELECT run_id, 'svc/order_' || k || '.py' AS file_path, 1 AS fn_ord,
    'svc.order_' || k || '.' || verb || '_order_' || k AS qname, verb || '_order_' || k AS short_name,
    upper(verb[1]) || verb[2:] || ' Order ' || k AS title,
    4 AS line_start, 5 + 2 * coalesce(n, 0) + coalesce(r, 0) AS line_end,
    1 + coalesce(n, 0) AS complexity, coalesce(n, 0) AS n_calls,
    CASE WHEN r > 0 THEN list_sort(['Order', noun]) ELSE ['Order'] END AS ents,
    CASE WHEN verb = 'create' THEN ['create'] ELSE [] END AS crud,
    k AS okey, NULL AS pkey
  FROM o LEFT JOIN l USING (k)
  UNION ALL
  SELECT run_id, dir || '/part_' || p || CASE WHEN sz = 48 THEN '/__init__.py' ELSE '.py' END, 1,
    dir || '.part_' || p || '.part_' || p, 'part_' || p, 'Part ' || p, first, first + 2, 1,
    CASE WHEN sz <= 10 THEN 0 ELSE 1 END,
    CASE WHEN sz <= 10 THEN ['Stock'] WHEN sz <= 20 THEN ['Lead'] ELSE coalesce(ents, []) END,
    CASE WHEN sz <= 10 THEN [] WHEN sz <= 20 THEN ['update'] ELSE coalesce(crud, []) END,
    NULL, p
  FROM pt LEFT JOIN ae USING (alias) LEFT JOIN ac USING (alias)
  UNION ALL
  SELECT run_id, dir || '/part_' || p || CASE WHEN sz = 48 THEN '/__init__.py' ELSE '.py' END, 2,
    dir || '.part_' || p || '.' || alias, alias,
    array_to_string(list_transform(string_split(alias, '_'), lambda w: upper(w[1]) || w[2:]), ' '),
    first + 5, first + 6, 1, 0, coalesce(ents, []), coalesce(crud, []), NULL, NULL
  FROM pt LEFT JOIN ae USING (alias) LEFT JOIN ac USING (alias)),
lcalls AS (
  SELECT l_orderkey AS k, l_partkey AS p, l_linenumber AS n, l_returnflag AS rf, l_linestatus AS ls,
    CASE WHEN l_linestatus = 'O' THEN 'parts.part_' || l_partkey || '.part_' || l_partkey
         ELSE 'part_' || l_partkey END AS call,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) - 1 AS call_ord
  FROM lineitem),
calls AS (
  SELECT run_id, qname AS source, call_ord, call FROM fn JOIN lcalls ON okey = k
  UNION ALL
  SELECT fn.run_id, qname, 0, CASE WHEN sz <= 20 THEN 'x.update_lead' ELSE alias END
  FROM fn JOIN pt ON pkey = p WHERE sz > 10)
"""

EDGES = """
uniq AS (
  SELECT run_id, short_name, min(qname) AS target FROM fn GROUP BY 1, 2 HAVING count(DISTINCT qname) = 1),
edges AS (
  SELECT DISTINCT f.run_id, f.qname AS source, g.qname AS target
  FROM lineitem JOIN fn f ON f.okey = l_orderkey JOIN fn g ON g.pkey = l_partkey AND g.run_id = f.run_id
  UNION
  SELECT f.run_id, f.qname, target
  FROM fn f JOIN pt ON f.pkey = p JOIN uniq u ON u.run_id = f.run_id AND u.short_name = alias WHERE sz > 20),
deg AS (
  SELECT run_id, qname, sum(o) AS out_degree, sum(i) AS in_degree FROM (
    SELECT run_id, source AS qname, 1 AS o, 0 AS i FROM edges
    UNION ALL SELECT run_id, target, 0, 1 FROM edges) GROUP BY 1, 2),
prof AS (
  SELECT fn.*, coalesce(out_degree, 0)::BIGINT AS out_degree, coalesce(in_degree, 0)::BIGINT AS in_degree
  FROM fn LEFT JOIN deg USING (run_id, qname))
"""

RUNS = """
runs AS (
  SELECT DISTINCT 'run-' || (o_custkey % 32) AS run_id, 'erp-run-' || (o_custkey % 32) AS root_name FROM orders
  UNION ALL
  SELECT 'empty-' || s_suppkey,
    CASE s_nationkey % 3 WHEN 0 THEN 'erp' WHEN 1 THEN 'crm' ELSE 'doc' END || '-' || s_suppkey FROM supplier)
"""

RISK = """
cx AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY complexity DESC, file_path, fn_ord) AS place FROM prof),
cp AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY out_degree + in_degree DESC, file_path, fn_ord) AS place
  FROM prof),
dc AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY file_path, fn_ord) AS place FROM prof
  WHERE out_degree = 0 AND in_degree = 0 AND complexity >= 3 AND NOT """ + ENTRY_HINT + """),
tg AS (SELECT run_id FROM prof GROUP BY 1 HAVING NOT bool_or(contains(lower(file_path), 'test'))),
found AS (
  SELECT run_id, place AS finding_ord, 'complexity-' || place AS finding_id, 'complexity' AS category,
    round(least(98e0, 20 + complexity * 5 + out_degree * 2), 2) AS score,
    'High complexity in ' || short_name AS title,
    'Cyclomatic estimate ' || complexity || ' with outbound dependency count ' || out_degree || '.' AS rationale,
    qname AS symbol
  FROM cx WHERE place <= 3
  UNION ALL
  SELECT run_id, 4, 'coupling-1', 'coupling', round(least(95e0, 35 + (out_degree + in_degree) * 7), 2),
    'Coupling hotspot across modules',
    'Function has in/out call degree ' || in_degree || '/' || out_degree || '.', qname
  FROM cp WHERE place = 1
  UNION ALL
  SELECT run_id, 5, 'dead-code-1', 'dead_code', round(least(88e0, 28 + complexity * 6), 2),
    'Potential dead code path',
    'No inbound and outbound calls observed in static call graph approximation.', qname
  FROM dc WHERE place = 1
  UNION ALL
  SELECT run_id, 6, 'test-gap-1', 'test_gap', round(least(94e0, 55 + complexity * 3), 2),
    'Limited test coverage signals',
    'No test files detected in scanned Python paths while critical logic is complex.', qname
  FROM cx JOIN tg USING (run_id) WHERE place = 1),
allfound AS (
  SELECT * FROM found
  UNION ALL
  SELECT run_id, 1, 'complexity-fallback', 'complexity', 20e0, 'Low confidence risk snapshot',
    'Repository contained too few Python symbols for robust risk scoring.', 'n/a'
  FROM runs WHERE run_id NOT IN (SELECT run_id FROM found)),
findings AS (
  SELECT *, CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high'
    WHEN score >= 50 THEN 'medium' ELSE 'low' END AS severity FROM allfound),
overall AS (SELECT run_id, round(avg(score), 2) AS overall_score FROM findings GROUP BY 1)
"""

WORKFLOW = """
ranked AS (
  SELECT *, complexity * 2.4e0 + out_degree * 1.8e0
    + ((CASE WHEN """ + ENTRY_HINT + """ THEN 6e0 ELSE 0e0 END) + len(ents) * 1.5e0 + len(crud) * 1e0) AS rank FROM prof),
sel AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank DESC, file_path, fn_ord) AS node_ord
    FROM ranked) WHERE node_ord <= 8),
wn AS (
  SELECT run_id, node_ord, 'wf-' || substr(sha1(qname), 1, 10) AS node_id, title AS label,
    round(least(95e0, 15 + complexity * 4 + out_degree * 3), 2) AS risk_score FROM sel),
ctl AS (
  SELECT e.run_id, row_number() OVER (PARTITION BY e.run_id ORDER BY source, target) AS edge_ord,
    'wf-' || substr(sha1(source), 1, 10) AS source, 'wf-' || substr(sha1(target), 1, 10) AS target,
    'control' AS edge_type, 0.88e0 AS confidence
  FROM edges e
  WHERE source <> target AND (e.run_id, source) IN (SELECT (run_id, qname) FROM sel)
    AND (e.run_id, target) IN (SELECT (run_id, qname) FROM sel)),
chain AS (
  SELECT a.run_id, a.node_ord AS edge_ord, a.node_id AS source, b.node_id AS target,
    'control' AS edge_type, 0.62e0 AS confidence
  FROM wn a JOIN wn b ON a.run_id = b.run_id AND b.node_ord = a.node_ord + 1
  WHERE a.run_id NOT IN (SELECT run_id FROM ctl)),
hubedge AS (
  SELECT run_id, coalesce((SELECT max(edge_ord) FROM (SELECT * FROM ctl UNION ALL SELECT * FROM chain) x
      WHERE x.run_id = w.run_id), 0) + 1 AS edge_ord, node_id AS source, 'risk-hub' AS target,
    'risk' AS edge_type, 0.84e0 AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY risk_score DESC, node_ord) AS best FROM wn) w
  WHERE best = 1),
wnodes AS (
  SELECT run_id, node_ord, node_id, label, CASE WHEN risk_score >= 75 THEN 'risk' ELSE 'process' END AS node_type, risk_score FROM wn
  UNION ALL
  SELECT run_id, max(node_ord) + 1, 'risk-hub', 'Risk Aggregator', 'risk', any_value(overall_score)
  FROM wn JOIN overall USING (run_id) GROUP BY 1),
wedges AS (SELECT * FROM ctl UNION ALL SELECT * FROM chain UNION ALL SELECT * FROM hubedge)
"""

LINEAGE = """
seen AS (SELECT run_id, unnest(ents) AS entity FROM fn),
counts AS (SELECT run_id, entity, count(*) AS functions FROM seen GROUP BY 1, 2),
defaults AS (
  SELECT run_id, unnest(['Customer', CASE WHEN contains(root_name, 'erp') THEN 'Order'
    WHEN contains(root_name, 'crm') THEN 'Lead' ELSE 'Document' END, 'Invoice']) AS entity, unnest([2, 2, 1]) AS functions
  FROM runs WHERE run_id NOT IN (SELECT run_id FROM counts)),
top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY functions DESC, entity) AS node_ord
    FROM (SELECT * FROM counts UNION ALL SELECT * FROM defaults)) WHERE node_ord <= 6),
trans AS (
  SELECT o.run_id, unnest(['Order', noun]) AS source, unnest([noun, 'Order']) AS target, r AS weight
  FROM o JOIN l USING (k)
  WHERE r > 0 AND (o.run_id, noun) IN (SELECT (run_id, entity) FROM top)
    AND (o.run_id, 'Order') IN (SELECT (run_id, entity) FROM top)),
tw AS (SELECT run_id, source, target, sum(weight)::BIGINT AS weight FROM trans GROUP BY 1, 2, 3),
lnodes AS (
  SELECT run_id, node_ord, 'entity-' || lower(entity) AS node_id, entity AS label, 'data' AS node_type,
    round(least(70e0, 8 + functions * 9), 2) AS risk_score FROM top),
ldata AS (
  SELECT run_id, edge_ord, 'entity-' || lower(source) AS source, 'entity-' || lower(target) AS target,
    'data' AS edge_type, round(least(0.98e0, 0.55e0 + weight * 0.08e0), 2) AS confidence
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC, source, target) AS edge_ord FROM tw)
  WHERE edge_ord <= 12),
lchain AS (
  SELECT a.run_id, a.node_ord AS edge_ord, a.node_id AS source, b.node_id AS target, 'data' AS edge_type, 0.6e0 AS confidence
  FROM lnodes a JOIN lnodes b ON a.run_id = b.run_id AND b.node_ord = a.node_ord + 1
  WHERE a.run_id NOT IN (SELECT run_id FROM ldata)),
ledges AS (SELECT * FROM ldata UNION ALL SELECT * FROM lchain)
"""


def with_parts(*parts: str, select: str) -> str:
    """One statement from several blocks of table expressions."""
    return "WITH " + ",".join(part.strip() for part in parts) + "\n" + select
