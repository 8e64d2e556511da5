"""Queries: cited answers and derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import adapters as ad
from codeloom.catalog import oracle_parts as op
from codeloom.catalog.graphs_and_risk import EVIDENCE_PARTS
from codeloom.catalog.registry import query
from codeloom.functions.scores import score_bucket
from codeloom.functions.text import crud_from_text, entity_from_text, humanise_label
from codeloom.operators import answers, callgraph, layers, migration, views
from codeloom.session import stored

_RISK = (op.BASE, op.EDGES, op.RUNS, op.RISK)

# ---- cited answers ----------------------------------------------------------

_FOCUS = """CASE o_orderpriority WHEN '1-URGENT' THEN 'risk-hub' WHEN '2-HIGH' THEN 'entity-order'
  WHEN '3-MEDIUM' THEN 'none' WHEN '4-NOT SPECIFIED' THEN '' END"""


def _requests(spark, sf_dir):
    return ad.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id", "concat('run-', o_custkey % 32) AS run_id",
        "concat('q', o_orderkey) AS question", f"{_FOCUS} AS focus_node_id",
    )


def _context(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    proof = stored(p.evidence)
    runs = ad.run_table(spark, sf_dir)
    enrichment = runs.selectExpr("run_id", "'completed' AS status", "concat('{\"root\":\"', root_name, '\"}') AS response")
    counted = migration.run_counters(p.workflow_nodes, p.lineage_edges, p.findings)
    states = runs.select("run_id", F.lit("completed").alias("status")).join(counted, "run_id")
    context = stored(answers.run_context(p.workflow_nodes, p.workflow_edges, p.findings, proof, enrichment, states))
    return answers.answer_context(_requests(spark, sf_dir), context, proof)


def _remote(spark, sf_dir):
    """Recorded remote answers: good ones, failures, broken texts, and none at all."""
    text = """CASE WHEN o_orderstatus = 'F' THEN concat('{"answer": " A', o_orderkey, ' ", "citations": [',
          if(o_custkey % 2 = 0, concat('{"file": "f', o_custkey, '.py"}'), ''), '], "risk_implications": ["r1", " "], "related_nodes": []}')
        WHEN o_orderstatus = 'O' THEN '{"answer": "late"}' ELSE 'no json' END"""
    return ad.table(spark, sf_dir, "orders").where("o_totalprice > 100000").selectExpr(
        "o_orderkey AS request_id", f"{text} AS raw_text", "if(o_orderstatus = 'O', 'timeout', null) AS error"
    )


_ANSWER_PARTS = (
    *EVIDENCE_PARTS,
    f"""
req AS (SELECT o_orderkey AS request_id, 'run-' || (o_custkey % 32) AS run_id, nullif({_FOCUS}, '') AS asked,
  o_orderstatus AS st, o_custkey AS ck, o_totalprice > 100000 AS remote FROM orders),
ctx AS (SELECT req.*, coalesce(asked, node_id) AS focus FROM req JOIN wnodes w ON w.run_id = req.run_id AND node_ord = 1),
ctop AS (SELECT run_id, symbol, severity, score, category FROM tf WHERE place = 1),
full_ctx AS (
  SELECT ctx.*, files, symbols, explanation, t.symbol, t.severity, t.score, t.category
  FROM ctx LEFT JOIN ev ON ev.run_id = ctx.run_id AND ev.node_id = focus JOIN ctop t ON t.run_id = ctx.run_id)""",
)
_TF = """
tf AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, finding_ord) AS place FROM findings)"""
_ANSWERS = (*_ANSWER_PARTS[:-1], _TF, _ANSWER_PARTS[-1])

_PAIRS = """array_to_string(list_transform(list_zip(string_split(files, '|')[1:3], string_split(symbols, '|')[1:3], true),
    lambda z: z[1] || '>' || z[2] || '>' || {reason}), '|')"""
_TOP_FILE = "CASE WHEN contains(symbol, '.') THEN string_split(symbol, '.')[1] || '.py' ELSE 'unknown.py' END"
_LOCAL_CITES = f"""CASE WHEN files IS NULL THEN {_TOP_FILE} || '>' || symbol || '>Highest risk symbol in this run.'
    ELSE {_PAIRS.format(reason="'Evidence linked to focused node `' || focus || '`.'")} END"""
_LOCAL_ANSWER = """'Primary impact area is `' || symbol || '` (' || severity || ', score ' || score || '). For change around `' || focus
    || '`, prioritize tests on dependent calls and data-flow handoffs shown in workflow/lineage graphs.'"""


def _cites(column):
    text = lambda c: F.concat_ws(">", c["file_path"], c["symbol"], c["reason"])
    return F.array_join(F.transform(column, text), "|").alias("citations")


_SUGGESTED = """CASE category
  WHEN 'complexity' THEN 'Refactor into smaller functions with single responsibility;Extract service layer to isolate business logic'
  WHEN 'coupling' THEN 'Introduce interface boundary between modules;Apply dependency injection to decouple components'
  WHEN 'dead_code' THEN 'Safe to remove after verifying no runtime references;Archive and monitor for regression'
  ELSE 'Add unit tests for critical business logic paths;Prioritize integration tests for high-risk flows' END"""

# Each list of the context as one text, field by field; the digests keep the rows short.
_CONTEXT_TEXTS = f"""
tn AS (SELECT run_id, md5(string_agg(node_id || '>' || label || '>' || node_type || '>' || risk_score, '|' ORDER BY node_ord)
    FILTER (node_ord <= 12)) AS nodes, count(*) AS n FROM wnodes GROUP BY 1),
te AS (SELECT run_id, md5(string_agg(source || '>' || target || '>' || edge_type || '>' || confidence, '|' ORDER BY edge_ord)
    FILTER (nr <= 20)) AS edges FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY edge_ord) AS nr FROM wedges) GROUP BY 1),
tr AS (SELECT run_id, count(*) AS n, md5(string_agg(finding_id || '>' || category || '>' || severity || '>' || score || '>' || title || '>'
    || rationale || '>' || symbol || '>' || {_SUGGESTED}, '|' ORDER BY finding_ord) FILTER (nr <= 8)) AS findings
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finding_ord) AS nr FROM findings) GROUP BY 1),
tv AS (SELECT run_id, md5(string_agg(node_id || '>' || label || '>' || replace(files, '|', ';') || '>' || replace(symbols, '|', ';') || '>' || explanation,
    '|' ORDER BY node_ord)) AS node_evidence FROM wnodes JOIN ev USING (run_id, node_id) WHERE node_ord <= 12 GROUP BY 1),
tl AS (SELECT run_id, count(*) AS n FROM ledges GROUP BY 1)"""


@query("C1_answer_context", op.with_parts(*_ANSWERS, _CONTEXT_TEXTS, select="""
    SELECT request_id, c.run_id, 'q' || request_id AS question, focus, files AS focus_files, symbols AS focus_symbols,
      explanation AS focus_explanation, tn.nodes, te.edges, tr.findings, tv.node_evidence,
      'completed>' || tn.n || '>' || coalesce(tl.n, 0) || '>' || tr.n AS run,
      'completed>{"root":"erp-' || c.run_id || '"}' AS enrichment
    FROM full_ctx c JOIN tn ON tn.run_id = c.run_id JOIN tr ON tr.run_id = c.run_id LEFT JOIN te ON te.run_id = c.run_id
    LEFT JOIN tv ON tv.run_id = c.run_id LEFT JOIN tl ON tl.run_id = c.run_id"""))
def context(spark, sf_dir):
    def digest(name, *fields):
        def text(r):
            listed = {"files", "symbols", "suggestions"}
            return F.concat_ws(">", *[F.array_join(r[f], ";") if f in listed else r[f].cast("string") for f in fields])

        return F.md5(F.array_join(F.transform(name, text), "|")).alias(name)

    focus = F.col("focus_evidence")
    return _context(spark, sf_dir).select(
        "request_id", "run_id", "question", "focus",
        F.array_join(focus["files"], "|").alias("focus_files"), F.array_join(focus["symbols"], "|").alias("focus_symbols"),
        focus["explanation"].alias("focus_explanation"),
        digest("nodes", "node_id", "label", "node_type", "risk_score"),
        digest("edges", "source", "target", "edge_type", "confidence"),
        digest("findings", "finding_id", "category", "severity", "score", "title", "rationale", "symbol", "suggestions"),
        digest("node_evidence", "node_id", "label", "files", "symbols", "explanation"),
        F.concat_ws(">", "run.status", "run.workflow_nodes", "run.lineage_edges", "run.risk_findings").alias("run"),
        F.concat_ws(">", "enrichment.status", "enrichment.response").alias("enrichment"),
    )


@query("C2_local_answer", op.with_parts(*_ANSWERS, select=f"SELECT request_id, {_LOCAL_ANSWER} AS answer FROM full_ctx"))
def local_answers(spark, sf_dir):
    return _context(spark, sf_dir).select("request_id", answers.local_answer().alias("answer"))


@query("C3_citations", op.with_parts(*_ANSWERS, select=f"SELECT request_id, {_LOCAL_CITES} AS citations FROM full_ctx"))
def cited(spark, sf_dir):
    return _context(spark, sf_dir).select("request_id", _cites(answers.citations()))


@query("C4_prefer_remote_answer", op.with_parts(*_ANSWERS, select=f"""
    SELECT request_id, CASE WHEN remote AND st = 'F' THEN 'remote' ELSE 'local' END AS source,
      CASE WHEN remote AND st = 'F' THEN 'A' || request_id ELSE {_LOCAL_ANSWER} END AS answer,
      CASE WHEN remote AND st = 'F' THEN CASE WHEN ck % 2 = 0 THEN 'f' || ck || '.py>unknown>Dust citation'
          ELSE coalesce({_PAIRS.format(reason="'Focused evidence from analysis artifact'")}, '') END
        ELSE {_LOCAL_CITES} END AS citations,
      CASE WHEN remote AND st = 'F' THEN 'r1' ELSE 'Top risk category: ' || category
        || '|Potential regressions where control-flow and data-flow intersect' END AS risk_implications
    FROM full_ctx"""))
def preferred(spark, sf_dir):
    found = answers.answers(_context(spark, sf_dir), answers.remote_answers(_remote(spark, sf_dir)))
    return found.select(
        "request_id", "source", "answer", _cites(F.col("citations")),
        F.array_join("risk_implications", "|").alias("risk_implications"),
    )


@query("C5_related_nodes", op.with_parts(*_ANSWERS, select="""
    SELECT request_id, (SELECT string_agg(node_id, '|' ORDER BY node_ord) FROM wnodes x WHERE x.run_id = c.run_id AND node_ord <= 5) AS related
    FROM full_ctx c"""))
def related(spark, sf_dir):
    return _context(spark, sf_dir).select("request_id", F.array_join(answers.related_nodes(), "|").alias("related"))


# ---- findings views ---------------------------------------------------------

# Orders as findings of their customer.
_AS_FINDING = """o_custkey AS run_id, o_orderkey AS finding_ord, CASE o_orderpriority WHEN '1-URGENT' THEN 'complexity' WHEN '2-HIGH' THEN 'coupling'
  WHEN '3-MEDIUM' THEN 'dead_code' WHEN '4-NOT SPECIFIED' THEN 'test_gap' ELSE 'unknown' END AS category,
  CASE WHEN o_totalprice > 425000 THEN 'critical' WHEN o_totalprice > 350000 THEN 'high' WHEN o_totalprice > 250000 THEN 'medium' ELSE 'low' END AS severity,
  o_totalprice / 5000 AS score"""


def _order_findings(spark, sf_dir):
    table = ad.table(spark, sf_dir, "orders")
    return table.selectExpr(
        "o_custkey AS run_id", "o_orderkey AS finding_ord",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'complexity' WHEN '2-HIGH' THEN 'coupling' WHEN '3-MEDIUM' THEN 'dead_code'
             WHEN '4-NOT SPECIFIED' THEN 'test_gap' ELSE 'unknown' END AS category""",
        """CASE WHEN o_totalprice > 425000 THEN 'critical' WHEN o_totalprice > 350000 THEN 'high'
             WHEN o_totalprice > 250000 THEN 'medium' ELSE 'low' END AS severity""",
        "o_totalprice / 5000 AS score",
    )


_OF = f"of AS (SELECT {_AS_FINDING} FROM orders)"


@query("V1_findings_view", f"""WITH {_OF} SELECT 'all' AS view, run_id, finding_ord, category, severity, score FROM of
    UNION ALL SELECT 'high', run_id, finding_ord, category, severity, score FROM of WHERE severity = 'high'""")
def findings_view(spark, sf_dir):
    found = _order_findings(spark, sf_dir)
    shown = [("all", views.findings_view(found)), ("high", views.findings_view(found, "high"))]
    rows = [v.select(F.lit(n).alias("view"), "run_id", "finding_ord", "category", "severity", "score") for n, v in shown]
    return rows[0].unionByName(rows[1])


@query("V2_severity_counts", f"""WITH {_OF} SELECT run_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high,
    count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM of GROUP BY 1""")
def severity_counts(spark, sf_dir):
    return views.severity_counts(_order_findings(spark, sf_dir))


@query("V3_category_counts", f"""WITH {_OF}, c(category) AS (VALUES ('complexity'), ('coupling'), ('dead_code'), ('test_gap'))
    SELECT r.run_id, c.category, count(of.run_id) AS findings FROM (SELECT DISTINCT run_id FROM of) r CROSS JOIN c
    LEFT JOIN of ON of.run_id = r.run_id AND of.category = c.category GROUP BY 1, 2""")
def category_counts(spark, sf_dir):
    return views.category_counts(_order_findings(spark, sf_dir))


@query("V4_distinct_categories", f"WITH {_OF} SELECT run_id, count(DISTINCT category) AS categories FROM of GROUP BY 1")
def categories(spark, sf_dir):
    return views.distinct_categories(_order_findings(spark, sf_dir))


@query("V5_score_bucket", """
    SELECT c_custkey, CASE WHEN s > 60 THEN 'high' WHEN s >= 40 THEN 'medium' ELSE 'low' END AS panel,
      CASE WHEN s > 70 THEN 'high' WHEN s >= 50 THEN 'medium' ELSE 'low' END AS node,
      CASE WHEN s > 70 THEN 'high' WHEN s > 50 THEN 'elevated' WHEN s >= 30 THEN 'moderate' ELSE 'low' END AS detail
    FROM (SELECT c_custkey, c_acctbal / 100 AS s FROM customer)""")
def buckets(spark, sf_dir):
    score = F.col("c_acctbal") / 100
    return ad.table(spark, sf_dir, "customer").select(
        "c_custkey", *[score_bucket(score, s).alias(s) for s in ("panel", "node", "detail")]
    )


# ---- nodes and evidence -----------------------------------------------------


@query("V6_neighbours", op.with_parts(op.BASE, op.EDGES, select="""
    SELECT DISTINCT run_id, qname AS node_id, other AS neighbour FROM fn JOIN (
      SELECT run_id, source AS qname, target AS other FROM edges UNION ALL SELECT run_id, target, source FROM edges) USING (run_id, qname)
    WHERE pkey IS NOT NULL"""))
def neighbours(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    asked = functions.where("short_name LIKE 'part_%'").selectExpr("run_id", "qname AS node_id")
    return views.neighbours(asked, callgraph.call_edges(functions))


@query("V7_findings_for_node", op.with_parts(*EVIDENCE_PARTS, select="""
    SELECT run_id, w.node_id, finding_id, symbol, score FROM wnodes w JOIN ev USING (run_id, node_id) JOIN findings f USING (run_id)
    WHERE list_contains(string_split(symbols, '|'), symbol) OR symbol = label OR symbol = w.node_id"""))
def node_findings(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    return views.findings_for_node(p.workflow_nodes, p.evidence, p.findings)


@query("V8_symbol_node_index", op.with_parts(*EVIDENCE_PARTS, select="""
    SELECT run_id, symbol, last(node_id ORDER BY node_ord) AS node_id
    FROM (SELECT run_id, node_id, node_ord, unnest(string_split(symbols, '|')) AS symbol FROM wnodes JOIN ev USING (run_id, node_id)) GROUP BY 1, 2"""))
def symbol_index(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    return views.symbol_node_index(p.workflow_nodes, p.evidence)


@query("V9_node_display_name", op.with_parts(*EVIDENCE_PARTS, select="""
    SELECT run_id, w.node_id, CASE WHEN w.node_id = 'risk-hub' OR contains(symbols, 'svc.')
      THEN replace(string_split(string_split(symbols, '|')[1], '.')[-2], '_', ' ') ELSE label END AS display_name
    FROM wnodes w LEFT JOIN ev USING (run_id, node_id)
    UNION ALL SELECT run_id, node_id, label FROM lnodes"""))
def display_names(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    proof = stored(p.evidence)
    process = views.node_display_name(p.workflow_nodes, proof, "process")
    return process.unionByName(views.node_display_name(p.lineage_nodes, proof, "lineage"))


_SENTENCE = """CASE WHEN p_size <= 10 THEN concat('Entity `', p_name, '` seen, entity "other"') WHEN p_size <= 20 THEN concat('the entity  "', p_name, '" added')
  WHEN p_size <= 30 THEN concat('data entity ', initcap(p_name), ' listed') WHEN p_size <= 40 THEN 'entity lower only' ELSE p_name END"""


@query("V10_entity_from_text", """
    SELECT p_partkey, CASE WHEN p_size <= 20 THEN p_name WHEN p_size <= 30 THEN upper(p_name[1]) || string_split(p_name, ' ')[1][2:] END AS entity FROM part""")
def text_entities(spark, sf_dir):
    return ad.table(spark, sf_dir, "part").select("p_partkey", entity_from_text(F.expr(_SENTENCE)).alias("entity"))


@query("V11_crud_from_text", """
    SELECT doc_id, concat_ws('|', CASE WHEN regexp_matches(t, 'create|insert|add') THEN 'Create' END,
      CASE WHEN regexp_matches(t, 'read|fetch|get|list|retrieve|query') THEN 'Read' END,
      CASE WHEN regexp_matches(t, 'update|edit|modify|change') THEN 'Update' END,
      CASE WHEN regexp_matches(t, 'delete|remove|destroy') THEN 'Delete' END) AS ops FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def text_crud(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.array_join(crud_from_text(F.col("text")), "|").alias("ops"))


@query("V12_modules_of_evidence", op.with_parts(*EVIDENCE_PARTS, select="""
    SELECT run_id, node_id, module, (SELECT count(DISTINCT string_split(f, '/')[1]) FROM (SELECT run_id AS r, unnest(string_split(files, '|')) AS f FROM ev) x
        WHERE x.r = m.run_id) AS modules
    FROM (SELECT DISTINCT run_id, node_id, string_split(f, '/')[1] AS module
      FROM (SELECT run_id, node_id, unnest(string_split(files, '|')) AS f FROM ev)) m"""))
def modules(spark, sf_dir):
    proof = stored(ad.products(spark, sf_dir).evidence)
    return views.modules_of_evidence(proof).join(views.module_count(proof), "run_id")


_CAMEL = """concat(replace(initcap(p_name), ' ', ''), CASE WHEN p_size % 3 = 0 THEN 'Create' WHEN p_size % 3 = 1 THEN '_Delete' ELSE '' END,
  CASE WHEN p_size % 2 = 0 THEN 'View' ELSE '' END)"""


@query("V13_humanise_label", """
    WITH w AS (SELECT p_partkey, p_size, upper(a[1]) || a[2:] || ' ' || upper(b[1]) || b[2:] AS words
      FROM (SELECT *, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part))
    SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Create ' WHEN 1 THEN 'Delete ' ELSE '' END || words AS label,
      words || ' XML' AS spaced FROM w""")
def labels(spark, sf_dir):
    return ad.table(spark, sf_dir, "part").select(
        "p_partkey",
        humanise_label(F.expr(_CAMEL)).alias("label"),
        humanise_label(F.expr("concat(initcap(p_name), ' XML')")).alias("spaced"),
    )


# ---- layers -----------------------------------------------------------------

_LAYER_PARTS = """
gn AS (
  SELECT run_id, qname AS node_id, CASE WHEN okey IS NOT NULL THEN okey WHEN pkey IS NOT NULL THEN 1000000000000 + pkey * 2
    ELSE 1000000000000 + string_split(string_split(qname, '.')[2], '_')[2]::BIGINT * 2 + 1 END AS node_ord FROM fn),
ge AS (
  SELECT e.run_id, source, target, t.node_ord AS edge_ord FROM edges e JOIN gn t ON t.run_id = e.run_id AND t.node_id = target),
roots AS (SELECT * FROM gn WHERE (run_id, node_id) NOT IN (SELECT (run_id, target) FROM ge)),
hop1 AS (
  SELECT ge.run_id, target AS node_id, min([r.node_ord, edge_ord]) AS key FROM ge JOIN roots r ON r.run_id = ge.run_id AND r.node_id = source
  GROUP BY 1, 2),
hop2 AS (
  SELECT ge.run_id, target AS node_id, min(list_append(h.key, edge_ord)) AS key FROM ge JOIN hop1 h ON h.run_id = ge.run_id AND h.node_id = source
  WHERE (ge.run_id, target) NOT IN (SELECT (run_id, node_id) FROM hop1) GROUP BY 1, 2),
vis AS (
  SELECT run_id, node_id, 0 AS hops, [node_ord] AS key FROM roots UNION ALL SELECT run_id, node_id, 1, key FROM hop1
  UNION ALL SELECT run_id, node_id, 2, key FROM hop2),
lift AS (
  SELECT DISTINCT ge.run_id, target AS node_id FROM ge JOIN vis s ON s.run_id = ge.run_id AND s.node_id = source
  JOIN vis t ON t.run_id = ge.run_id AND t.node_id = target WHERE s.hops = 1 AND t.hops = 1 AND s.key < t.key AND source <> target),
lay AS (
  SELECT vis.run_id, vis.node_id, hops + (lift.node_id IS NOT NULL)::INT AS layer FROM vis LEFT JOIN lift USING (run_id, node_id))"""


def _call_graph(spark, sf_dir):
    """The whole call graph with an order for its nodes and edges."""
    functions = ad.functions(spark, sf_dir)
    number = F.regexp_extract("qname", r"^[a-z]+\.(?:order|part)_(\d+)", 1).cast("bigint")
    part = F.lit(1_000_000_000_000) + number * 2 + F.when(F.col("fn_ord") == 2, 1).otherwise(0)
    nodes = functions.select(
        "run_id", F.col("qname").alias("node_id"),
        F.when(F.startswith("qname", F.lit("svc.")), number).otherwise(part).alias("node_ord"),
    )
    order = nodes.select("run_id", F.col("node_id").alias("target"), F.col("node_ord").alias("edge_ord"))
    links = callgraph.call_edges(functions).join(order, ["run_id", "target"])
    return stored(nodes), stored(links)


@query("V14_graph_layers", op.with_parts(op.BASE, op.EDGES, _LAYER_PARTS, select="SELECT run_id, node_id, layer FROM lay"))
def graph_layers(spark, sf_dir):
    return layers.graph_layers(*_call_graph(spark, sf_dir)).select("run_id", "node_id", "layer")


@query("V15_layer_order", op.with_parts(op.BASE, op.EDGES, _LAYER_PARTS, select="""
    SELECT run_id, node_id, layer, row_number() OVER (PARTITION BY run_id, layer ORDER BY node_ord) AS position,
      count(*) OVER (PARTITION BY run_id, layer) AS nodes FROM lay JOIN gn USING (run_id, node_id)"""))
def layer_order(spark, sf_dir):
    placed = stored(layers.graph_layers(*_call_graph(spark, sf_dir)))
    return layers.layer_order(placed).join(layers.layer_sizes(placed), ["run_id", "layer"])


@query("V16_in_degree_roots", op.with_parts(op.BASE, op.EDGES, _LAYER_PARTS, select="SELECT run_id, node_id FROM roots"))
def roots(spark, sf_dir):
    return layers.in_degree_roots(*_call_graph(spark, sf_dir)).select("run_id", "node_id")


# ---- enrichment and blueprint displays --------------------------------------


@query("V17_enrichment_pairs", """
    WITH e AS (SELECT o_orderkey AS run_id, o_custkey AS c, o_orderstatus AS s FROM orders)
    SELECT run_id, 'ontology' AS section, unnest(range(8)) AS ord, unnest(['z', 'y', 'a', 'b', 'c', 'd', 'e', 'f']) AS label,
      unnest([c::VARCHAR, '{"n":1}', 'null', 't', 'true', '1.5', '[1,2]', '8']) AS value FROM e WHERE s <> 'P'
    UNION ALL SELECT run_id, 'hint', 0, CASE s WHEN 'F' THEN 'k: v' || c ELSE 'h' || c END, NULL FROM e
    UNION ALL SELECT run_id, 'check', 0, CASE s WHEN 'F' THEN 'lint' ELSE 'named' END, CASE s WHEN 'F' THEN 'true' ELSE 'false' END FROM e
    UNION ALL SELECT run_id, 'check', 1, CASE s WHEN 'F' THEN 'types' ELSE 'Check' END, CASE s WHEN 'F' THEN 'false' ELSE 'true' END FROM e
    UNION ALL SELECT run_id, 'check', 2, 'plain', 'true' FROM e WHERE s <> 'F'""")
def enrichment_pairs(spark, sf_dir):
    table = ad.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id",
        """if(o_orderstatus = 'P', '{}', concat('{"z": ', o_custkey, ', "y": {"n": 1}, "a": null, "b": "t", "c": true, "d": 1.5, "e": [1, 2], "f": 8, "g": 9}'))
           AS ontology_enrichment""",
        """if(o_orderstatus = 'F', concat('{"k": "v', o_custkey, '"}'), concat('["h', o_custkey, '"]')) AS migration_hints""",
        """if(o_orderstatus = 'F', '{"lint": true, "types": 0}', '[{"name": "named", "passed": false}, {"status": "pass"}, "plain"]') AS quality_checks""",
    )
    return views.enrichment_pairs(table).withColumn("ord", F.col("ord").cast("bigint"))


@query("V18_enrichment_state", """
    SELECT o_orderkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'available' WHEN '2-HIGH' THEN 'running' WHEN '3-MEDIUM' THEN 'unavailable'
      WHEN '4-NOT SPECIFIED' THEN 'unavailable' ELSE 'other' END AS state FROM orders""")
def enrichment_state(spark, sf_dir):
    status = F.expr(
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'completed' WHEN '2-HIGH' THEN 'queued' WHEN '3-MEDIUM' THEN 'error'
             WHEN '4-NOT SPECIFIED' THEN cast(null AS string) ELSE 'disabled' END"""
    )
    return ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), views.enrichment_state(status).alias("state"))


@query("V19_blueprint_rows", """
    SELECT o_orderkey AS run_id, 'boundary' AS section, 0 AS ord, 'a' || o_custkey AS title,
      CASE o_orderstatus WHEN 'F' THEN 'X, Y' ELSE 'Z' END AS detail FROM orders
    UNION ALL SELECT o_orderkey, 'routing', 0, CASE o_orderstatus WHEN 'F' THEN 'inbound: ' || o_custkey ELSE 'r' END, NULL FROM orders
    UNION ALL SELECT o_orderkey, 'routing', 1, 'risks: q,r', NULL FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT o_orderkey, 'risk', 0, 't', CASE o_orderstatus WHEN 'F' THEN '' ELSE 'i' END FROM orders""")
def blueprint_rows(spark, sf_dir):
    doc = """concat('{"extraction_boundaries": [{"', CASE o_orderstatus WHEN 'F' THEN 'anchor_symbol' WHEN 'O' THEN 'anchor' ELSE 'symbol' END, '": "a', o_custkey,
        '", "required_entities": ', if(o_orderstatus = 'F', '["X", "Y"]', '"Z"'), '}], "integration_routing": ',
        if(o_orderstatus = 'F', concat('{"inbound": ', o_custkey, ', "risks": ["q", "r"]}'), '["r"]'),
        ', "top_risks": [{"', if(o_orderstatus = 'P', 'risk', 'title'), '": "t"', if(o_orderstatus = 'F', '', ', "impact": "i"'), '}]}')"""
    table = ad.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", f"{doc} AS doc")
    return views.blueprint_rows(table).withColumn("ord", F.col("ord").cast("bigint"))


@query("V20_node_ontology", """
    SELECT o_custkey AS run_id, 'n' || o_orderkey AS node_id, unnest([0, 1]) AS ord, unnest(['k', 'z']) AS key,
      unnest([CASE WHEN o_orderstatus = 'F' THEN 'label' ELSE 'id' END, '7']) AS value
    FROM orders WHERE o_orderstatus <> 'P'""")
def node_ontology(spark, sf_dir):
    orders = ad.table(spark, sf_dir, "orders")
    nodes = orders.selectExpr("o_orderkey AS run_id", "concat('n', o_orderkey) AS node_id", "concat('L', o_orderkey) AS label")
    doc = """CASE o_orderstatus WHEN 'F' THEN concat('{"L', o_orderkey, '": {"k": "label", "z": 7}, "n', o_orderkey, '": {"k": "id", "z": 7}}')
        WHEN 'O' THEN concat('{"n', o_orderkey, '": {"k": "id", "z": 7}}') ELSE '{"other": {"k": 1}}' END"""
    found = views.node_ontology(nodes, orders.selectExpr("o_orderkey AS run_id", f"{doc} AS ontology_enrichment"))
    customer = orders.selectExpr("o_orderkey AS run_id", "o_custkey")
    return found.join(customer, "run_id").selectExpr("o_custkey AS run_id", "node_id", "cast(ord AS bigint) AS ord", "key", "value")


@query("V21_graph_stats", op.with_parts(*_RISK, op.WORKFLOW, op.LINEAGE, select="""
    SELECT run_id, 'workflow' AS graph, count(*) AS nodes, (SELECT count(*) FROM wedges e WHERE e.run_id = wnodes.run_id) AS edges FROM wnodes GROUP BY 1
    UNION ALL SELECT run_id, 'lineage', count(*), (SELECT count(*) FROM ledges e WHERE e.run_id = lnodes.run_id) FROM lnodes GROUP BY 1"""))
def graph_stats(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    tag = lambda df, name: df.select("run_id", F.lit(name).alias("graph"))
    nodes = tag(p.workflow_nodes, "workflow").unionByName(tag(p.lineage_nodes, "lineage"))
    edges = tag(p.workflow_edges, "workflow").unionByName(tag(p.lineage_edges, "lineage"))
    return views.graph_stats(nodes, edges)
