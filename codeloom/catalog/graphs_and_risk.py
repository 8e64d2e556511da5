"""Queries: process graph, lineage graph, risk, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import adapters as ad
from codeloom.catalog import oracle_parts as op
from codeloom.catalog.registry import query
from codeloom.functions.scores import severity
from codeloom.operators import callgraph, evidence, lineage, risk, workflow
from codeloom.operators.risk import attach_suggestions
from codeloom.session import stored

_PROFILES = (op.BASE, op.EDGES)
_RISK = (*_PROFILES, op.RUNS, op.RISK)
_WORKFLOW = (*_RISK, op.WORKFLOW)
_LINEAGE = (op.BASE, op.RUNS, op.LINEAGE)


def _graph(nodes, edges):
    """Nodes and edges of a graph as rows of one table."""
    n = nodes.select(
        "run_id", F.lit("node").alias("part"), F.col("node_ord").cast("bigint").alias("ord"),
        F.col("node_id").alias("a"), F.col("label").alias("b"), F.col("node_type").alias("kind"),
        F.col("risk_score").alias("score"),
    )
    e = edges.select(
        "run_id", F.lit("edge").alias("part"), F.col("edge_ord").cast("bigint").alias("ord"),
        F.col("source").alias("a"), F.col("target").alias("b"), F.col("edge_type").alias("kind"),
        F.col("confidence").alias("score"),
    )
    return n.unionByName(e)


def _graph_sql(nodes, edges):
    return f"""
    SELECT run_id, 'node' AS part, node_ord AS ord, node_id AS a, label AS b, node_type AS kind, risk_score AS score FROM {nodes}
    UNION ALL SELECT run_id, 'edge', edge_ord, source, target, edge_type, confidence FROM {edges}"""


def _edge_rows(edges):
    return edges.select(
        "run_id", F.col("edge_ord").cast("bigint").alias("edge_ord"), "source", "target", "edge_type", "confidence"
    )


# ---- process graph ----------------------------------------------------------


@query("W1_workflow_rank", op.with_parts(*_PROFILES, op.RUNS, op.RISK, op.WORKFLOW, select="""
    SELECT run_id, qname, round(rank, 6) AS rank FROM ranked"""))
def rank(spark, sf_dir):
    profiles = ad.profiles(spark, sf_dir)
    return profiles.select("run_id", "qname", F.round(workflow.workflow_rank(), 6).alias("rank"))


@query("W2_select_workflow", op.with_parts(*_WORKFLOW, select="SELECT run_id, node_ord, qname FROM sel"))
def selected(spark, sf_dir):
    return workflow.select_workflow(ad.profiles(spark, sf_dir)).select(
        "run_id", F.col("node_ord").cast("bigint").alias("node_ord"), "qname"
    )


@query("W3_workflow_nodes", op.with_parts(*_PROFILES, select="""
    SELECT run_id, 'wf-' || substr(sha1(qname), 1, 10) AS node_id, title AS label,
      CASE WHEN least(95, 15 + complexity * 4 + out_degree * 3) >= 75 THEN 'risk' ELSE 'process' END AS node_type,
      least(95e0, 15 + complexity * 4 + out_degree * 3) AS risk_score FROM prof"""))
def nodes(spark, sf_dir):
    # Every function as a node, not only the selected ones.
    return workflow.workflow_nodes(ad.profiles(spark, sf_dir).withColumn("node_ord", F.col("fn_ord"))).drop("node_ord")


# The eight best functions of a run are all order functions, which call parts only; a
# selection of all functions has edges inside it.
@query("W4_workflow_edges", op.with_parts(*_RISK, op.WORKFLOW.replace("node_ord <= 8", "node_ord >= 1"), select="""
    SELECT run_id, edge_ord, source, target, edge_type, confidence FROM ctl"""))
def edges(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    links = stored(callgraph.call_edges(functions))
    chosen = workflow.select_workflow(callgraph.with_degrees(functions, links), k=None)
    return _edge_rows(workflow.workflow_edges(stored(chosen), links, k=None))


@query("W5_workflow_chain_edges", op.with_parts(*_WORKFLOW, select="""
    SELECT run_id, edge_ord, source, target, edge_type, confidence FROM chain"""))
def chain(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    links = stored(callgraph.call_edges(functions))
    chosen = stored(workflow.select_workflow(callgraph.with_degrees(functions, links)))
    return _edge_rows(
        workflow.workflow_chain_edges(workflow.workflow_nodes(chosen), workflow.workflow_edges(chosen, links))
    )


@query("W6_append_risk_hub", op.with_parts(*_WORKFLOW, select="""
    SELECT w.run_id, risk_score, source, edge_ord FROM wnodes w JOIN hubedge h USING (run_id) WHERE node_id = 'risk-hub'"""))
def hub(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    node = p.workflow_nodes.where("node_id = 'risk-hub'").select("run_id", "risk_score")
    edge = p.workflow_edges.where("target = 'risk-hub'").select(
        "run_id", "source", F.col("edge_ord").cast("bigint").alias("edge_ord")
    )
    return node.join(edge, "run_id")


# In the runs which are named after a nation, three functions call each other and rank first,
# so their graphs have call edges; the other runs have none and are chained.
_HUB_ROWS = """
fn AS (
  SELECT * FROM order_fn UNION ALL
  SELECT 'run-' || n_nationkey, 'core/' || w || '_' || n_nationkey || '.py', 1, 'core.' || w || '_' || n_nationkey || '.' || w || '_' || n_nationkey,
    w || '_' || n_nationkey, upper(w[1]) || w[2:] || ' ' || n_nationkey, 1, 90, c, k, [], [], NULL, NULL
  FROM nation CROSS JOIN (VALUES ('hub', 90, 3), ('spoke', 80, 1), ('rim', 70, 0)) v(w, c, k)),
lcalls AS ("""
_HUB_EDGES = """
edges AS (
  SELECT * FROM order_edges UNION ALL
  SELECT 'run-' || n_nationkey, 'core.' || a || '_' || n_nationkey || '.' || a || '_' || n_nationkey, 'core.' || b || '_' || n_nationkey || '.' || b || '_' || n_nationkey
  FROM nation CROSS JOIN (VALUES ('hub', 'spoke'), ('hub', 'rim'), ('hub', 'hub'), ('spoke', 'rim')) v(a, b)),
deg AS ("""
_HUB_PARTS = (
    op.BASE.replace("\nfn AS (", "\norder_fn AS (").replace("\nlcalls AS (", _HUB_ROWS),
    op.EDGES.replace("\nedges AS (", "\norder_edges AS (").replace("\ndeg AS (", _HUB_EDGES),
    op.RUNS, op.RISK, op.WORKFLOW,
)


def _hub_functions(spark, sf_dir):
    """hub calls spoke by its name, rim by its short name, and itself; spoke calls rim."""
    nations = ad.table(spark, sf_dir, "nation").selectExpr(
        "cast(n_nationkey AS string) AS n",
        "inline(array(named_struct('w', 'hub', 'c', 90), named_struct('w', 'spoke', 'c', 80), named_struct('w', 'rim', 'c', 70)))",
    )
    calls = """CASE w WHEN 'hub' THEN array(concat('core.spoke_', n, '.spoke_', n), concat('x.rim_', n), concat('hub_', n))
      WHEN 'spoke' THEN array(concat('rim_', n)) ELSE cast(array() AS array<string>) END"""
    return nations.selectExpr(
        "concat('run-', n) AS run_id", "concat('core/', w, '_', n, '.py') AS file_path", "1 AS fn_ord",
        "concat('core.', w, '_', n, '.', w, '_', n) AS qname", "concat(w, '_', n) AS short_name", "1 AS line_start", "90 AS line_end",
        "c AS complexity", f"{calls} AS calls", "cast(array() AS array<string>) AS entity_sequence",
        "cast(array() AS array<string>) AS crud_ops", "cast(array() AS array<string>) AS entities",
    )


@query("W7_workflow_graph", op.with_parts(*_HUB_PARTS, select=_graph_sql("wnodes", "wedges")))
def workflow_graph(spark, sf_dir):
    functions = stored(ad.function_table(spark, sf_dir).unionByName(_hub_functions(spark, sf_dir)))
    p = ad.Analysis(ad.run_table(spark, sf_dir), functions, keep=stored)
    return _graph(p.workflow_nodes, p.workflow_edges)


# ---- lineage graph ----------------------------------------------------------


@query("L1_entity_counts", op.with_parts(*_LINEAGE, select="SELECT run_id, entity, functions FROM counts"))
def entity_counts(spark, sf_dir):
    return lineage.entity_counts(ad.function_table(spark, sf_dir))


@query("L2_top_entities", op.with_parts(*_LINEAGE, select="""
    SELECT run_id, entity, functions, node_ord FROM top WHERE run_id IN (SELECT run_id FROM counts)"""))
def top(spark, sf_dir):
    counts = lineage.entity_counts(ad.function_table(spark, sf_dir))
    return lineage.top_entities(counts).withColumn("node_ord", F.col("node_ord").cast("bigint"))


@query("L3_default_entities", op.with_parts(*_LINEAGE, select="SELECT run_id, entity, functions::BIGINT AS functions FROM defaults"))
def defaults(spark, sf_dir):
    counts = lineage.entity_counts(ad.function_table(spark, sf_dir))
    return lineage.default_entities(ad.run_table(spark, sf_dir), counts)


@query("L4_lineage_nodes", op.with_parts(*_LINEAGE, select="SELECT run_id, node_ord, node_id, label, node_type, risk_score FROM lnodes"))
def lineage_nodes(spark, sf_dir):
    chosen = lineage.lineage_top(ad.run_table(spark, sf_dir), ad.functions(spark, sf_dir))
    return lineage.lineage_nodes(chosen).withColumn("node_ord", F.col("node_ord").cast("bigint"))


@query("L5_entity_functions", op.with_parts(*_LINEAGE, select="""
    SELECT run_id, entity, file_path, fn_ord, qname FROM (SELECT run_id, file_path, fn_ord, qname, unnest(ents) AS entity FROM fn)
    WHERE (run_id, entity) IN (SELECT (run_id, entity) FROM top)"""))
def of_entities(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    chosen = lineage.lineage_top(ad.run_table(spark, sf_dir), functions)
    return lineage.entity_functions(functions, chosen).select("run_id", "entity", "file_path", "fn_ord", "qname")


@query("L6_entity_transitions", op.with_parts(*_LINEAGE, select="SELECT run_id, source, target, weight FROM tw"))
def transitions(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    chosen = lineage.lineage_top(ad.run_table(spark, sf_dir), functions)
    return lineage.entity_transitions(functions, chosen)


@query("L7_lineage_edges", op.with_parts(*_LINEAGE, select="""
    SELECT run_id, edge_ord, source, target, edge_type, confidence FROM ldata"""))
def data_edges(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    chosen = lineage.lineage_top(ad.run_table(spark, sf_dir), functions)
    return _edge_rows(lineage.lineage_edges(lineage.entity_transitions(functions, chosen)))


@query("L8_lineage_chain_edges", op.with_parts(*_LINEAGE, select="""
    SELECT run_id, edge_ord, source, target, edge_type, confidence FROM lchain"""))
def data_chain(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    chosen = stored(lineage.lineage_top(ad.run_table(spark, sf_dir), functions))
    links = lineage.lineage_edges(lineage.entity_transitions(functions, chosen))
    return _edge_rows(lineage.lineage_chain_edges(lineage.lineage_nodes(chosen), links))


@query("L9_lineage_graph", op.with_parts(*_LINEAGE, select=_graph_sql("lnodes", "ledges")))
def lineage_graph(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    p = ad.Analysis(ad.run_table(spark, sf_dir), functions, keep=stored)
    return _graph(p.lineage_nodes, p.lineage_edges)


# ---- risk -------------------------------------------------------------------


@query("R1_severity", """
    SELECT c_custkey, CASE WHEN c_acctbal / 100 >= 85 THEN 'critical' WHEN c_acctbal / 100 >= 70 THEN 'high'
      WHEN c_acctbal / 100 >= 50 THEN 'medium' ELSE 'low' END AS severity FROM customer""")
def severities(spark, sf_dir):
    return ad.table(spark, sf_dir, "customer").select("c_custkey", severity(F.col("c_acctbal") / 100).alias("severity"))


_FINDING = "run_id, finding_ord, finding_id, category, severity, score, title, rationale, symbol"


def _finding_rows(findings):
    return findings.withColumn("finding_ord", F.col("finding_ord").cast("bigint")).select(*_FINDING.split(", "))


def _finding_sql(where):
    return op.with_parts(*_RISK, select=f"SELECT {_FINDING} FROM findings WHERE {where}")


@query("R2_complexity_findings", _finding_sql("category = 'complexity' AND symbol <> 'n/a'"))
def complexity_findings(spark, sf_dir):
    return _finding_rows(risk.complexity_findings(ad.profiles(spark, sf_dir)))


@query("R3_coupling_finding", _finding_sql("category = 'coupling'"))
def coupling(spark, sf_dir):
    return _finding_rows(risk.coupling_finding(risk.run_extremes(ad.profiles(spark, sf_dir))))


@query("R4_dead_code_finding", _finding_sql("category = 'dead_code'"))
def dead_code(spark, sf_dir):
    return _finding_rows(risk.dead_code_finding(risk.run_extremes(ad.profiles(spark, sf_dir))))


@query("R5_dead_code_candidates", op.with_parts(*_RISK, select="SELECT run_id, file_path, qname, complexity FROM dc"))
def dead_candidates(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    return risk.dead_code_candidates(functions, callgraph.call_edges(functions)).select(
        "run_id", "file_path", "qname", F.col("complexity").cast("bigint").alias("complexity")
    )


@query("R6_test_gap_finding", _finding_sql("category = 'test_gap'"))
def test_gap(spark, sf_dir):
    return _finding_rows(risk.test_gap_finding(risk.run_extremes(ad.profiles(spark, sf_dir))))


@query("R7_empty_risk_finding", _finding_sql("symbol = 'n/a'"))
def empty_finding(spark, sf_dir):
    return _finding_rows(
        risk.empty_risk_finding(ad.run_table(spark, sf_dir), ad.function_table(spark, sf_dir))
    )


@query("R8_attach_suggestions", op.with_parts(*_RISK, select="""
    SELECT run_id, finding_id, CASE category
      WHEN 'complexity' THEN 'Refactor into smaller functions with single responsibility|Extract service layer to isolate business logic'
      WHEN 'coupling' THEN 'Introduce interface boundary between modules|Apply dependency injection to decouple components'
      WHEN 'dead_code' THEN 'Safe to remove after verifying no runtime references|Archive and monitor for regression'
      ELSE 'Add unit tests for critical business logic paths|Prioritize integration tests for high-risk flows' END AS suggestions
    FROM findings"""))
def suggestions(spark, sf_dir):
    findings = risk.risk_findings(ad.run_table(spark, sf_dir), ad.profiles(spark, sf_dir))
    return findings.select(
        "run_id", "finding_id", F.array_join(attach_suggestions(F.col("category")), "|").alias("suggestions")
    )


@query("R9_risk_findings", _finding_sql("true"))
def risk_findings(spark, sf_dir):
    return _finding_rows(risk.risk_findings(ad.run_table(spark, sf_dir), ad.profiles(spark, sf_dir)))


@query("R10_overall_risk", op.with_parts(*_RISK, select="SELECT run_id, overall_score FROM overall"))
def overall(spark, sf_dir):
    return risk.overall_risk(risk.risk_findings(ad.run_table(spark, sf_dir), ad.profiles(spark, sf_dir)))


# ---- evidence ---------------------------------------------------------------


def _evidence_rows(rows):
    return rows.select(
        "run_id", "node_id", F.array_join("files", "|").alias("files"),
        F.array_join("symbols", "|").alias("symbols"), "explanation",
    )


WORKFLOW_EVIDENCE = """
wev AS (
  SELECT run_id, 'wf-' || substr(sha1(qname), 1, 10) AS node_id, file_path AS files,
    array_to_string([qname] || coalesce((SELECT list(call ORDER BY call_ord) FROM calls c
      WHERE c.run_id = sel.run_id AND c.source = sel.qname AND call_ord < 2), []), '|') AS symbols,
    'Workflow node extracted from function `' || qname || '` with complexity ' || complexity || ' and ' || n_calls
      || ' detected calls.' AS explanation
  FROM sel)"""

ENTITY_EVIDENCE = """
ef AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, entity ORDER BY file_path, fn_ord) AS place
  FROM (SELECT run_id, file_path, fn_ord, qname, crud, unnest(ents) AS entity FROM fn)
  WHERE (run_id, entity) IN (SELECT (run_id, entity) FROM top)),
eev AS (
  SELECT run_id, 'entity-' || lower(entity) AS node_id,
    array_to_string(list_sort(list_distinct(list(file_path))), '|') AS files,
    array_to_string(list(qname ORDER BY place) FILTER (place <= 3), '|') AS symbols,
    'Entity `' || entity || '` inferred from symbols that include entity tokens and CRUD operations ('
      || coalesce(nullif(any_value(array_to_string(crud, ', ')) FILTER (place = 1), ''), 'no explicit CRUD token') || ').' AS explanation
  FROM ef WHERE place <= 5 GROUP BY run_id, entity)"""

HUB_EVIDENCE = """
hev AS (
  SELECT run_id, 'risk-hub' AS node_id,
    CASE WHEN contains(first(symbol ORDER BY score DESC, finding_ord), '.')
      THEN string_split(first(symbol ORDER BY score DESC, finding_ord), '.')[1] || '.py' ELSE 'unknown.py' END AS files,
    array_to_string((list(symbol ORDER BY finding_ord))[1:3], '|') AS symbols,
    'Risk hub combines complexity, coupling, dead-code and test-gap signals from static analysis.' AS explanation
  FROM findings GROUP BY 1)"""


@query("E1_workflow_evidence", op.with_parts(*_WORKFLOW, WORKFLOW_EVIDENCE, select="SELECT * FROM wev"))
def workflow_evidence(spark, sf_dir):
    return _evidence_rows(evidence.workflow_evidence(workflow.select_workflow(ad.profiles(spark, sf_dir))))


@query("E2_entity_evidence", op.with_parts(*_LINEAGE, ENTITY_EVIDENCE, select="SELECT * FROM eev"))
def entity_evidence(spark, sf_dir):
    functions = ad.functions(spark, sf_dir)
    chosen = lineage.lineage_top(ad.run_table(spark, sf_dir), functions)
    return _evidence_rows(evidence.entity_evidence(functions, chosen))


@query("E3_risk_hub_evidence", op.with_parts(*_RISK, HUB_EVIDENCE, select="SELECT * FROM hev"))
def hub_evidence(spark, sf_dir):
    findings = risk.risk_findings(ad.run_table(spark, sf_dir), ad.profiles(spark, sf_dir))
    return _evidence_rows(evidence.risk_hub_evidence(findings))


ALL_EVIDENCE = "ev AS (SELECT * FROM wev UNION ALL SELECT * FROM eev UNION ALL SELECT * FROM hev)"
EVIDENCE_PARTS = (*_WORKFLOW, op.LINEAGE, WORKFLOW_EVIDENCE, ENTITY_EVIDENCE, HUB_EVIDENCE, ALL_EVIDENCE)


@query("E5_evidence_for", op.with_parts(*EVIDENCE_PARTS, """
    req AS (SELECT o_orderkey AS request_id,
        CASE o_orderstatus WHEN 'P' THEN 'gone-' ELSE 'run-' END || (o_custkey % 32) AS run_id,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'risk-hub' WHEN '2-HIGH' THEN 'entity-order' WHEN '3-MEDIUM' THEN 'entity-lead'
          ELSE 'none' END AS node_id FROM orders)""", select="""
    SELECT request_id, run_id, node_id, symbols,
      CASE WHEN starts_with(run_id, 'gone') THEN 'RUN_NOT_FOUND' WHEN explanation IS NULL THEN 'EVIDENCE_NOT_FOUND' ELSE 'OK' END AS outcome
    FROM req LEFT JOIN ev USING (run_id, node_id)"""))
def evidence_for(spark, sf_dir):
    requests = ad.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS request_id",
        "concat(if(o_orderstatus = 'P', 'gone-', 'run-'), o_custkey % 32) AS run_id",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'risk-hub' WHEN '2-HIGH' THEN 'entity-order'
             WHEN '3-MEDIUM' THEN 'entity-lead' ELSE 'none' END AS node_id""",
    )
    p = ad.products(spark, sf_dir)
    found = evidence.evidence_for(requests, ad.run_table(spark, sf_dir), p.evidence)
    return found.select("request_id", "run_id", "node_id", F.array_join("symbols", "|").alias("symbols"), "outcome")
