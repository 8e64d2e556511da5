"""Queries: ontology, migration, blueprint, fallback products, the whole analysis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.catalog import adapters as ad
from codeloom.catalog import oracle_parts as op
from codeloom.catalog.graphs_and_risk import EVIDENCE_PARTS, _graph
from codeloom.catalog.registry import query
from codeloom.functions import coerce
from codeloom.functions.scores import hash_score, readiness_band
from codeloom.operators import blueprint, fallback, lineage, migration, ontology, risk, tagging
from codeloom.plans.analyze import analyze, fallback_products
from codeloom.session import stored

_RISK = (op.BASE, op.EDGES, op.RUNS, op.RISK)

EXPOSURE = """
surf AS (
  SELECT run_id, lower(file_path || ' ' || qname || ' ' || short_name) AS s,
    lower(coalesce((SELECT string_agg(call, ' ') FROM calls c WHERE c.run_id = fn.run_id AND c.source = fn.qname AND call_ord < 8), '')) AS cs
  FROM fn),
dom(name, hints) AS (VALUES ('CRM', 'crm|lead|opportunity|customer|contact|prospect'),
  ('Billing', 'invoice|payment|billing|account|ledger|tax'), ('Inventory', 'stock|inventory|warehouse|shipment|procure|purchase'),
  ('Reporting', 'report|dashboard|analytics|kpi|insight|metric')),
sig AS (SELECT run_id, name, count(*) AS signal_count FROM surf JOIN dom ON regexp_matches(s, hints) GROUP BY 1, 2),
clus AS (
  SELECT run_id, name, signal_count, row_number() OVER (PARTITION BY run_id ORDER BY signal_count DESC, name) AS cluster_ord FROM sig
  UNION ALL
  SELECT run_id, 'Core', (SELECT count(*) FROM fn WHERE fn.run_id = runs.run_id), 1 FROM runs WHERE run_id NOT IN (SELECT run_id FROM sig)),
expo AS (
  SELECT runs.run_id,
    count(*) FILTER (regexp_matches(s || ' ' || cs, 'webhook|listener|consumer|ingest|receive|callback|route|endpoint')) AS inbound,
    count(*) FILTER (regexp_matches(s || ' ' || cs, 'publish|emit|send|push|sync|export|request|post|stripe|paypal|queue')) AS outbound
  FROM runs LEFT JOIN surf ON surf.run_id = runs.run_id GROUP BY 1)"""

# Documents of which some mention integration words stand in for functions.
DOC_FUNCTIONS = """
dfn AS (
  SELECT 'run-' || (doc_id % 32) AS run_id, source || '/' || lang || '.py' AS file_path, 1 AS fn_ord,
    'm.' || doc_id AS qname, string_split(text, ' ')[1] AS short_name, string_split(text, ' ')[2:] AS calls FROM documents)"""


def _doc_functions(spark, sf_dir):
    """Documents as functions: their words are the calls."""
    return ad.table(spark, sf_dir, "documents").selectExpr(
        "concat('run-', doc_id % 32) AS run_id",
        "concat(source, '/', lang, '.py') AS file_path",
        "1 AS fn_ord",
        "concat('m.', doc_id) AS qname",
        "split(text, ' ')[0] AS short_name",
        "slice(split(text, ' '), 2, greatest(size(split(text, ' ')) - 1, 0)) AS calls",
    )


# ---- ontology ---------------------------------------------------------------


# Orders as functions of five kinds; every second run has no stock, so its clusters differ.
_KIND = """CASE o_orderpriority WHEN '1-URGENT' THEN 'lead' WHEN '2-HIGH' THEN 'invoice'
  WHEN '3-MEDIUM' THEN CASE o_custkey % 2 WHEN 0 THEN 'stock' ELSE 'plain' END WHEN '4-NOT SPECIFIED' THEN 'kpi_tax' ELSE 'plain' END"""


@query("O1_capability_clusters", op.with_parts(op.RUNS, f"""
    kf AS (SELECT 'run-' || (o_custkey % 32) AS run_id, {_KIND} AS kind FROM orders),
    sg AS (
      SELECT run_id, name, count(*) AS signal_count FROM kf JOIN (VALUES ('lead', 'CRM'), ('invoice', 'Billing'), ('kpi_tax', 'Billing'),
        ('kpi_tax', 'Reporting'), ('stock', 'Inventory')) v(kind, name) USING (kind) GROUP BY 1, 2
      UNION ALL
      SELECT run_id, 'Core', (SELECT count(*) FROM kf WHERE kf.run_id = runs.run_id) FROM runs WHERE run_id NOT IN (
        SELECT run_id FROM kf WHERE kind <> 'plain')),
    rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY signal_count DESC, name) AS cluster_ord FROM sg)""", select="""
    SELECT k, run_id, cluster_ord, name, signal_count FROM rk JOIN (VALUES (2), (4)) v(k) ON cluster_ord <= k"""))
def clusters(spark, sf_dir):
    functions = ad.table(spark, sf_dir, "orders").selectExpr("concat('run-', o_custkey % 32) AS run_id", f"{_KIND} AS short_name").selectExpr(
        "run_id", "'svc/a.py' AS file_path", "concat('svc.a.', short_name) AS qname", "short_name"
    )
    runs = ad.run_table(spark, sf_dir)
    found = [ontology.capability_clusters(runs, functions, k).select(F.lit(k).alias("k"), "*") for k in (2, 4)]
    return found[0].unionByName(found[1]).withColumn("cluster_ord", F.col("cluster_ord").cast("bigint"))


@query("O2_integration_exposure", f"""
    WITH {DOC_FUNCTIONS}, {op.RUNS},
    surf AS (SELECT run_id, lower(file_path || ' ' || qname || ' ' || short_name || ' ' || array_to_string(calls[1:8], ' ')) AS s FROM dfn)
    SELECT runs.run_id,
      count(*) FILTER (regexp_matches(s, 'webhook|listener|consumer|ingest|receive|callback|route|endpoint')) AS inbound,
      count(*) FILTER (regexp_matches(s, 'publish|emit|send|push|sync|export|request|post|stripe|paypal|queue')) AS outbound
    FROM runs LEFT JOIN surf USING (run_id) GROUP BY 1""")
def exposure(spark, sf_dir):
    return ontology.integration_exposure(ad.run_table(spark, sf_dir), _doc_functions(spark, sf_dir))


_ONTOLOGY = (op.BASE, op.RUNS, op.LINEAGE, EXPOSURE)


@query("O3_ontology_summary", op.with_parts(*_ONTOLOGY, select="""
    SELECT run_id, (SELECT count(*) FROM counts c WHERE c.run_id = runs.run_id) AS entities_count,
      coalesce((SELECT string_agg(entity, '|' ORDER BY node_ord) FROM top t WHERE t.run_id = runs.run_id
        AND t.run_id IN (SELECT run_id FROM counts)), '') AS top_entities,
      (SELECT string_agg(name || ':' || signal_count, '|' ORDER BY cluster_ord) FROM clus c WHERE c.run_id = runs.run_id) AS clusters,
      inbound, outbound
    FROM runs JOIN expo USING (run_id)"""))
def ontology_summary(spark, sf_dir):
    runs, functions = ad.run_table(spark, sf_dir), ad.functions(spark, sf_dir)
    summary = ontology.ontology_summary(
        runs,
        stored(lineage.entity_counts(functions)),
        ontology.capability_clusters(runs, functions),
        ontology.integration_exposure(runs, functions),
    )
    cluster = lambda c: F.concat(c["name"], F.lit(":"), c["signal_count"].cast("string"))
    return summary.select(
        "run_id", "entities_count", F.array_join("top_entities", "|").alias("top_entities"),
        F.array_join(F.transform("capability_clusters", cluster), "|").alias("clusters"), "inbound", "outbound",
    )


# ---- migration --------------------------------------------------------------

BOUNDARIES = """
tf AS (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY score DESC, finding_ord) AS place FROM findings),
bound AS (
  SELECT tf.run_id, place, 'boundary-' || place AS name, symbol AS anchor_symbol, rationale AS reason,
    coalesce(array_to_string(ents[1:4], ','), '') AS required_entities
  FROM tf LEFT JOIN fn ON fn.run_id = tf.run_id AND fn.qname = symbol WHERE place <= 3),
mods AS (
  SELECT run_id, array_to_string(list_sort(list_distinct(list(regexp_replace(anchor_symbol, '\\.[^.]*$', '')))), '|') AS impacted_modules
  FROM bound GROUP BY 1)"""


@query("M1_extraction_boundaries", op.with_parts(*_RISK, BOUNDARIES, select="""
    SELECT run_id, name, anchor_symbol, reason, required_entities FROM bound"""))
def boundaries(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    return migration.extraction_boundaries(p.findings, p.functions).select(
        "run_id", "name", "anchor_symbol", "reason", F.array_join("required_entities", ",").alias("required_entities")
    )


@query("M2_impacted_modules", op.with_parts(*_RISK, BOUNDARIES, select="SELECT run_id, impacted_modules FROM mods"))
def impacted(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    found = migration.impacted_modules(migration.extraction_boundaries(p.findings, p.functions))
    return found.select("run_id", F.array_join("impacted_modules", "|").alias("impacted_modules"))


@query("M3_readiness_score", """
    SELECT o_orderkey, round(greatest(5e0, least(95e0, 100e0 - o_totalprice / 5000 - least(25e0, (o_custkey % 7 + o_orderkey % 5) * 2.5e0))), 2)
      AS readiness_score FROM orders""")
def readiness(spark, sf_dir):
    score = migration.readiness_score(F.expr("o_totalprice / 5000"), F.expr("o_custkey % 7"), F.expr("o_orderkey % 5"))
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", score.alias("readiness_score"))


_REROUTE_SQL = """
  CASE WHEN i > 0 THEN 'Inbound touchpoints detected in ' || i || ' symbols; preserve contracts during cutover.' ELSE '' END
  || CASE WHEN i > 0 AND u > 0 THEN '|' ELSE '' END
  || CASE WHEN u > 0 THEN 'Outbound dependencies detected in ' || u || ' symbols; staged adapter rollout recommended.' ELSE '' END
  || CASE WHEN i = 0 AND u = 0 THEN 'No explicit integration touchpoints detected; validate dynamically before migration.' ELSE '' END"""


@query("M4_rerouting_risks", f"""
    SELECT o_orderkey, {_REROUTE_SQL} AS rerouting_risks
    FROM (SELECT o_orderkey, o_custkey % 3 AS i, o_orderkey % 3 AS u FROM orders)""")
def rerouting(spark, sf_dir):
    texts = migration.rerouting_risks(F.expr("o_custkey % 3"), F.expr("o_orderkey % 3"))
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(texts, "|").alias("rerouting_risks"))


MIGRATION = f"""
mig AS (
  SELECT run_id, round(greatest(5e0, least(95e0, 100e0 - overall_score - least(25e0, (inbound + outbound) * 2.5e0))), 2) AS readiness_score,
    impacted_modules, (SELECT {_REROUTE_SQL} FROM (SELECT inbound AS i, outbound AS u)) AS rerouting_risks
  FROM overall JOIN mods USING (run_id) JOIN expo USING (run_id))"""


@query("M5_migration_summary", op.with_parts(*_RISK, BOUNDARIES, EXPOSURE, MIGRATION, select="""
    SELECT run_id, readiness_score, impacted_modules, rerouting_risks,
      (SELECT string_agg(anchor_symbol || '=' || required_entities, '|' ORDER BY place) FROM bound b WHERE b.run_id = mig.run_id) AS boundaries
    FROM mig"""))
def migration_summary(spark, sf_dir):
    boundary = lambda b: F.concat(b["anchor_symbol"], F.lit("="), F.array_join(b["required_entities"], ","))
    return ad.products(spark, sf_dir).migration.select(
        "run_id", "readiness_score",
        F.array_join("impacted_modules", "|").alias("impacted_modules"),
        F.array_join("rerouting_risks", "|").alias("rerouting_risks"),
        F.array_join(F.transform("extraction_boundaries", boundary), "|").alias("boundaries"),
    )


@query("M6_run_summary", op.with_parts(*_RISK, op.WORKFLOW, op.LINEAGE, BOUNDARIES, EXPOSURE, MIGRATION, """
    allruns AS (SELECT run_id, root_name FROM runs UNION ALL SELECT 'new-' || n_nationkey, n_name FROM nation),
    scanned AS (SELECT run_id, count(*) AS n, count(*) FILTER (bad) AS errors FROM (
        SELECT run_id, false AS bad FROM o UNION ALL SELECT run_id, sz = 50 FROM allparts WHERE sz NOT IN (47, 49)) GROUP BY 1)""", select="""
    SELECT r.run_id,
      (SELECT count(*) FROM wnodes x WHERE x.run_id = r.run_id) AS workflow_nodes,
      (SELECT count(*) FROM ledges x WHERE x.run_id = r.run_id) AS lineage_edges,
      (SELECT count(*) FROM findings x WHERE x.run_id = r.run_id) AS risk_findings,
      coalesce(scanned.n, 0) AS files_scanned, (SELECT count(*) FROM fn x WHERE x.run_id = r.run_id) AS functions_scanned,
      coalesce(scanned.errors, 0) AS parse_errors,
      CASE WHEN starts_with(r.run_id, 'new') THEN 'queued' WHEN starts_with(r.run_id, 'run') THEN 'ast-local' ELSE 'fallback' END AS analysis_mode,
      CASE WHEN starts_with(r.run_id, 'run') THEN '/srv/' || root_name END AS repo_root,
      CASE WHEN starts_with(r.run_id, 'empty') THEN
        'No local repository path resolved. Register repository with local_path or set SOURCE_ROOTS.' END AS note,
      inbound, readiness_score
    FROM allruns r LEFT JOIN scanned USING (run_id) LEFT JOIN expo USING (run_id) LEFT JOIN mig USING (run_id)"""))
def run_summary(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    fresh = ad.table(spark, sf_dir, "nation").selectExpr("concat('new-', n_nationkey) AS run_id", "n_name AS root_name")
    runs = ad.run_table(spark, sf_dir).unionByName(fresh).selectExpr(
        "run_id", "if(run_id LIKE 'empty%', 'fallback', 'ast-local') AS analysis_mode", "concat('/srv/', root_name) AS repo_root"
    )
    counted = tagging.scan_counters(runs, ad.record_types(spark, sf_dir))
    made = migration.run_counters(p.workflow_nodes, p.lineage_edges, p.findings)
    note = migration.fallback_note("SOURCE_ROOTS")
    summary = migration.run_summary(runs, made, counted, p.ontology, p.migration, note)
    return summary.select(
        "run_id", "workflow_nodes", "lineage_edges", "risk_findings", "files_scanned", "functions_scanned", "parse_errors",
        "analysis_mode", "repo_root", "note", "inbound", "readiness_score",
    )


# ---- blueprint --------------------------------------------------------------


@query("B1_readiness_band", """
    SELECT o_orderkey, CASE WHEN s >= 70 THEN 'high' WHEN s >= 45 THEN 'medium' ELSE 'low' END AS band
    FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN greatest(0, 100 - o_totalprice / 4000)
      WHEN '4-NOT SPECIFIED' THEN greatest(0, 100 - o_totalprice / 4000) ELSE o_totalprice / 5000 END AS s FROM orders)""")
def bands(spark, sf_dir):
    # Two of five priorities carry no usable score and fall back to 100 - overall.
    doc = F.expr(
        """CASE o_orderpriority WHEN '5-LOW' THEN '{"readiness_score": "n/a"}' WHEN '4-NOT SPECIFIED' THEN '{}'
             WHEN '3-MEDIUM' THEN concat('{"readiness_score": " ', cast(o_totalprice / 5000 AS string), ' "}')
             ELSE concat('{"readiness_score": ', cast(o_totalprice / 5000 AS string), '}') END"""
    )
    default = F.greatest(F.lit(0.0), F.lit(100.0) - F.expr("o_totalprice / 4000"))
    score = coerce.to_float(coerce.parse(doc), "$.readiness_score", default)
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", readiness_band(score).alias("band"))


_BLUEPRINT = (*_RISK, op.LINEAGE, BOUNDARIES, EXPOSURE, MIGRATION)


def _summary_docs(spark, sf_dir, p):
    """Run summaries as the JSON texts which a store would hold."""
    return p.migration.join(p.ontology, "run_id").select(
        "run_id",
        F.to_json(
            F.struct(
                F.lit("ast-local").alias("analysis_mode"),
                F.struct(
                    "readiness_score", "extraction_boundaries", "impacted_modules", "rerouting_risks"
                ).alias("migration"),
                F.struct(
                    "top_entities", F.col("inbound").alias("integration_inbound_count"),
                    F.col("outbound").alias("integration_outbound_count"),
                ).alias("ontology"),
            )
        ).alias("summary"),
    )


@query("B2_integration_routing", op.with_parts(*_BLUEPRINT, select="""
    SELECT run_id, inbound, outbound, (SELECT count(*) FROM ledges e WHERE e.run_id = mig.run_id) AS lineage_edges, rerouting_risks
    FROM mig JOIN expo USING (run_id)"""))
def routing(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    inputs = blueprint.blueprint_inputs(_summary_docs(spark, sf_dir, p))
    r = F.col("integration_routing")
    return blueprint.integration_routing(inputs, p.lineage_edges).select(
        "run_id", r["inbound_touchpoints"].alias("inbound"), r["outbound_touchpoints"].alias("outbound"),
        r["lineage_edges"].alias("lineage_edges"), F.array_join(r["rerouting_risks"], "|").alias("rerouting_risks"),
    )


@query("B3_top_risks", op.with_parts(*_RISK, BOUNDARIES, select="""
    SELECT run_id, place, finding_id, category, severity, score, title, symbol FROM tf WHERE place <= 5"""))
def top_risks(spark, sf_dir):
    findings = risk.risk_findings(ad.run_table(spark, sf_dir), ad.profiles(spark, sf_dir))
    return blueprint.top_risks(findings).withColumn("place", F.col("place").cast("bigint"))


RECOMMEND = """
cat(category, pos, texts) AS (VALUES
  ('complexity', 1, ['Refactor into smaller functions with single responsibility', 'Extract service layer to isolate business logic']),
  ('coupling', 4, ['Introduce interface boundary between modules', 'Apply dependency injection to decouple components']),
  ('dead_code', 5, ['Safe to remove after verifying no runtime references', 'Archive and monitor for regression']),
  ('test_gap', 6, ['Add unit tests for critical business logic paths', 'Prioritize integration tests for high-risk flows'])),
rec AS (
  SELECT run_id, array_to_string(flatten(list(texts ORDER BY pos)), '|') || '|' || any_value(rerouting_risks) AS recommendations
  FROM (SELECT DISTINCT run_id, category FROM findings) JOIN cat USING (category) JOIN mig USING (run_id) GROUP BY 1)"""


@query("B4_recommendations", op.with_parts(*_BLUEPRINT, RECOMMEND, select="SELECT run_id, recommendations FROM rec"))
def recommendations(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    found = blueprint.recommendations(p.findings, p.migration)
    return found.select("run_id", F.array_join("recommendations", "|").alias("recommendations"))


def _blueprints(spark, sf_dir):
    p = ad.products(spark, sf_dir)
    inputs = stored(blueprint.blueprint_inputs(_summary_docs(spark, sf_dir, p)))
    # Runs of one kind of repository have an enrichment with a priority list.
    enrichment = ad.run_table(spark, sf_dir).where("root_name LIKE 'erp%'").selectExpr(
        "run_id", "'completed' AS status", "array('a', 'b', 'c', 'd', 'e') AS boundary_priority"
    )
    return blueprint.migration_blueprint(inputs, p.findings, p.overall, p.lineage_edges, enrichment)


@query("B5_phased_plan", op.with_parts(*_BLUEPRINT, RECOMMEND, select="""
    SELECT mig.run_id, phase_id, CASE phase_id
        WHEN 'phase-1' THEN 'Freeze contracts on inbound and outbound integrations.|Capture baseline metrics and representative regression tests.|Confirm candidate modules and ownership boundaries.'
        WHEN 'phase-2' THEN (SELECT string_agg('Extract boundary anchor `' || anchor_symbol || '` with explicit interface.', '|' ORDER BY place)
            FROM bound b WHERE b.run_id = mig.run_id)
          || CASE WHEN (SELECT root_name FROM runs r WHERE r.run_id = mig.run_id) LIKE 'erp%' THEN '|Follow boundary priority order: a, b, c, d.' ELSE '' END
        ELSE 'Perform staged traffic cutover with rollback guardrails.|Retire deprecated paths after post-cutover validation.|Track residual risks and schedule follow-up refactors.' END AS actions,
      impacted_modules,
      CASE phase_id WHEN 'phase-3' THEN array_to_string(string_split(recommendations, '|')[1:3], '|') ELSE rerouting_risks END AS risk_watch
    FROM mig JOIN rec USING (run_id) CROSS JOIN (VALUES ('phase-1'), ('phase-2'), ('phase-3')) v(phase_id)"""))
def phases(spark, sf_dir):
    plans = _blueprints(spark, sf_dir)
    return plans.select("run_id", F.inline("phased_plan")).select(
        "run_id", "phase_id", F.array_join("actions", "|").alias("actions"),
        F.array_join("impacted_modules", "|").alias("impacted_modules"),
        F.array_join("risk_watch", "|").alias("risk_watch"),
    )


@query("B6_coerce", """
    SELECT o_orderkey,
      CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey WHEN '2-HIGH' THEN o_custkey WHEN '3-MEDIUM' THEN o_custkey ELSE -1 END AS as_int,
      CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey WHEN '2-HIGH' THEN o_custkey + 0.9e0 WHEN '3-MEDIUM' THEN o_custkey
        WHEN '4-NOT SPECIFIED' THEN o_custkey + 0.9e0 ELSE -1 END AS as_float,
      CASE o_orderstatus WHEN 'F' THEN 'a,' || o_custkey || ',b c' ELSE '' END AS as_list,
      CASE o_orderstatus WHEN 'O' THEN 2 ELSE 0 END AS objects
    FROM orders""")
def coerced(spark, sf_dir):
    doc = F.expr(
        """concat('{"n": ', CASE o_orderpriority WHEN '1-URGENT' THEN cast(o_custkey AS string)
               WHEN '2-HIGH' THEN concat(o_custkey, '.9') WHEN '3-MEDIUM' THEN concat('" ', o_custkey, ' "')
               WHEN '4-NOT SPECIFIED' THEN concat('"', o_custkey, '.9"') ELSE 'null' END,
             ', "l": ', CASE o_orderstatus WHEN 'F' THEN concat('[" a", ', o_custkey, ', " ", "b c"]')
               WHEN 'O' THEN '{"x": 1}' ELSE '"text"' END,
             ', "d": ', CASE o_orderstatus WHEN 'O' THEN '[{"x": 1}, 2, {"y": 3}, null]' ELSE '7' END, '}')"""
    )
    docs = ad.table(spark, sf_dir, "orders").select("o_orderkey", coerce.parse(doc).alias("v"))
    v = F.col("v")
    return docs.select(
        "o_orderkey",
        coerce.to_int(v, "$.n", -1).alias("as_int"),
        coerce.to_float(v, "$.n", F.lit(-1.0)).alias("as_float"),
        F.array_join(coerce.to_string_list(v, "$.l"), ",").alias("as_list"),
        F.size(coerce.to_object_list(v, "$.d")).cast("bigint").alias("objects"),
    )


@query("B7_migration_blueprint", op.with_parts(*_BLUEPRINT, RECOMMEND, select="""
    SELECT run_id, readiness_score, CASE WHEN readiness_score >= 70 THEN 'high' WHEN readiness_score >= 45 THEN 'medium' ELSE 'low' END AS readiness_band,
      coalesce((SELECT string_agg(entity, '|' ORDER BY node_ord) FROM top t WHERE t.run_id = mig.run_id
        AND t.run_id IN (SELECT run_id FROM counts)), '') AS entities,
      impacted_modules, recommendations,
      (SELECT string_agg(finding_id, '|' ORDER BY place) FROM tf WHERE tf.run_id = mig.run_id AND place <= 5) AS top_risks,
      CASE WHEN (SELECT root_name FROM runs r WHERE r.run_id = mig.run_id) LIKE 'erp%' THEN 'completed' END AS enrichment_status,
      (SELECT string_agg(anchor_symbol || '=' || required_entities, '|' ORDER BY place) FROM bound b WHERE b.run_id = mig.run_id) AS boundaries,
      (SELECT inbound || '/' || outbound FROM expo WHERE expo.run_id = mig.run_id) || '/'
        || (SELECT count(*) FROM ledges x WHERE x.run_id = mig.run_id) || '/' || rerouting_risks AS routing
    FROM mig JOIN rec USING (run_id)"""))
def blueprints(spark, sf_dir):
    ids = F.transform("top_risks", lambda r: r["finding_id"])
    boundary = lambda b: F.concat(b["anchor_symbol"], F.lit("="), F.array_join(b["required_entities"], ","))
    routing = F.col("integration_routing")
    return _blueprints(spark, sf_dir).select(
        "run_id", "readiness_score", "readiness_band", F.array_join("entities", "|").alias("entities"),
        F.array_join("impacted_modules", "|").alias("impacted_modules"),
        F.array_join("recommendations", "|").alias("recommendations"), F.array_join(ids, "|").alias("top_risks"),
        "enrichment_status", F.array_join(F.transform("extraction_boundaries", boundary), "|").alias("boundaries"),
        F.concat_ws("/", routing["inbound_touchpoints"], routing["outbound_touchpoints"], routing["lineage_edges"],
                    F.array_join(routing["rerouting_risks"], "|")).alias("routing"),
    )


# ---- fallback products ------------------------------------------------------

_REPOS_SQL = """
repos AS (SELECT 'repo-' || s_suppkey AS run_id,
  CASE s_nationkey % 4 WHEN 0 THEN 'ERPnext' WHEN 1 THEN 'koala-crm' WHEN 2 THEN 'enterprise' ELSE 'docs' END || '-' || s_suppkey AS name
  FROM supplier),
core AS (SELECT *, CASE WHEN contains(lower(name), 'erp') THEN 'Order' WHEN contains(lower(name), 'crm') THEN 'Lead' ELSE 'Document' END AS core,
  round(60e0 + 28e0 * (('0x' || substr(sha256(name || '::complexity'), 1, 8))::BIGINT / 4294967295e0), 2) AS score FROM repos)"""


def _repos(spark, sf_dir):
    return ad.table(spark, sf_dir, "supplier").selectExpr(
        "concat('repo-', s_suppkey) AS run_id",
        """concat(CASE s_nationkey % 4 WHEN 0 THEN 'ERPnext' WHEN 1 THEN 'koala-crm' WHEN 2 THEN 'enterprise'
             ELSE 'docs' END, '-', s_suppkey) AS name""",
    )


@query("F1_core_entity", f"WITH {_REPOS_SQL} SELECT run_id, core FROM core")
def core(spark, sf_dir):
    return _repos(spark, sf_dir).select("run_id", fallback.core_entity(F.col("name")).alias("core"))


@query("F2_hash_score", """
    SELECT c_custkey, round(60e0 + 28e0 * (('0x' || substr(sha256(c_name || '::complexity'), 1, 8))::BIGINT / 4294967295e0), 2) AS score FROM customer""")
def hashed(spark, sf_dir):
    score = hash_score([F.col("c_name"), F.lit("complexity")], 60.0, 88.0)
    return ad.table(spark, sf_dir, "customer").select("c_custkey", score.alias("score"))


_F3 = """
    SELECT run_id, 'node' AS part, unnest([1, 2, 3, 4]) AS ord, unnest(['ingest', 'parse', 'workflow', 'risk-hub']) AS a,
      unnest(['Repository Ingestion', 'Python AST Parse', core || ' Workflow Mapper', 'Risk Aggregator']) AS b,
      unnest(['process', 'process', 'process', 'risk']) AS kind, unnest([8e0, 12e0, 24e0, 31e0]) AS score FROM core
    UNION ALL
    SELECT run_id, 'edge', unnest([1, 2, 3]), unnest(['ingest', 'parse', 'workflow']), unnest(['parse', 'workflow', 'risk-hub']),
      unnest(['control', 'control', 'risk']), unnest([0.98e0, 0.92e0, 0.86e0]) FROM core"""

_F4 = """
    SELECT run_id, 'node' AS part, unnest([1, 2, 3]) AS ord, unnest(['entity-customer', 'entity-' || lower(core), 'entity-invoice']) AS a,
      unnest(['Customer', core, 'Invoice']) AS b, unnest(['data', 'data', 'data']) AS kind, unnest([14e0, 22e0, 18e0]) AS score FROM core
    UNION ALL
    SELECT run_id, 'edge', unnest([1, 2]), unnest(['entity-customer', 'entity-' || lower(core)]),
      unnest(['entity-' || lower(core), 'entity-invoice']), unnest(['data', 'data']), unnest([0.93e0, 0.9e0]) FROM core"""


@query("F3_fallback_workflow", f"WITH {_REPOS_SQL} {_F3}")
def fallback_workflow(spark, sf_dir):
    return _graph(*fallback.fallback_workflow(_repos(spark, sf_dir)))


@query("F4_fallback_lineage", f"WITH {_REPOS_SQL} {_F4}")
def fallback_lineage(spark, sf_dir):
    return _graph(*fallback.fallback_lineage(_repos(spark, sf_dir)))


@query("F5_fallback_risk", f"WITH {_REPOS_SQL} SELECT run_id, 'rf-1' AS finding_id, 'high' AS severity, score, name || '.fallback' AS symbol FROM core")
def fallback_risk(spark, sf_dir):
    return fallback.fallback_risk(_repos(spark, sf_dir)).select("run_id", "finding_id", "severity", "score", "symbol")


@query("F6_fallback_ontology", f"""WITH {_REPOS_SQL} SELECT run_id, 3 AS entities_count, 'Customer|' || core || '|Invoice' AS top_entities,
    CASE WHEN contains(lower(name), 'crm') THEN 'CRM' ELSE 'ERP' END || ':2|Core:1' AS clusters FROM core""")
def fallback_ontology(spark, sf_dir):
    cluster = lambda c: F.concat(c["name"], F.lit(":"), c["signal_count"].cast("string"))
    return fallback.fallback_ontology(_repos(spark, sf_dir)).select(
        "run_id", "entities_count", F.array_join("top_entities", "|").alias("top_entities"),
        F.array_join(F.transform("capability_clusters", cluster), "|").alias("clusters"),
    )


@query("F7_fallback_migration", f"""WITH {_REPOS_SQL} SELECT run_id, round(greatest(10e0, least(90e0, 100e0 - score)), 2) AS readiness_score,
    name || '.fallback' AS anchor, 'Customer|' || core || '|Invoice' AS required_entities, name AS impacted_modules FROM core""")
def fallback_migration(spark, sf_dir):
    repos = _repos(spark, sf_dir)
    overall = fallback.fallback_risk(repos).select("run_id", F.col("score").alias("overall_score"))
    first = F.get("extraction_boundaries", F.lit(0))
    return fallback.fallback_migration(repos, overall).select(
        "run_id", "readiness_score", first["anchor_symbol"].alias("anchor"),
        F.array_join(first["required_entities"], "|").alias("required_entities"),
        F.array_join("impacted_modules", "|").alias("impacted_modules"),
    )


@query("E4_fallback_evidence", f"""WITH {_REPOS_SQL}, nodes AS (SELECT run_id, a AS node_id, b AS label FROM ({_F3}) WHERE part = 'node'
      UNION ALL SELECT run_id, a, b FROM ({_F4}) WHERE part = 'node')
    SELECT run_id, node_id, 'n/a' AS files, 'n/a' AS symbols, CASE node_id WHEN 'risk-hub'
      THEN 'Fallback risk evidence. Real scoring requires scanning a local Python repository clone.'
      ELSE 'Fallback evidence for `' || label || '`. Provide local_path on repository registration (or valid git ingestion) for AST-backed evidence.'
      END AS explanation FROM nodes""")
def fallback_evidence(spark, sf_dir):
    return fallback_products(_repos(spark, sf_dir)).evidence.select(
        "run_id", "node_id", F.array_join("files", "|").alias("files"), F.array_join("symbols", "|").alias("symbols"), "explanation"
    )


@query("F8_analyze", op.with_parts(*EVIDENCE_PARTS, EXPOSURE, BOUNDARIES, MIGRATION, _REPOS_SQL, select="""
    SELECT o.run_id, overall_score, (SELECT count(*) FROM findings x WHERE x.run_id = o.run_id) AS findings,
      (SELECT count(*) FROM wnodes x WHERE x.run_id = o.run_id) AS workflow_nodes,
      (SELECT count(*) FROM wedges x WHERE x.run_id = o.run_id) AS workflow_edges,
      (SELECT count(*) FROM lnodes x WHERE x.run_id = o.run_id) AS lineage_nodes,
      (SELECT count(*) FROM ledges x WHERE x.run_id = o.run_id) AS lineage_edges,
      (SELECT count(*) FROM ev x WHERE x.run_id = o.run_id) AS evidence,
      (SELECT string_agg(name || ':' || signal_count, '|' ORDER BY cluster_ord) FROM clus c WHERE c.run_id = o.run_id)
        || '/' || inbound || '/' || outbound AS ontology,
      readiness_score, impacted_modules
    FROM overall o JOIN expo ON expo.run_id = o.run_id JOIN mig ON mig.run_id = o.run_id
    UNION ALL
    SELECT run_id, score, 1, 4, 3, 3, 2, 7, CASE WHEN contains(lower(name), 'crm') THEN 'CRM' ELSE 'ERP' END || ':2|Core:1/0/0',
      round(greatest(10e0, least(90e0, 100e0 - score)), 2), name FROM core"""))
def whole_analysis(spark, sf_dir):
    """All nine products of runs with and without source, and without functions, a row per run."""
    with_source = ad.run_table(spark, sf_dir).selectExpr(
        "run_id", "root_name AS name", "concat('/srv/', root_name) AS source_root"
    )
    resolved = with_source.unionByName(_repos(spark, sf_dir).selectExpr("run_id", "name", "cast(null AS string) AS source_root"))
    p = analyze(resolved, ad.functions(spark, sf_dir), keep=stored)
    tables = ["workflow_nodes", "workflow_edges", "lineage_nodes", "lineage_edges", "findings", "evidence"]
    rows = [getattr(p, name).select("run_id", F.lit(name).alias("t")) for name in tables]
    counted = reduce(DataFrame.unionByName, rows).groupBy("run_id").agg(*[F.count_if(F.col("t") == name).alias(name) for name in tables])
    cluster = lambda c: F.concat(c["name"], F.lit(":"), c["signal_count"].cast("string"))
    found = p.overall.join(counted, "run_id").join(p.ontology, "run_id").join(p.migration, "run_id")
    clusters = F.array_join(F.transform("capability_clusters", cluster), "|")
    return found.select(
        "run_id", "overall_score", *tables, F.concat_ws("/", clusters, "inbound", "outbound").alias("ontology"),
        "readiness_score", F.array_join("impacted_modules", "|").alias("impacted_modules"),
    )
