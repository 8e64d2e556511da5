"""The mini repository from directory to every product; most values are recorded outputs, reviewed against the score rules."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators import blueprint, callgraph, migration, tagging
from codeloom.plans.analyze import Products, fallback_products, parse_corpus, products_of
from codeloom.session import stored
from codeloom.sources.artifacts import export_graph, export_risk
from codeloom.sources.files import scan_sources


@pytest.fixture(scope="module")
def corpus(spark, mini_repo):
    files = scan_sources(spark, {"r1": str(mini_repo)})
    facts, functions = parse_corpus(files, keep=stored)
    runs = spark.createDataFrame([("r1", "mini", "ast-local", "/srv/mini")], "run_id string, root_name string, analysis_mode string, repo_root string")
    products = products_of(runs, functions, keep=stored)
    products = Products(**{n: stored(getattr(products, n)) for n in Products.__dataclass_fields__})
    return runs, files, facts, functions, products


def test_functions(corpus):
    rows = {r.qname: r for r in corpus[3].collect()}
    assert set(rows) == {
        "dock.gate.open_gate", "dock.gate.ring", "dock.gate.save_shipment", "stock.shelf.Shelf.load_product",
        "stock.shelf.Shelf.sweep", "tests.test_gate.test_ring",
    }
    gate = rows["dock.gate.open_gate"]
    assert (gate.line_start, gate.line_end, gate.complexity) == (1, 5, 3)
    assert (gate.calls, gate.entity_sequence, gate.crud_ops) == (["ring", "save_shipment"], ["Shipment"] * 2, ["update"])
    load = rows["stock.shelf.Shelf.load_product"]
    assert (load.complexity, load.calls) == (3, ["bay.busy", "bay.turn", "gate.open_gate"])
    assert sorted(rows["stock.shelf.Shelf.sweep"].calls) == ["bay.clear", "drop"]


def test_counters(corpus):
    runs, files, facts, _, _ = corpus
    row = tagging.scan_counters(runs, facts).collect()[0]
    assert (row.files_scanned, row.functions_scanned, row.parse_errors, row.imports) == (5, 6, 1, 2)


def test_edges_and_degrees(corpus):
    edges = callgraph.call_edges(corpus[3])
    found = {(r.source.split(".")[-1], r.target.split(".")[-1]) for r in edges.collect()}
    assert found == {
        ("open_gate", "ring"), ("open_gate", "save_shipment"), ("test_ring", "ring"), ("load_product", "open_gate"),
    }
    degrees = {r.qname.split(".")[-1]: (r.out_degree, r.in_degree) for r in callgraph.degrees(edges).collect()}
    assert degrees["open_gate"] == (2, 1)
    assert degrees["ring"] == (0, 2)


def test_process_graph(corpus):
    p = corpus[4]
    nodes = p.workflow_nodes.orderBy("node_ord").collect()
    # 15, 4 for each step of complexity, 3 for each call that leads to a known function
    assert [(n.node_id, n.risk_score, n.label) for n in nodes] == [
        ("wf-5529480fd0", 33.0, "Open Gate"),
        ("wf-ac58523f08", 30.0, "Load Product"),
        ("wf-1f0719a70f", 19.0, "Save Shipment"),
        ("wf-a55e0e6f13", 23.0, "Sweep"),
        ("wf-70a4eebd06", 22.0, "Test Ring"),
        ("wf-69cd0c33e5", 19.0, "Ring"),
        ("risk-hub", 40.5, "Risk Aggregator"),
    ]
    edges = [(e.edge_type, e.confidence) for e in p.workflow_edges.orderBy("edge_ord").collect()]
    assert edges == [("control", 0.88)] * 4 + [("risk", 0.84)]


def test_lineage_graph(corpus):
    p = corpus[4]
    nodes = [(n.node_id, n.risk_score) for n in p.lineage_nodes.collect()]
    assert nodes == [("entity-shipment", 26.0)]
    assert p.lineage_edges.count() == 0  # a single entity hands nothing over


def test_risk(corpus):
    p = corpus[4]
    rows = [(f.finding_id, f.symbol, f.score, f.severity) for f in p.findings.orderBy("finding_ord").collect()]
    # complexity: 20, 5 for each step, 2 for each known call; coupling: 35 and 7 for each link
    assert rows == [
        ("complexity-1", "dock.gate.open_gate", 39.0, "low"),
        ("complexity-2", "stock.shelf.Shelf.load_product", 37.0, "low"),
        ("complexity-3", "stock.shelf.Shelf.sweep", 30.0, "low"),
        ("coupling-1", "dock.gate.open_gate", 56.0, "medium"),
    ]
    assert p.overall.collect()[0].overall_score == (39 + 37 + 30 + 56) / 4


def test_summaries(corpus):
    runs, files, facts, _, p = corpus
    o = p.ontology.collect()[0]
    assert (o.entities_count, o.inbound, o.outbound) == (1, 0, 0)
    assert [(c.name, c.signal_count) for c in o.capability_clusters] == [("Inventory", 3)]
    m = p.migration.collect()[0]
    assert m.readiness_score == 59.5
    assert [b.required_entities for b in m.extraction_boundaries] == [["Shipment"], ["Shipment"], []]
    assert m.impacted_modules == ["dock.gate", "stock.shelf.Shelf"]
    assert len(m.rerouting_risks) == 1
    counters = tagging.scan_counters(runs, facts)
    products = migration.run_counters(p.workflow_nodes, p.lineage_edges, p.findings)
    s = migration.run_summary(runs, products, counters, p.ontology, p.migration).collect()[0]
    assert (s.workflow_nodes, s.lineage_edges, s.risk_findings, s.files_scanned, s.parse_errors) == (7, 0, 4, 5, 1)
    assert (s.repo_root, s.note) == ("/srv/mini", None)


def test_evidence(corpus):
    rows = {r.node_id: r for r in corpus[4].evidence.collect()}
    assert len(rows) == 8
    assert rows["risk-hub"].files == ["dock.py"]
    assert rows["wf-5529480fd0"].symbols == ["dock.gate.open_gate", "ring", "save_shipment"]
    assert rows["entity-shipment"].files == ["dock/gate.py"]


def test_blueprint_and_exports(spark, corpus):
    p = corpus[4]
    summary = p.migration.join(p.ontology, "run_id").select(
        "run_id",
        F.to_json(
            F.struct(
                F.lit("ast-local").alias("analysis_mode"),
                F.struct(
                    "readiness_score", "extraction_boundaries", "impacted_modules", "rerouting_risks"
                ).alias("migration"),
                F.struct(
                    "top_entities",
                    F.col("inbound").alias("integration_inbound_count"),
                    F.col("outbound").alias("integration_outbound_count"),
                ).alias("ontology"),
            )
        ).alias("summary"),
    )
    none = spark.createDataFrame([], "run_id string, status string, boundary_priority array<string>")
    row = blueprint.migration_blueprint(
        blueprint.blueprint_inputs(summary), p.findings, p.overall, p.lineage_edges, none
    ).collect()[0]
    assert (row.readiness_score, row.readiness_band, row.analysis_mode) == (59.5, "medium", "ast-local")
    assert len(row.recommendations) == 5  # two per kind of finding, one for the missing touchpoints
    assert row.phased_plan[1].actions[0] == (
        "Extract boundary anchor `dock.gate.open_gate` with explicit interface."
    )
    assert row.integration_routing.outbound_touchpoints == 0
    graph = json.loads(export_graph(p.workflow_nodes, p.workflow_edges).collect()[0].payload)
    assert len(graph["nodes"]) == 7 and len(graph["edges"]) == 5
    risk = json.loads(export_risk(p.findings, p.overall).collect()[0].payload)
    assert risk["overall_score"] == 40.5 and len(risk["findings"][0]["migration_suggestions"]) == 2


def test_fallback(spark):
    repos = spark.createDataFrame([("a", "erpnext"), ("b", "odoo"), ("c", "koalixcrm")], "run_id string, name string")
    p = fallback_products(repos)
    scores = {r.run_id: r.score for r in p.findings.collect()}
    assert scores == {"a": 73.06, "b": 65.97, "c": 68.37}
    assert {r.severity for r in p.findings.collect()} == {"high"}
    assert p.workflow_nodes.count() == 12 and p.lineage_edges.count() == 6
    assert p.evidence.where("run_id = 'a'").count() == 7
    ready = {r.run_id: r.readiness_score for r in p.migration.collect()}
    assert ready["a"] == 26.94
