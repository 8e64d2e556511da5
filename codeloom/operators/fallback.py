"""Products for repositories without source: fixed shapes from the repository name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx
from codeloom.functions.scores import clamped, hash_score
from codeloom.functions.text import slug


def core_entity(name: Column) -> Column:
    lowered = F.lower(name)
    return (
        F.when(F.contains(lowered, F.lit("erp")), F.lit("Order"))
        .when(F.contains(lowered, F.lit("crm")), F.lit("Lead"))
        .otherwise(F.lit("Document"))
    )


def _rows(names: list[str], rows: list[tuple]) -> Column:
    """Literal rows as one inline-able array."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.array(
        *[F.struct(*[as_col(v).alias(n) for n, v in zip(names, row)]) for row in rows]
    )


_NODE = ["node_ord", "node_id", "label", "node_type", "risk_score"]
_EDGE = ["edge_ord", "source", "target", "edge_type", "confidence"]


def fallback_workflow(repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Four nodes and three edges per repos(run_id, name) row."""
    mapper = F.concat(core_entity(F.col("name")), F.lit(" Workflow Mapper"))
    nodes = _rows(
        _NODE,
        [
            (1, "ingest", "Repository Ingestion", "process", 8.0),
            (2, "parse", "Python AST Parse", "process", 12.0),
            (3, "workflow", mapper, "process", 24.0),
            (4, "risk-hub", "Risk Aggregator", "risk", 31.0),
        ],
    )
    edges = _rows(
        _EDGE,
        [
            (1, "ingest", "parse", "control", 0.98),
            (2, "parse", "workflow", "control", 0.92),
            (3, "workflow", "risk-hub", "risk", 0.86),
        ],
    )
    return repos.select("run_id", F.inline(nodes)), repos.select("run_id", F.inline(edges))


def fallback_lineage(repos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three nodes and two edges per repository."""
    core = core_entity(F.col("name"))
    core_id = F.concat(F.lit("entity-"), slug(core))
    nodes = _rows(
        _NODE,
        [
            (1, "entity-customer", "Customer", "data", 14.0),
            (2, core_id, core, "data", 22.0),
            (3, "entity-invoice", "Invoice", "data", 18.0),
        ],
    )
    edges = _rows(
        _EDGE,
        [
            (1, "entity-customer", core_id, "data", 0.93),
            (2, core_id, "entity-invoice", "data", 0.9),
        ],
    )
    return repos.select("run_id", F.inline(nodes)), repos.select("run_id", F.inline(edges))


def fallback_risk(repos: DataFrame) -> DataFrame:
    """One finding per repository.  Its severity is fixed, whatever the score."""
    return repos.select(
        "run_id",
        F.lit(1).alias("finding_ord"),
        F.lit("rf-1").alias("finding_id"),
        F.lit("complexity").alias("category"),
        F.lit("high").alias("severity"),
        hash_score([F.col("name"), F.lit("complexity")], 60.0, 88.0).alias("score"),
        F.lit("Static analysis fallback risk").alias("title"),
        F.lit(
            "Local repository path not available, so risk score is estimated from metadata heuristics."
        ).alias("rationale"),
        F.concat(F.col("name"), F.lit(".fallback")).alias("symbol"),
        lx.string_array(lx.SUGGESTIONS["complexity"]).alias("suggestions"),
    )


def fallback_ontology(repos: DataFrame) -> DataFrame:
    name = F.col("name")
    cluster = F.when(F.contains(F.lower(name), F.lit("crm")), F.lit("CRM")).otherwise(F.lit("ERP"))
    one = lambda label, n: F.struct(
        label.alias("name"), F.lit(n).cast("bigint").alias("signal_count")
    )
    return repos.select(
        "run_id",
        F.lit(3).cast("bigint").alias("entities_count"),
        F.array(F.lit("Customer"), core_entity(name), F.lit("Invoice")).alias("top_entities"),
        F.array(one(cluster, 2), one(F.lit("Core"), 1)).alias("capability_clusters"),
        F.lit(0).cast("bigint").alias("inbound"),
        F.lit(0).cast("bigint").alias("outbound"),
    )


def fallback_migration(repos: DataFrame, overall: DataFrame) -> DataFrame:
    name = F.col("name")
    boundary = F.struct(
        F.lit("boundary-1").alias("name"),
        F.concat(name, F.lit(".fallback")).alias("anchor_symbol"),
        F.lit(
            "Fallback analysis mode; boundary is heuristic until AST mode is available."
        ).alias("reason"),
        F.array(F.lit("Customer"), core_entity(name), F.lit("Invoice")).alias("required_entities"),
    )
    return repos.join(overall, "run_id").select(
        "run_id",
        F.round(clamped(F.lit(100.0) - F.col("overall_score"), 10.0, 90.0), 2).alias("readiness_score"),
        F.array(boundary).alias("extraction_boundaries"),
        F.array(name).alias("impacted_modules"),
        F.array(
            F.lit(
                "Integration topology unavailable in fallback mode; "
                "validate inbound/outbound routes manually."
            )
        ).alias("rerouting_risks"),
    )


def fallback_evidence(workflow_nodes: DataFrame, lineage_nodes: DataFrame) -> DataFrame:
    """One evidence row for each fallback node."""
    plain = F.concat(
        F.lit("Fallback evidence for `"),
        F.col("label"),
        F.lit(
            "`. Provide local_path on repository registration (or valid git ingestion) "
            "for AST-backed evidence."
        ),
    )
    hub = F.lit(
        "Fallback risk evidence. Real scoring requires scanning a local Python repository clone."
    )
    na = F.array(F.lit("n/a"))
    return workflow_nodes.unionByName(lineage_nodes).select(
        "run_id",
        "node_id",
        na.alias("files"),
        na.alias("symbols"),
        F.when(F.col("node_id") == "risk-hub", hub).otherwise(plain).alias("explanation"),
    )
