"""Stored results: committed writes, latest row per key wins on read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.sources import commit_log

ARTIFACT_KEYS = ["run_id", "kind", "node_id"]
ARTIFACT_SCHEMA = "run_id string, node_id string, payload string, created_at timestamp, kind string"
ARTIFACT_KINDS = ["workflow", "lineage", "risk", "evidence", "enrichment"]


def as_artifacts(payloads: DataFrame, kind: str) -> DataFrame:
    """Shape (run_id[, node_id], payload) into artifact rows of one kind."""
    if kind not in ARTIFACT_KINDS:
        raise ValueError(f"unknown artifact kind: {kind}")
    node = F.col("node_id") if "node_id" in payloads.columns else F.lit("")
    return payloads.select(
        "run_id",
        F.lit(kind).alias("kind"),
        node.alias("node_id"),
        "payload",
        F.current_timestamp().alias("created_at"),
    )


def write_artifacts(payloads: DataFrame, kind: str, path: str) -> None:
    """Append one kind of artifact as one commit.  A repeated write simply adds newer rows.

    Commits are ordered by the log of the table (see ``commit_log``), the rows of one write
    by their place in it.
    """
    commit_log.append(as_artifacts(payloads, kind), path, partition_by=["kind"])


def stored_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the committed writes, with their ``commit_log.ORDER``."""
    return commit_log.read(spark, path, ARTIFACT_SCHEMA)


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """All stored artifacts, latest per key."""
    return commit_log.latest(stored_artifacts(spark, path), ARTIFACT_KEYS).drop(*commit_log.ORDER)


def compact_artifacts(spark: SparkSession, path: str) -> None:
    """Leave only the latest row of every key in the files; see ``commit_log.vacuum`` for the
    files which are replaced."""
    commit_log.compact(spark, path, ARTIFACT_SCHEMA, ARTIFACT_KEYS, partition_by=["kind"])


def latest_by_key(table: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last written row of every key.

    Only the newest row per key and map task is shuffled (group limit below the
    exchange), so a key written a million times costs no more than one.
    """
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return table.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def lookup_artifacts(keys: DataFrame, artifacts: DataFrame, order: list[str]) -> DataFrame:
    """Latest artifacts for a table of (run_id, kind, node_id) keys; missing keys give no row.

    The semi join comes first, so that only wanted rows are ranked.
    """
    wanted = artifacts.join(keys.select(*ARTIFACT_KEYS).distinct(), ARTIFACT_KEYS, "left_semi")
    return latest_by_key(wanted, ARTIFACT_KEYS, order)


def run_for_repository(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs which belong to the repository they were asked for under."""
    return requests.join(runs, ["repo_id", "run_id"])


def export_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document per run: {run_id, nodes[], edges[]} in their stored order.

    Node and edge tables are capped per run by the operators which make them, so the
    lists are short.
    """
    node_list = nodes.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("node_ord", "node_id", "label", "node_type", "risk_score"))
        ).alias("nodes")
    )
    edge_list = edges.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("edge_ord", "source", "target", "edge_type", "confidence"))
        ).alias("edges")
    )
    doc = F.struct(
        "run_id",
        F.transform(
            "nodes", lambda n: F.struct(n.node_id.alias("id"), n.label, n.node_type, n.risk_score)
        ).alias("nodes"),
        F.transform(
            F.coalesce("edges", F.expr("array()")),
            lambda e: F.struct(e.source, e.target, e.edge_type, e.confidence),
        ).alias("edges"),
    )
    return node_list.join(edge_list, "run_id", "left").select("run_id", F.to_json(doc).alias("payload"))


def export_risk(findings: DataFrame, overall: DataFrame) -> DataFrame:
    """One JSON document per run: {run_id, overall_score, findings[]}."""
    rows = findings.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "finding_ord", "finding_id", "category", "severity", "score",
                    "title", "rationale", "symbol", "suggestions",
                )
            )
        ).alias("rows")
    )
    doc = F.struct(
        "run_id",
        "overall_score",
        F.transform(
            "rows",
            lambda f: F.struct(
                f.finding_id.alias("id"), f.category, f.severity, f.score, f.title, f.rationale,
                f.symbol, f.suggestions.alias("migration_suggestions"),
            ),
        ).alias("findings"),
    )
    return rows.join(overall, "run_id").select("run_id", F.to_json(doc).alias("payload"))


def export_evidence(evidence: DataFrame) -> DataFrame:
    """One JSON document per (run, node)."""
    return evidence.select(
        "run_id",
        "node_id",
        F.to_json(F.struct("run_id", "node_id", "files", "symbols", "explanation")).alias("payload"),
    )
