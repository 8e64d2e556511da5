"""Migration summary: boundaries, modules, readiness, rerouting risks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx
from codeloom.functions.scores import clamped
from codeloom.functions.text import parent_module

# Texts for inbound, outbound and no touch points (fixed values).
_INBOUND = "Inbound touchpoints detected in %d symbols; preserve contracts during cutover."
_OUTBOUND = "Outbound dependencies detected in %d symbols; staged adapter rollout recommended."
_NEITHER = "No explicit integration touchpoints detected; validate dynamically before migration."


def top_findings(findings: DataFrame, k: int) -> DataFrame:
    """Best k findings per run by score, ties in finding order, as ``place``."""
    order = Window.partitionBy("run_id").orderBy(F.col("score").desc(), "finding_ord")
    return findings.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def extraction_boundaries(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """One row per boundary.  Of several functions with one name the last one counts."""
    top = top_findings(findings, lx.BOUNDARIES)
    symbols = top.select("run_id", F.col("symbol").alias("qname")).distinct()
    last = (
        functions.select("run_id", "qname", "file_path", "fn_ord", "entities")
        .join(symbols, ["run_id", "qname"])
        .groupBy("run_id", "qname")
        .agg(F.max_by("entities", F.struct("file_path", "fn_ord")).alias("entities"))
        .withColumnRenamed("qname", "symbol")
    )
    return top.join(last, ["run_id", "symbol"], "left").select(
        "run_id",
        "place",
        F.concat(F.lit("boundary-"), F.col("place").cast("string")).alias("name"),
        F.col("symbol").alias("anchor_symbol"),
        F.col("rationale").alias("reason"),
        F.coalesce(
            F.slice(F.array_sort("entities"), 1, lx.BOUNDARY_ENTITIES), lx.string_array([])
        ).alias("required_entities"),
    )


def impacted_modules(boundaries: DataFrame) -> DataFrame:
    """Sorted distinct parent modules of the boundary symbols (at most three)."""
    return boundaries.groupBy("run_id").agg(
        F.array_sort(F.collect_set(parent_module(F.col("anchor_symbol")))).alias("impacted_modules")
    )


def readiness_score(overall: Column, inbound: Column, outbound: Column) -> Column:
    penalty = F.least(F.lit(25.0), (inbound + outbound) * F.lit(2.5))
    return F.round(clamped(F.lit(100.0) - overall - penalty, 5.0, 95.0), 2)


def rerouting_risks(inbound: Column, outbound: Column) -> Column:
    texts = F.array_compact(
        F.array(
            F.when(inbound > 0, F.format_string(_INBOUND, inbound)),
            F.when(outbound > 0, F.format_string(_OUTBOUND, outbound)),
        )
    )
    return F.when(F.size(texts) == 0, F.array(F.lit(_NEITHER))).otherwise(texts)


def migration_summary(boundaries: DataFrame, overall: DataFrame, exposure: DataFrame) -> DataFrame:
    """One row per run."""
    listed = boundaries.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("place", "name", "anchor_symbol", "reason", "required_entities"))
        ).alias("b"),
        F.array_sort(F.collect_set(parent_module(F.col("anchor_symbol")))).alias("impacted_modules"),
    )
    inbound, outbound = F.col("inbound"), F.col("outbound")
    return overall.join(listed, "run_id").join(exposure, "run_id").select(
        "run_id",
        readiness_score(F.col("overall_score"), inbound, outbound).alias("readiness_score"),
        F.transform(
            "b",
            lambda b: F.struct(b["name"], b["anchor_symbol"], b["reason"], b["required_entities"]),
        ).alias("extraction_boundaries"),
        "impacted_modules",
        rerouting_risks(inbound, outbound).alias("rerouting_risks"),
    )


def run_counters(
    workflow_nodes: DataFrame, lineage_edges: DataFrame, findings: DataFrame
) -> DataFrame:
    """Rows per run of the three products; the risk hub counts as a node."""
    tagged = (
        workflow_nodes.select("run_id", F.lit("n").alias("t"))
        .unionByName(lineage_edges.select("run_id", F.lit("e").alias("t")))
        .unionByName(findings.select("run_id", F.lit("f").alias("t")))
    )
    return tagged.groupBy("run_id").agg(
        F.count_if(F.col("t") == "n").alias("workflow_nodes"),
        F.count_if(F.col("t") == "e").alias("lineage_edges"),
        F.count_if(F.col("t") == "f").alias("risk_findings"),
    )


def fallback_note(setting: str) -> str:
    """Note of a run without source; ``setting`` is the name under which roots are configured."""
    return f"No local repository path resolved. Register repository with local_path or set {setting}."


def run_summary(
    runs: DataFrame, products: DataFrame, counters: DataFrame, ontology: DataFrame, migration: DataFrame, note: str = fallback_note("repository roots")
) -> DataFrame:
    """Summary per runs(run_id, analysis_mode, repo_root); a run without results yet is
    ``queued``.  A scanned run has its ``repo_root``, one without source the ``note``."""
    numbers = [
        "workflow_nodes", "lineage_edges", "risk_findings",
        "files_scanned", "functions_scanned", "parse_errors",
    ]
    joined = (
        runs.select("run_id", "analysis_mode", "repo_root")
        .join(products, "run_id", "left")
        .join(counters.select("run_id", *numbers[3:]), "run_id", "left")
        .join(ontology, "run_id", "left")
        .join(migration, "run_id", "left")
    )
    mode = F.when(F.col("workflow_nodes").isNull(), F.lit("queued")).otherwise(F.col("analysis_mode"))
    done = joined.withColumn("analysis_mode", mode).na.fill(0, numbers)
    is_mode = lambda m: F.col("analysis_mode") == m
    return done.withColumn("repo_root", F.when(is_mode("ast-local"), F.col("repo_root"))).withColumn(
        "note", F.when(is_mode("fallback"), F.lit(note))
    )
