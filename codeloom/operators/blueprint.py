"""Migration blueprint: one nested row per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import coerce
from codeloom.functions import lexicons as lx
from codeloom.functions.scores import readiness_band
from codeloom.operators.migration import top_findings

# Fixed texts of the three phases: title, objective, actions, success criteria.
PHASES = {
    "phase-1": (
        "Stabilize and Scope",
        "Lock current behavior and scope the extraction surface.",
        [
            "Freeze contracts on inbound and outbound integrations.",
            "Capture baseline metrics and representative regression tests.",
            "Confirm candidate modules and ownership boundaries.",
        ],
        [
            "Baseline test suite and telemetry are green.",
            "Migration scope is approved by owners.",
        ],
    ),
    "phase-2": (
        "Extract and Adapt",
        "Move bounded modules behind adapters and preserve integration contracts.",
        ["Extract first bounded context and introduce adapter layer."],
        [
            "Primary boundary extracted with backward-compatible adapter.",
            "Critical integration paths pass smoke tests.",
        ],
    ),
    "phase-3": (
        "Cutover and Harden",
        "Switch production traffic safely and decommission legacy paths incrementally.",
        [
            "Perform staged traffic cutover with rollback guardrails.",
            "Retire deprecated paths after post-cutover validation.",
            "Track residual risks and schedule follow-up refactors.",
        ],
        [
            "Cutover completed with no high-severity regressions.",
            "Legacy pathways are decommissioned or isolated.",
        ],
    ),
}


def blueprint_inputs(summaries: DataFrame) -> DataFrame:
    """Typed columns from runs(run_id, summary JSON text); wrong types give defaults."""
    parsed = summaries.select("run_id", coerce.parse(F.col("summary")).alias("s"))
    s = F.col("s")
    return parsed.select(
        "run_id",
        F.coalesce(coerce.truthy_text(s, "$.analysis_mode"), F.lit("unknown")).alias("analysis_mode"),
        coerce.to_float(s, "$.migration.readiness_score", F.lit(None).cast("double")).alias("readiness"),
        coerce.to_string_list(s, "$.ontology.top_entities").alias("entities"),
        coerce.to_string_list(s, "$.migration.impacted_modules").alias("impacted_modules"),
        F.transform(
            coerce.to_object_list(s, "$.migration.extraction_boundaries"),
            lambda b: F.struct(
                F.try_variant_get(b, "$.name", "string").alias("name"),
                F.coalesce(
                    F.try_variant_get(b, "$.anchor_symbol", "string"), F.lit("unknown")
                ).alias("anchor_symbol"),
                F.try_variant_get(b, "$.reason", "string").alias("reason"),
                F.try_variant_get(b, "$.required_entities", "array<string>").alias("required_entities"),
            ),
        ).alias("extraction_boundaries"),
        coerce.to_string_list(s, "$.migration.rerouting_risks").alias("rerouting_risks"),
        coerce.to_int(s, "$.ontology.integration_inbound_count", 0).alias("inbound"),
        coerce.to_int(s, "$.ontology.integration_outbound_count", 0).alias("outbound"),
    )


def top_risks(findings: DataFrame, k: int = lx.TOP_RISKS) -> DataFrame:
    """Best five findings per run."""
    return top_findings(findings, k).select(
        "run_id", "place", "finding_id", "category", "severity", "score", "title", "symbol"
    )


def recommendations(findings: DataFrame, rerouting: DataFrame, cap: int = lx.RECOMMENDATIONS) -> DataFrame:
    """Suggestions in finding order, then rerouting risks; first occurrence kept.

    A run has at most six findings, so its list is short.
    """
    listed = findings.groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("finding_ord", F.slice("suggestions", 1, 2).alias("texts")))
        ).alias("s")
    )
    merged = F.concat(F.flatten(F.transform("s", lambda x: x["texts"])), F.col("rerouting_risks"))
    return listed.join(rerouting.select("run_id", "rerouting_risks"), "run_id").select(
        "run_id", F.slice(F.array_distinct(merged), 1, cap).alias("recommendations")
    )


def integration_routing(inputs: DataFrame, lineage_edges: DataFrame) -> DataFrame:
    counted = lineage_edges.groupBy("run_id").agg(F.count("*").alias("n"))
    return inputs.join(counted, "run_id", "left").select(
        "run_id",
        F.struct(
            F.col("inbound").alias("inbound_touchpoints"),
            F.col("outbound").alias("outbound_touchpoints"),
            F.coalesce("n", F.lit(0)).alias("lineage_edges"),
            "rerouting_risks",
        ).alias("integration_routing"),
    )


def phased_plan(
    modules: Column, boundaries: Column, rerouting: Column, advice: Column, priority: Column
) -> Column:
    """Three phases as ARRAY<STRUCT>.  ``priority`` is an ARRAY<STRING>, possibly empty."""
    anchors = F.transform(
        F.slice(boundaries, 1, 3),
        lambda b: F.concat(
            F.lit("Extract boundary anchor `"), b["anchor_symbol"], F.lit("` with explicit interface.")
        ),
    )
    in_order = F.concat(
        F.lit("Follow boundary priority order: "), F.array_join(F.slice(priority, 1, 4), ", "), F.lit(".")
    )
    own = F.when(F.size(priority) > 0, F.concat(anchors, F.array(in_order))).otherwise(anchors)
    extract = F.when(F.size(own) > 0, own).otherwise(lx.string_array(PHASES["phase-2"][2]))
    watch = [F.slice(rerouting, 1, 2), F.slice(rerouting, 1, 3), F.slice(advice, 1, 3)]
    phases = []
    for i, (phase_id, (title, objective, actions, criteria)) in enumerate(PHASES.items()):
        phases.append(
            F.struct(
                F.lit(phase_id).alias("phase_id"),
                F.lit(title).alias("title"),
                F.lit(objective).alias("objective"),
                (extract if phase_id == "phase-2" else lx.string_array(actions)).alias("actions"),
                lx.string_array(criteria).alias("success_criteria"),
                F.slice(modules, 1, lx.PHASE_MODULES[i]).alias("impacted_modules"),
                watch[i].alias("risk_watch"),
            )
        )
    return F.array(*phases)


def migration_blueprint(
    inputs: DataFrame,
    findings: DataFrame,
    overall: DataFrame,
    lineage_edges: DataFrame,
    enrichment: DataFrame,
) -> DataFrame:
    """Blueprint of every run with typed inputs (see ``blueprint_inputs``).

    ``enrichment(run_id, status, boundary_priority ARRAY<STRING>)`` is optional per run.
    """
    risks = top_risks(findings).groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(F.struct("place", "finding_id", "category", "severity", "score", "title", "symbol"))
        ).alias("top_risks")
    )
    joined = (
        inputs.join(overall, "run_id")
        .join(recommendations(findings, inputs), "run_id")
        .join(integration_routing(inputs, lineage_edges), "run_id")
        .join(risks, "run_id")
        .join(enrichment, "run_id", "left")
    )
    score = F.coalesce("readiness", F.greatest(F.lit(0.0), F.lit(100.0) - F.col("overall_score")))
    return joined.select(
        "run_id",
        "analysis_mode",
        F.round(score, 2).alias("readiness_score"),
        readiness_band(score).alias("readiness_band"),
        "entities",
        "impacted_modules",
        "extraction_boundaries",
        "integration_routing",
        "top_risks",
        "recommendations",
        phased_plan(
            F.col("impacted_modules"),
            F.col("extraction_boundaries"),
            F.col("rerouting_risks"),
            F.col("recommendations"),
            F.coalesce("boundary_priority", lx.string_array([])),
        ).alias("phased_plan"),
        F.col("status").alias("enrichment_status"),
    )
