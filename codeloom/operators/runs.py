"""Run state: progress ticks, steps, summaries, polls and readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import coerce
from codeloom.functions import lexicons as lx
from codeloom.functions.scores import clamped

TERMINAL = ["completed", "failed"]


def run_state_aggregates() -> list[Column]:
    """Aggregates over ticks(run_id, seq, ts, step, status, pct, error) for the latest state."""
    last = F.max_by(F.struct("status", "step", "pct", "error"), "seq")
    return [
        last.alias("last"),
        F.min("ts").alias("started_at"),
        F.max(F.when(F.col("status").isin(TERMINAL), F.col("ts"))).alias("finished_at"),
    ]


def run_state_columns() -> list[Column]:
    return [
        F.col("run_id"),
        F.col("last.status").alias("status"),
        F.col("last.step").alias("current_step"),
        clamped(F.col("last.pct"), 0.0, 100.0).alias("progress_pct"),
        F.col("last.error").alias("error_message"),
        F.col("started_at"),
        F.col("finished_at"),
    ]


def latest_run_state(ticks: DataFrame) -> DataFrame:
    """Last tick per run; the first tick starts the run, the last terminal one ends it."""
    return ticks.groupBy("run_id").agg(*run_state_aggregates()).select(*run_state_columns())


def step_progress(step: Column) -> Column:
    """Percent of a pipeline step; null for an unknown one."""
    pairs = [F.lit(v) for pair in lx.STEP_PROGRESS for v in pair]
    return F.create_map(*pairs)[step]


def step_status_matrix(runs: DataFrame) -> DataFrame:
    """pending / active / completed for every run and each of the five shown steps."""
    shown = lx.string_array(lx.SHOWN_STEPS)
    at = F.array_position(shown, F.col("current_step")) - 1
    known = (
        F.when(F.col("step_no") < at, F.lit("completed"))
        .when(F.col("step_no") == at, F.lit("active"))
        .otherwise(F.lit("pending"))
    )
    resolving = F.when(F.col("step_no") == 0, F.lit("active")).otherwise(F.lit("pending"))
    fallback = (
        F.when(F.col("step_no") <= 1, F.lit("completed"))
        .when(F.col("step_no") == 2, F.lit("active"))
        .otherwise(F.lit("pending"))
    )
    state = (
        F.when(F.col("status") == "completed", F.lit("completed"))
        .when(at >= 0, known)
        .when(F.col("current_step") == "resolving-source", resolving)
        .when(F.col("current_step") == "fallback-analysis", fallback)
        .otherwise(F.lit("pending"))
    )
    return runs.select(
        "run_id", "status", "current_step", F.posexplode(shown).alias("step_no", "step")
    ).select("run_id", "step_no", "step", state.alias("state"))


def merge_summary(base: Column, patch: Column) -> Column:
    """Map merge in which the patch wins, with null values too."""
    rest = F.map_filter(base, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(rest, patch)


def poll_fold(polls: DataFrame, max_attempts: int = 8) -> DataFrame:
    """Outcome of polls(request_id, attempt, status): first terminal one within the limit.

    No terminal answer means ``running`` after ``max_attempts``.
    """
    ends = F.col("status").isin(TERMINAL) & (F.col("attempt") <= max_attempts)
    order = F.when(ends, F.struct("attempt", "status"))
    folded = polls.groupBy("request_id").agg(F.min(order).alias("end"))
    return folded.select(
        "request_id",
        F.coalesce("end.status", F.lit("running")).alias("status"),
        F.coalesce("end.attempt", F.lit(max_attempts)).cast("int").alias("poll_attempts"),
    )


def hook_outcome(hooks: DataFrame) -> DataFrame:
    """Status of hooks(enabled, configured, run_found, error, trigger_status, request_id,
    poll_status, poll_attempts) by precedence."""
    polled = F.col("request_id").isNotNull() & F.col("trigger_status").isin("queued", "running")
    status = (
        F.when(~F.col("enabled"), F.lit("disabled"))
        .when(~F.col("configured"), F.lit("not_configured"))
        .when(~F.col("run_found"), F.lit("skipped"))
        .when(F.col("error").isNotNull(), F.lit("error"))
        .when(polled, F.coalesce("poll_status", F.lit("running")))
        .otherwise(F.col("trigger_status"))
    )
    attempts = F.when(polled & F.col("error").isNull(), F.coalesce("poll_attempts", F.lit(0))).otherwise(0)
    skipped = F.when(status == "skipped", F.lit("run_not_found"))
    error = F.when(status == "error", F.col("error")).otherwise(skipped)
    active = F.col("enabled") & F.col("configured") & F.col("run_found")
    return hooks.select(
        "run_id",
        status.alias("status"),
        F.when(active, attempts).otherwise(0).alias("poll_attempts"),
        error.alias("error"),
    )


def normalise_counters(runs: DataFrame) -> DataFrame:
    """Typed counters of runs(run_id, summary JSON text), with defaults."""
    v = F.col("v")
    names = [
        "workflow_nodes", "lineage_edges", "risk_findings",
        "files_scanned", "functions_scanned", "parse_errors",
    ]
    return runs.select("run_id", coerce.parse(F.col("summary")).alias("v")).select(
        "run_id",
        F.coalesce(coerce.truthy_text(v, "$.analysis_mode"), F.lit("fallback")).alias("analysis_mode"),
        *[coerce.to_int(v, f"$.{n}", 0).alias(n) for n in names],
        coerce.to_object_json(v, "$.ontology").alias("ontology"),
        coerce.to_object_json(v, "$.migration").alias("migration"),
    )


def artifact_readiness(requests: DataFrame, runs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Outcome per requests(request_id, run_id, purpose): can it be answered?

    ``purpose`` is ``answer`` or ``blueprint``; ``artifacts(run_id, kind, size)`` gives
    the number of graph nodes for the workflow kind.
    """
    is_kind = lambda k: F.col("kind") == k
    flags = artifacts.groupBy("run_id").agg(
        F.bool_or(is_kind("workflow")).alias("workflow"),
        F.bool_or(is_kind("lineage")).alias("lineage"),
        F.bool_or(is_kind("risk")).alias("risk"),
        F.max(F.when(is_kind("workflow"), F.col("size"))).alias("nodes"),
    )
    known = runs.select("run_id", F.lit(True).alias("known")).distinct()
    joined = requests.join(known, "run_id", "left").join(flags, "run_id", "left")
    has = lambda name: F.coalesce(name, F.lit(False))
    answer = (
        F.when(~(has("risk") & has("workflow")), F.lit("SEMANTIC_ARTIFACTS_NOT_READY"))
        .when(F.coalesce("nodes", F.lit(0)) == 0, F.lit("EMPTY_WORKFLOW_GRAPH"))
        .otherwise(F.lit("OK"))
    )
    blueprint = F.when(
        ~(has("risk") & has("lineage")), F.lit("MIGRATION_ARTIFACTS_NOT_READY")
    ).otherwise(F.lit("OK"))
    outcome = (
        F.when(F.col("known").isNull(), F.lit("RUN_NOT_FOUND"))
        .when(F.col("purpose") == "answer", answer)
        .otherwise(blueprint)
    )
    return joined.select("request_id", "run_id", "purpose", outcome.alias("outcome"))


def comparison_outcome(requests: DataFrame, runs: DataFrame, results: DataFrame, provider: str, configured: bool = True) -> DataFrame:
    """Outcome of web comparisons requests(request_id, run_id): status code, detail and message.

    An unknown run is looked at first, then a provider that is not configured, then an error
    in results(request_id, error); a request without a result has failed without a text.
    """
    known = runs.select("run_id", F.lit(True).alias("known")).distinct()
    answered = results.select("request_id", "error", F.lit(True).alias("answered"))
    joined = requests.join(known, "run_id", "left").join(answered, "request_id", "left")
    name, missing = provider.upper(), F.col("known").isNull()
    unset, failed = F.lit(not configured), F.col("answered").isNull() | F.col("error").isNotNull()
    pick = lambda *values: F.when(missing, values[0]).when(unset, values[1]).when(failed, values[2]).otherwise(values[3])
    code, detail = [F.lit(v) for v in (404, 503, 502, 200)], [F.lit(v) for v in ("RUN_NOT_FOUND", f"{name}_NOT_CONFIGURED", f"{name}_WEB_COMPARISON_FAILED", None)]
    message = [F.lit("Run not found"), F.lit(f"{provider.capitalize()} integration is not configured"), F.coalesce("error", F.lit("")), F.lit(None)]
    return joined.select("request_id", "run_id", pick(*code).alias("code"), pick(*detail).alias("detail"), pick(*message).alias("message"))
