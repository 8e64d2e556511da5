"""Cited answers for a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import coerce
from codeloom.functions import lexicons as lx
from codeloom.functions.text import first_segment_file, strip
from codeloom.operators.responses import (
    clean_string_list,
    extract_json_object,
    no_citations,
    normalise_citations,
)

# Fixed texts.
NO_IMPLICATIONS = "Dust returned no explicit implications"
FOCUS_REASON = "Focused evidence from analysis artifact"
TOP_REASON = "Highest risk symbol in this run."
REGRESSIONS = "Potential regressions where control-flow and data-flow intersect"


def _first_rows(table: DataFrame, order: str, cap: int, fields: list[str], name: str) -> DataFrame:
    """The first ``cap`` rows of every run as one sorted list."""
    by_order = Window.partitionBy("run_id").orderBy(order)
    return (
        table.withColumn("_place", F.row_number().over(by_order))
        .where(F.col("_place") <= cap)
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.struct("_place", *fields))).alias("_rows"))
        .select(
            "run_id", F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(name)
        )
    )


def _whole_row(table: DataFrame, name: str) -> DataFrame:
    """(run_id, name): all other columns of a table with one row per run as one struct."""
    return table.select("run_id", F.struct(*[c for c in table.columns if c != "run_id"]).alias(name))


def run_context(
    nodes: DataFrame, edges: DataFrame, findings: DataFrame, evidence: DataFrame, enrichment: DataFrame, runs: DataFrame
) -> DataFrame:
    """One row per run with capped lists; it does not depend on the questions.

    ``runs`` (run_id, status, ... its summary) and ``enrichment`` are taken with all their
    columns, as the structs ``run`` and ``enrichment``; both may lack a run.
    """
    first_nodes = _first_rows(
        nodes, "node_ord", lx.CONTEXT_NODES, ["node_id", "label", "node_type", "risk_score"], "nodes"
    )
    first_edges = _first_rows(
        edges, "edge_ord", lx.CONTEXT_EDGES, ["source", "target", "edge_type", "confidence"], "edges"
    )
    first_findings = _first_rows(
        findings, "finding_ord", lx.CONTEXT_FINDINGS,
        ["finding_id", "category", "severity", "score", "title", "rationale", "symbol", "suggestions"], "findings",
    )
    known = nodes.select("run_id", "node_id", "label", "node_ord").join(evidence, ["run_id", "node_id"])
    node_evidence = _first_rows(
        known.where(F.col("node_ord") <= lx.CONTEXT_NODES), "node_ord", lx.CONTEXT_NODES,
        ["node_id", "label", "files", "symbols", "explanation"], "node_evidence",
    )
    top = findings.groupBy("run_id").agg(
        F.max_by(
            F.struct("symbol", "severity", "score", "category"),
            F.struct("score", -F.col("finding_ord")),
        ).alias("top")
    )
    return (
        first_nodes.join(first_findings, "run_id")
        .join(first_edges, "run_id", "left")
        .join(node_evidence, "run_id", "left")
        .join(top, "run_id")
        .join(_whole_row(enrichment, "enrichment"), "run_id", "left")
        .join(_whole_row(runs, "run"), "run_id", "left")
    )


def answer_context(requests: DataFrame, context: DataFrame, evidence: DataFrame) -> DataFrame:
    """requests(request_id, run_id, question, focus_node_id) with the context of their run.

    The focus is the given node, else the first one; its evidence may be missing.
    """
    focus = F.coalesce(F.nullif("focus_node_id", F.lit("")), F.get("nodes", F.lit(0))["node_id"])
    of_focus = evidence.select(
        "run_id",
        F.col("node_id").alias("focus"),
        F.struct("files", "symbols", "explanation").alias("focus_evidence"),
    )
    return requests.join(context, "run_id").withColumn("focus", focus).join(
        of_focus, ["run_id", "focus"], "left"
    )


def local_answer() -> Column:
    """Sentence from the top finding and the focus node of an answer context."""
    return F.concat(
        F.lit("Primary impact area is `"), F.col("top.symbol"),
        F.lit("` ("), F.col("top.severity"),
        F.lit(", score "), F.col("top.score").cast("string"),
        F.lit("). For change around `"), F.col("focus"),
        F.lit(
            "`, prioritize tests on dependent calls and data-flow handoffs shown in "
            "workflow/lineage graphs."
        ),
    )


def _citation(file_path: Column, symbol: Column, reason: Column) -> Column:
    none = F.lit(None).cast("int")
    return F.struct(
        file_path.alias("file_path"), symbol.alias("symbol"), reason.alias("reason"),
        none.alias("line_start"), none.alias("line_end"),
    )


def _focus_pairs(reason: Column) -> Column:
    """First three files and symbols of the focus, paired up to the shorter list."""
    files = F.slice("focus_evidence.files", 1, 3)
    symbols = F.slice("focus_evidence.symbols", 1, 3)
    paired = F.slice(
        F.arrays_zip(files.alias("file"), symbols.alias("symbol")),
        F.lit(1),
        F.least(F.size(files), F.size(symbols)),
    )
    return F.coalesce(
        F.transform(paired, lambda p: _citation(p["file"], p["symbol"], reason)), no_citations()
    )


def citations() -> Column:
    """Citations from the focus evidence, else from the top finding."""
    linked = _focus_pairs(
        F.concat(F.lit("Evidence linked to focused node `"), F.col("focus"), F.lit("`."))
    )
    top = F.array(
        _citation(first_segment_file(F.col("top.symbol")), F.col("top.symbol"), F.lit(TOP_REASON))
    )
    return F.when(F.size(linked) > 0, linked).otherwise(top)


def related_nodes() -> Column:
    return F.transform(F.slice("nodes", 1, 5), lambda n: n["node_id"])


def remote_answers(remote: DataFrame) -> DataFrame:
    """remote(request_id, raw_text, error) to typed answers; unusable ones give no row.

    A JSON answer without text reads ``No answer generated``.
    """
    doc = extract_json_object(F.col("raw_text"))
    answer = strip(F.coalesce(coerce.text_at(F.col("doc"), "$.answer"), F.lit("")))
    return (
        remote.where(F.col("error").isNull())
        .select("request_id", doc.alias("doc"))
        .where(F.col("doc").isNotNull())
        .select(
            "request_id",
            F.coalesce(F.nullif(answer, F.lit("")), F.lit("No answer generated")).alias("remote_answer"),
            normalise_citations(coerce.at(F.col("doc"), "$.citations")).alias("remote_citations"),
            clean_string_list(coerce.at(F.col("doc"), "$.risk_implications")).alias("remote_risks"),
            clean_string_list(coerce.at(F.col("doc"), "$.related_nodes")).alias("remote_nodes"),
        )
    )


def answers(context: DataFrame, remote: DataFrame) -> DataFrame:
    """The remote answer where there is one, else the local one."""
    joined = context.join(remote, "request_id", "left")
    is_remote = F.col("remote_answer").isNotNull()
    own_citations = F.when(F.size("remote_citations") > 0, F.col("remote_citations")).otherwise(
        _focus_pairs(F.lit(FOCUS_REASON))
    )
    own_risks = F.when(F.size("remote_risks") > 0, F.col("remote_risks")).otherwise(
        lx.string_array([NO_IMPLICATIONS])
    )
    own_nodes = F.when(F.size("remote_nodes") > 0, F.col("remote_nodes")).otherwise(related_nodes())
    local_risks = F.array(
        F.concat(F.lit("Top risk category: "), F.col("top.category")), F.lit(REGRESSIONS)
    )
    pick = lambda remote_value, local_value: F.when(is_remote, remote_value).otherwise(local_value)
    return joined.select(
        "request_id",
        "run_id",
        "focus",
        pick(F.lit("remote"), F.lit("local")).alias("source"),
        pick(F.col("remote_answer"), local_answer()).alias("answer"),
        pick(own_citations, citations()).alias("citations"),
        pick(own_risks, local_risks).alias("risk_implications"),
        pick(own_nodes, related_nodes()).alias("related_nodes"),
    )
