"""Evidence rows: files, symbols and a sentence for every graph node."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import first_segment_file, node_id
from codeloom.operators.lineage import entity_id

_COLUMNS = ["run_id", "node_id", "files", "symbols", "explanation"]


def workflow_evidence(selected: DataFrame) -> DataFrame:
    """Evidence of the selected functions (at most eight per run).

    Two selected definitions of one name share a node; the later one wins.
    """
    sentence = F.format_string(
        "Workflow node extracted from function `%s` with complexity %d and %d detected calls.",
        "qname", "complexity", "n_calls",
    )
    rows = selected.select(
        "run_id",
        "node_ord",
        node_id("wf", F.col("qname")).alias("node_id"),
        F.array("file_path").alias("files"),
        F.concat(F.array("qname"), "first_calls").alias("symbols"),
        sentence.alias("explanation"),
    )
    return (
        rows.groupBy("run_id", "node_id")
        .agg(F.max_by(F.struct("files", "symbols", "explanation"), "node_ord").alias("e"))
        .select("run_id", "node_id", "e.*")
    )


def entity_evidence(functions: DataFrame, top: DataFrame) -> DataFrame:
    """Evidence of the top entities from their first five functions in file order.

    The five are cut per map task for every entity; the top entities are chosen after
    that, among few rows.
    """
    order = Window.partitionBy("run_id", "entity").orderBy("file_path", "fn_ord")
    first = (
        functions.select("run_id", F.explode("entities").alias("entity"), "file_path", "fn_ord", "qname", "crud_ops")
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= 5)
        .join(top.select("run_id", "entity"), ["run_id", "entity"], "left_semi")
    )
    listed = first.groupBy("run_id", "entity").agg(
        F.array_sort(F.collect_list(F.struct("place", "file_path", "qname", "crud_ops"))).alias("f")
    )
    crud = F.array_join(F.get("f", F.lit(0))["crud_ops"], ", ")
    sentence = F.concat(
        F.lit("Entity `"), F.col("entity"),
        F.lit("` inferred from symbols that include entity tokens and CRUD operations ("),
        F.coalesce(F.nullif(crud, F.lit("")), F.lit("no explicit CRUD token")),
        F.lit(")."),
    )
    return listed.select(
        "run_id",
        entity_id(F.col("entity")).alias("node_id"),
        F.array_sort(F.array_distinct(F.transform("f", lambda x: x["file_path"]))).alias("files"),
        F.slice(F.transform("f", lambda x: x["qname"]), 1, 3).alias("symbols"),
        sentence.alias("explanation"),
    )


def risk_hub_evidence(findings: DataFrame) -> DataFrame:
    """Evidence of the hub.  The file is the first dotted segment of the top symbol."""
    per_run = findings.groupBy("run_id").agg(
        F.max_by("symbol", F.struct("score", -F.col("finding_ord"))).alias("top"),
        F.array_sort(F.collect_list(F.struct("finding_ord", "symbol"))).alias("all"),
    )
    return per_run.select(
        "run_id",
        F.lit("risk-hub").alias("node_id"),
        F.array(first_segment_file(F.col("top"))).alias("files"),
        F.slice(F.transform("all", lambda x: x["symbol"]), 1, 3).alias("symbols"),
        F.lit(
            "Risk hub combines complexity, coupling, dead-code and test-gap signals "
            "from static analysis."
        ).alias("explanation"),
    )


def evidence(
    selected: DataFrame, functions: DataFrame, top: DataFrame, findings: DataFrame
) -> DataFrame:
    return (
        workflow_evidence(selected)
        .unionByName(entity_evidence(functions, top))
        .unionByName(risk_hub_evidence(findings))
    )


def evidence_for(requests: DataFrame, runs: DataFrame, rows: DataFrame) -> DataFrame:
    """Evidence for requests(request_id, run_id, node_id) with an outcome for each."""
    known = runs.select("run_id", F.lit(True).alias("known")).distinct()
    joined = requests.join(known, "run_id", "left").join(rows, ["run_id", "node_id"], "left")
    outcome = (
        F.when(F.col("known").isNull(), F.lit("RUN_NOT_FOUND"))
        .when(F.col("explanation").isNull(), F.lit("EVIDENCE_NOT_FOUND"))
        .otherwise(F.lit("OK"))
    )
    return joined.select("request_id", *_COLUMNS, outcome.alias("outcome"))
