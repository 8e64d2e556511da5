"""Process graph: ranked functions as nodes, their calls as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx
from codeloom.functions.scores import capped
from codeloom.functions.text import has_entry_hint, node_id, title_label
from codeloom.operators.ranking import ranked


def workflow_rank() -> Column:
    """Rank of a profile: complexity, fan-out, entry name, entities, CRUD."""
    hint = F.when(has_entry_hint(F.col("short_name")), F.lit(6.0)).otherwise(F.lit(0.0))
    bonus = hint + F.col("n_entities") * F.lit(1.5) + F.col("n_crud") * F.lit(1.0)
    return F.col("complexity") * F.lit(2.4) + F.col("out_degree") * F.lit(1.8) + bonus


def select_workflow(profiles: DataFrame, k: int | None = lx.WORKFLOW_NODES) -> DataFrame:
    """Top k functions per run by rank, ties in file order, as ``node_ord`` 1..k; all without ``k``."""
    order = Window.partitionBy("run_id").orderBy(F.col("rank").desc(), "file_path", "fn_ord")
    ranked = profiles.withColumn("rank", workflow_rank()).withColumn("node_ord", F.row_number().over(order))
    return ranked if k is None else ranked.where(F.col("node_ord") <= k)


def workflow_nodes(selected: DataFrame) -> DataFrame:
    score = capped(15 + F.col("complexity") * 4 + F.col("out_degree") * 3, 95.0)
    return selected.select(
        "run_id",
        "node_ord",
        node_id("wf", F.col("qname")).alias("node_id"),
        title_label(F.col("short_name")).alias("label"),
        F.when(score >= 75, F.lit("risk")).otherwise(F.lit("process")).alias("node_type"),
        score.alias("risk_score"),
    )


def workflow_edges(selected: DataFrame, edges: DataFrame, k: int | None = lx.WORKFLOW_NODES) -> DataFrame:
    """Call edges between two selected functions, in (source, target) name order.

    ``k`` says how many functions of a run are selected: a window then numbers at most k * k
    edges of it.  Without ``k`` a run may have any number of edges, and the numbers come from
    ranges of the whole order.
    """
    ids = selected.select("run_id", "qname", node_id("wf", F.col("qname")).alias("id")).distinct()
    inside = (
        edges.where(F.col("source") != F.col("target"))
        .join(ids.select("run_id", F.col("qname").alias("source"), F.col("id").alias("src")), ["run_id", "source"])
        .join(ids.select("run_id", F.col("qname").alias("target"), F.col("id").alias("dst")), ["run_id", "target"])
    )
    inside = inside.select("run_id", "source", "target", "src", "dst")
    if k is None:
        numbered = ranked(inside, ["run_id"], ["source", "target"], "edge_ord")
    else:
        by_name = Window.partitionBy("run_id").orderBy("source", "target")
        numbered = inside.withColumn("edge_ord", F.row_number().over(by_name))
    return numbered.select(
        "run_id",
        "edge_ord",
        F.col("src").alias("source"),
        F.col("dst").alias("target"),
        F.lit("control").alias("edge_type"),
        F.lit(0.88).alias("confidence"),
    )


def chain_edges(nodes: DataFrame, edges: DataFrame, edge_type: str, confidence: float) -> DataFrame:
    """Consecutive nodes linked in order, for runs without any edge."""
    in_order = Window.partitionBy("run_id").orderBy("node_ord")
    return (
        nodes.join(edges.select("run_id").distinct(), "run_id", "left_anti")
        .select(
            "run_id",
            F.col("node_ord").alias("edge_ord"),
            F.col("node_id").alias("source"),
            F.lead("node_id").over(in_order).alias("target"),
            F.lit(edge_type).alias("edge_type"),
            F.lit(confidence).alias("confidence"),
        )
        .where(F.col("target").isNotNull())
    )


def workflow_chain_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return chain_edges(nodes, edges, "control", 0.62)


def risk_hub_node(nodes: DataFrame, overall: DataFrame) -> DataFrame:
    """The extra node ``risk-hub`` of every run which has nodes."""
    last = nodes.groupBy("run_id").agg(F.max("node_ord").alias("last"))
    return last.join(overall, "run_id").select(
        "run_id",
        (F.col("last") + 1).alias("node_ord"),
        F.lit("risk-hub").alias("node_id"),
        F.lit("Risk Aggregator").alias("label"),
        F.lit("risk").alias("node_type"),
        F.col("overall_score").alias("risk_score"),
    )


def risk_hub_edge(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Risk edge from the first highest-score node of each run to the hub."""
    highest = nodes.groupBy("run_id").agg(
        F.max_by("node_id", F.struct("risk_score", -F.col("node_ord"))).alias("source")
    )
    last = edges.groupBy("run_id").agg(F.max("edge_ord").alias("last"))
    return highest.join(last, "run_id", "left").select(
        "run_id",
        (F.coalesce("last", F.lit(0)) + 1).alias("edge_ord"),
        "source",
        F.lit("risk-hub").alias("target"),
        F.lit("risk").alias("edge_type"),
        F.lit(0.84).alias("confidence"),
    )


def append_risk_hub(
    nodes: DataFrame, edges: DataFrame, overall: DataFrame
) -> tuple[DataFrame, DataFrame]:
    return (
        nodes.unionByName(risk_hub_node(nodes, overall)),
        edges.unionByName(risk_hub_edge(nodes, edges)),
    )


def workflow_graph(
    selected: DataFrame, control: DataFrame, overall: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the process graph, risk hub included.

    ``control`` (see ``workflow_edges``) is used several times: pass a stored table, so that
    the large edge table is joined once.
    """
    nodes = workflow_nodes(selected)
    return append_risk_hub(nodes, control.unionByName(workflow_chain_edges(nodes, control)), overall)
