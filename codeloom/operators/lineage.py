"""Data-lineage graph: entities as nodes, hand-overs between them as edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx
from codeloom.functions.scores import capped
from codeloom.functions.text import slug
from codeloom.operators.fallback import core_entity
from codeloom.operators.workflow import chain_edges
from codeloom.session import stored


def entity_id(entity: Column) -> Column:
    return F.concat(F.lit("entity-"), slug(entity))


def entity_counts(functions: DataFrame) -> DataFrame:
    """Number of functions which mention each entity."""
    mentions = functions.select("run_id", F.explode("entities").alias("entity"))
    return mentions.groupBy("run_id", "entity").agg(F.count("*").alias("functions"))


def default_entities(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """Stand-in counts for runs(run_id, root_name) in which no entity was seen."""
    core = core_entity(F.col("root_name"))
    rows = F.array(
        F.struct(F.lit("Customer").alias("entity"), F.lit(2).cast("bigint").alias("functions")),
        F.struct(core.alias("entity"), F.lit(2).cast("bigint").alias("functions")),
        F.struct(F.lit("Invoice").alias("entity"), F.lit(1).cast("bigint").alias("functions")),
    )
    return (
        runs.join(counts.select("run_id").distinct(), "run_id", "left_anti")
        .select("run_id", F.inline(rows))
    )


def top_entities(counts: DataFrame, k: int = lx.TOP_ENTITIES) -> DataFrame:
    """Most common k per run, ties by name, as ``node_ord``."""
    order = Window.partitionBy("run_id").orderBy(F.col("functions").desc(), "entity")
    return counts.withColumn("node_ord", F.row_number().over(order)).where(F.col("node_ord") <= k)


def lineage_nodes(top: DataFrame) -> DataFrame:
    return top.select(
        "run_id",
        "node_ord",
        entity_id(F.col("entity")).alias("node_id"),
        F.col("entity").alias("label"),
        F.lit("data").alias("node_type"),
        capped(8 + F.col("functions") * 9, 70.0).alias("risk_score"),
    )


def entity_functions(functions: DataFrame, top: DataFrame) -> DataFrame:
    """Functions of every top entity; file order is (file_path, fn_ord)."""
    mentions = functions.select(
        "run_id", F.explode("entities").alias("entity"), "file_path", "fn_ord", "qname", "crud_ops"
    )
    return mentions.join(top.select("run_id", "entity"), ["run_id", "entity"], "left_semi")


def _without_repeats(sequence: Column) -> Column:
    return F.filter(sequence, lambda x, i: (i == 0) | (x != F.get(sequence, i - 1)))


def _pairs(sequence: Column) -> Column:
    """Adjacent pairs which differ."""
    following = F.slice(sequence, F.lit(2), F.greatest(F.size(sequence), F.lit(1)))
    both = F.zip_with(sequence, following, lambda a, b: F.struct(a.alias("source"), b.alias("target")))
    return F.filter(both, lambda p: p["target"].isNotNull() & (p["source"] != p["target"]))


def entity_transitions(functions: DataFrame, top: DataFrame) -> DataFrame:
    """How often one top entity directly follows another inside a function.

    Functions with the same entity sequence are counted together before the join
    with the (at most six) top entities of their run, so a run which holds a third
    of all functions shrinks to its distinct sequences first.  The lists of top entities
    are stored, one row per run: the join then lies on two plain exchanges, and adaptive
    execution can split the sequences of a hot run.
    """
    sequences = (
        functions.where(F.size("entities") > 1)
        .select("run_id", _without_repeats(F.col("entity_sequence")).alias("sequence"))
        .groupBy("run_id", "sequence")
        .agg(F.count("*").alias("n"))
    )
    allowed = stored(top.groupBy("run_id").agg(F.collect_set("entity").alias("allowed")))
    kept = sequences.join(allowed, "run_id").select(
        "run_id",
        "n",
        F.filter("sequence", lambda e: F.array_contains("allowed", e)).alias("sequence"),
    )
    steps = kept.select("run_id", "n", F.inline(_pairs(F.col("sequence"))))
    return steps.groupBy("run_id", "source", "target").agg(F.sum("n").alias("weight"))


def lineage_edges(transitions: DataFrame, k: int = lx.TOP_TRANSITIONS) -> DataFrame:
    """Most common k transitions as data edges."""
    order = Window.partitionBy("run_id").orderBy(F.col("weight").desc(), "source", "target")
    return (
        transitions.withColumn("edge_ord", F.row_number().over(order))
        .where(F.col("edge_ord") <= k)
        .select(
            "run_id",
            "edge_ord",
            entity_id(F.col("source")).alias("source"),
            entity_id(F.col("target")).alias("target"),
            F.lit("data").alias("edge_type"),
            capped(F.lit(0.55) + F.col("weight") * F.lit(0.08), 0.98).alias("confidence"),
        )
    )


def lineage_chain_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return chain_edges(nodes, edges, "data", 0.6)


def lineage_top(runs: DataFrame, functions: DataFrame) -> DataFrame:
    """Top entities per run, with stand-ins where a run has none."""
    counts = entity_counts(functions)
    return top_entities(counts.unionByName(default_entities(runs, counts)))


def lineage_graph(top: DataFrame, data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of the lineage graph from its capped edges (``lineage_edges``)."""
    nodes = lineage_nodes(top)
    return nodes, data.unionByName(lineage_chain_edges(nodes, data))
