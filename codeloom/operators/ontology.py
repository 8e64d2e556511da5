"""Capability clusters, integration exposure and the ontology summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx


def _surface(*more: Column) -> Column:
    return F.lower(F.concat_ws(" ", "file_path", "qname", "short_name", *more))


_ALL = "*"


def cluster_signals(functions: DataFrame) -> DataFrame:
    """Functions per run and domain, and per run in all (name ``*``), in one pass.

    A function may count in several domains.
    """
    domains = F.array_compact(
        F.array(
            *[
                F.when(lx.contains_any(F.col("surface"), hints), F.lit(domain))
                for domain, hints in lx.CAPABILITY_DOMAINS.items()
            ],
            F.lit(_ALL),
        )
    )
    return (
        functions.select("run_id", _surface().alias("surface"))
        .select("run_id", F.explode(domains).alias("name"))
        .groupBy("run_id", "name")
        .agg(F.count("*").alias("signal_count"))
    )


def capability_clusters(runs: DataFrame, functions: DataFrame, k: int = lx.TOP_CLUSTERS) -> DataFrame:
    """Top clusters per run; a run without a signal gives ``Core`` with its function total.

    A run has at most five signal rows, so its ranking happens in one small list.
    """
    listed = cluster_signals(functions).groupBy("run_id").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("name") != _ALL, F.struct(-F.col("signal_count"), "name")))
        ).alias("found"),
        F.max(F.when(F.col("name") == _ALL, F.col("signal_count"))).alias("total"),
    )
    core = F.array(F.struct((-F.coalesce("total", F.lit(0))).alias("col1"), F.lit("Core").alias("name")))
    ranked = F.when(F.size("found") > 0, F.col("found")).otherwise(core)
    return (
        runs.select("run_id")
        .join(listed, "run_id", "left")
        .select("run_id", F.posexplode(F.slice(ranked, 1, k)).alias("at", "c"))
        .select(
            "run_id",
            F.col("c.name").alias("name"),
            (-F.col("c.col1")).alias("signal_count"),
            (F.col("at") + 1).alias("cluster_ord"),
        )
    )


def integration_exposure(runs: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions which look like inbound and outbound touch points, per run."""
    surface = _surface(F.array_join(F.slice("calls", 1, lx.SURFACE_CALLS), " "))
    counted = (
        functions.select("run_id", surface.alias("surface"))
        .select(
            "run_id",
            lx.contains_any(F.col("surface"), lx.INBOUND_HINTS).alias("is_inbound"),
            lx.contains_any(F.col("surface"), lx.OUTBOUND_HINTS).alias("is_outbound"),
        )
        .groupBy("run_id")
        .agg(F.count_if("is_inbound").alias("inbound"), F.count_if("is_outbound").alias("outbound"))
    )
    return runs.select("run_id").join(counted, "run_id", "left").na.fill(0, ["inbound", "outbound"])


def ontology_summary(
    runs: DataFrame, entity_counts: DataFrame, clusters: DataFrame, exposure: DataFrame
) -> DataFrame:
    """One row per run: entity count, top entities, clusters and exposure."""
    order = Window.partitionBy("run_id").orderBy(F.col("functions").desc(), "entity")
    top = (
        entity_counts.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= lx.TOP_ENTITIES)
        .groupBy("run_id")
        .agg(F.array_sort(F.collect_list(F.struct("place", "entity"))).alias("top"))
    )
    totals = entity_counts.groupBy("run_id").agg(F.count("*").alias("entities_count"))
    listed = clusters.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("cluster_ord", "name", "signal_count"))).alias("c")
    )
    joined = (
        runs.select("run_id")
        .join(totals, "run_id", "left")
        .join(top, "run_id", "left")
        .join(listed, "run_id", "left")
        .join(exposure, "run_id", "left")
    )
    names = F.transform("top", lambda t: t["entity"])
    return joined.select(
        "run_id",
        F.coalesce("entities_count", F.lit(0)).alias("entities_count"),
        F.coalesce(names, lx.string_array([])).alias("top_entities"),
        F.transform("c", lambda c: F.struct(c["name"], c["signal_count"])).alias("capability_clusters"),
        "inbound",
        "outbound",
    )
