"""Call resolution, edges and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import stored


def explode_calls(functions: DataFrame) -> DataFrame:
    """One row per call in order, duplicates kept."""
    return functions.select(
        "run_id", "file_path", "fn_ord", F.col("qname").alias("source"),
        F.posexplode("calls").alias("call_ord", "call"),
    )


def exact_names(functions: DataFrame) -> DataFrame:
    """Distinct qualified names per run."""
    return functions.select("run_id", "qname").distinct()


def resolve_exact(names: DataFrame, functions: DataFrame) -> DataFrame:
    """(run_id, call) pairs whose text is a qualified name of the run."""
    targets = exact_names(functions).select("run_id", F.col("qname").alias("call"))
    return names.join(targets, ["run_id", "call"], "left_semi").select(
        "run_id", "call", F.col("call").alias("target")
    )


def name_lookup(functions: DataFrame) -> DataFrame:
    """(run_id, name, exact, short): one stored row per name a call may end in or be.

    ``exact`` is the name itself where it is a qualified name, ``short`` the only function
    with it as its short name.  As a stored table it is read below a plain exchange, so that
    adaptive execution may split the calls of a hot name which meet it.
    """
    names = F.array(
        F.struct(F.col("qname").alias("name"), F.col("qname").alias("exact"), F.lit(None).cast("string").alias("owner")),
        F.struct(F.col("short_name").alias("name"), F.lit(None).cast("string").alias("exact"), F.col("qname").alias("owner")),
    )
    rows = functions.select("run_id", F.inline(names))
    merged = rows.groupBy("run_id", "name").agg(F.max("exact").alias("exact"), F.min("owner").alias("low"), F.max("owner").alias("high"))
    return stored(merged.select("run_id", "name", "exact", F.when(F.col("low") == F.col("high"), F.col("low")).alias("short")))


def resolve_unique_short(names: DataFrame, functions: DataFrame) -> DataFrame:
    """(run_id, call) pairs whose last segment is an unambiguous short name of the run."""
    owners = name_lookup(functions).where("short IS NOT NULL").select("run_id", F.col("name").alias("short_name"), F.col("short").alias("target"))
    return (
        names.withColumn("short_name", F.substring_index("call", ".", -1))
        .join(owners, ["run_id", "short_name"])
        .select("run_id", "call", "target")
    )


def call_edges(functions: DataFrame) -> DataFrame:
    """Distinct (run_id, source, target); self calls stay.  An exact name beats a short one.

    A call looks its target up under its text and under its last segment, in one stored
    table of names; both joins lie on plain exchanges, so adaptive execution can split the
    calls of a popular callee.  Repeated calls of a function are dropped inside its row.
    """
    lookup = name_lookup(functions)
    pairs = functions.select(
        "run_id", F.col("qname").alias("source"), F.explode(F.array_distinct("calls")).alias("call")
    )
    exact = lookup.where("exact IS NOT NULL").select("run_id", F.col("name").alias("call"), "exact")
    short = lookup.where("short IS NOT NULL").select("run_id", F.col("name").alias("last"), "short")
    found = (
        pairs.join(exact, ["run_id", "call"], "left")
        .withColumn("last", F.substring_index("call", ".", -1))
        .join(short, ["run_id", "last"], "left")
        .select("run_id", "source", F.coalesce("exact", "short").alias("target"))
    )
    return found.where(F.col("target").isNotNull()).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree of every edge end, in one pass over the edges."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    ends = edges.select(
        "run_id",
        F.explode(
            F.array(
                F.struct(F.col("source").alias("qname"), one.alias("o"), none.alias("i")),
                F.struct(F.col("target").alias("qname"), none.alias("o"), one.alias("i")),
            )
        ).alias("end"),
    )
    return ends.groupBy("run_id", F.col("end.qname").alias("qname")).agg(
        F.sum("end.o").alias("out_degree"), F.sum("end.i").alias("in_degree")
    )


def profile_columns(functions: DataFrame) -> DataFrame:
    """The narrow part of ``functions`` which ranking, risk and evidence need.

    Long lists shrink to their sizes and first entries, so that joins on names do not
    move whole call lists.
    """
    return functions.select(
        "run_id",
        "file_path",
        "fn_ord",
        "qname",
        "short_name",
        "complexity",
        F.size("entities").alias("n_entities"),
        F.size("crud_ops").alias("n_crud"),
        F.size("calls").alias("n_calls"),
        F.slice("calls", 1, 2).alias("first_calls"),
    )


def with_degrees(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Profiles: narrow functions plus out_degree and in_degree (0 when absent)."""
    joined = profile_columns(functions).join(degrees(edges), ["run_id", "qname"], "left")
    return joined.na.fill(0, ["out_degree", "in_degree"])
