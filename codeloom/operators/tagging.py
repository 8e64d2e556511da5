"""Native tagging of raw syntax facts: entities, CRUD words, complexity, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx


def _tags(idents: Column, lexicon: Column) -> Column:
    """Tags of every identifier in order; a token matches anywhere inside it."""
    normal = F.transform(idents, lambda i: F.replace(F.lower(i), F.lit("_"), F.lit(".")))
    return F.flatten(
        F.transform(
            normal,
            lambda i: F.transform(
                F.filter(lexicon, lambda t: F.contains(i, t["token"])), lambda t: t["tag"]
            ),
        )
    )


def tag_entities(idents: Column, lexicon: Column | None = None) -> Column:
    """Ordered entity mentions; one identifier may give several, or one twice."""
    return _tags(idents, lx.token_table(lx.ENTITY_TOKENS) if lexicon is None else lexicon)


def tag_crud(idents: Column, lexicon: Column | None = None) -> Column:
    """Sorted set of CRUD operations (substring match: ``offset`` counts as ``set``)."""
    # A set needs each identifier once.
    table = lx.token_table(lx.CRUD_TOKENS) if lexicon is None else lexicon
    return F.array_sort(F.array_distinct(_tags(F.array_distinct(idents), table)))


def as_set(sequence: Column) -> Column:
    return F.array_sort(F.array_distinct(sequence))


def complexity(branch_kinds: Column) -> Column:
    """One plus the number of branch nodes."""
    counted = F.map_filter(branch_kinds, lambda k, _: k.isin(lx.BRANCH_KINDS))
    return F.aggregate(F.map_values(counted), F.lit(1), lambda total, n: total + n)


def tag_functions(raw: DataFrame) -> DataFrame:
    """Raw function facts to the ``functions`` table."""
    return (
        raw.withColumn("entity_sequence", tag_entities(F.col("idents")))
        .withColumn("entities", as_set(F.col("entity_sequence")))
        .withColumn("crud_ops", tag_crud(F.col("idents")))
        .withColumn("complexity", complexity(F.col("branch_kinds")))
        .select(
            "run_id", "file_path", "fn_ord", "qname", "short_name", "line_start", "line_end",
            "complexity", "calls", "entity_sequence", "entities", "crud_ops",
        )
    )


def scan_counters(runs: DataFrame, facts: DataFrame) -> DataFrame:
    """files_scanned, functions_scanned, parse_errors and imports per run; empty runs give 0.

    Every file has a record of its own among the facts, so nothing is read twice.
    """
    is_type = lambda t: F.count_if(F.col("record_type") == t)
    per_run = facts.groupBy("run_id").agg(
        is_type("file").alias("files_scanned"),
        is_type("function").alias("functions_scanned"),
        is_type("error").alias("parse_errors"),
        is_type("import").alias("imports"),
    )
    return runs.select("run_id").join(per_run, "run_id", "left").na.fill(0)
