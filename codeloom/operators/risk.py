"""Risk findings and the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import lexicons as lx
from codeloom.functions.scores import capped, severity
from codeloom.functions.text import has_entry_hint

_FILE_ORDER = ["file_path", "fn_ord"]


def attach_suggestions(category: Column) -> Column:
    """The two suggestion texts of a category, as a literal map lookup."""
    pairs = [part for c, texts in lx.SUGGESTIONS.items() for part in (F.lit(c), lx.string_array(texts))]
    return F.create_map(*pairs)[category]


def _finding(
    ordinal: Column | int, finding_id: Column | str, category: str, score: Column,
    title: Column | str, rationale: Column | str, symbol: Column,
) -> Column:
    """One finding as a struct in table order."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_col(ordinal).alias("finding_ord"),
        as_col(finding_id).alias("finding_id"),
        F.lit(category).alias("category"),
        severity(score).alias("severity"),
        score.alias("score"),
        as_col(title).alias("title"),
        as_col(rationale).alias("rationale"),
        symbol.alias("symbol"),
        attach_suggestions(F.lit(category)).alias("suggestions"),
    )


def _rows(table: DataFrame, *findings: Column) -> DataFrame:
    """The given findings of every row; null ones are left out."""
    return table.select("run_id", F.inline(F.array_compact(F.array(*findings))))


def most_complex(profiles: DataFrame, k: int = lx.COMPLEXITY_FINDINGS) -> DataFrame:
    """Top k functions per run by complexity, ties in file order."""
    order = Window.partitionBy("run_id").orderBy(F.col("complexity").desc(), *_FILE_ORDER)
    return profiles.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def complexity_findings(profiles: DataFrame) -> DataFrame:
    score = capped(20 + F.col("complexity") * 5 + F.col("out_degree") * 2, 98.0)
    finding = _finding(
        F.col("place"),
        F.concat(F.lit("complexity-"), F.col("place").cast("string")),
        "complexity",
        score,
        F.concat(F.lit("High complexity in "), F.col("short_name")),
        F.format_string(
            "Cyclomatic estimate %d with outbound dependency count %d.", "complexity", "out_degree"
        ),
        F.col("qname"),
    )
    return _rows(most_complex(profiles), finding)


def _is_dead() -> Column:
    return (
        (F.col("out_degree") == 0)
        & (F.col("in_degree") == 0)
        & (F.col("complexity") >= 3)
        & ~has_entry_hint(F.col("short_name"))
    )


def dead_code_candidates(functions: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions at no edge end, not trivial, and not named like an entry point.

    The local conditions cut the functions before the anti join.
    """
    ends = edges.select("run_id", F.explode(F.array("source", "target")).alias("qname")).distinct()
    return functions.where(
        (F.col("complexity") >= 3) & ~has_entry_hint(F.col("short_name"))
    ).join(ends, ["run_id", "qname"], "left_anti")


def run_extremes(profiles: DataFrame) -> DataFrame:
    """Per run, in one partial-final aggregation: the most coupled function, the first
    dead one, the most complex one, and whether any path looks like a test."""
    who = F.struct("qname", "complexity", "out_degree", "in_degree")
    degree = F.col("out_degree") + F.col("in_degree")
    dead = _is_dead()
    return profiles.groupBy("run_id").agg(
        F.min_by(who, F.struct(-degree, *_FILE_ORDER)).alias("coupled"),
        F.min_by(who, F.when(dead, F.struct(*_FILE_ORDER))).alias("dead"),
        F.min_by(who, F.struct(-F.col("complexity"), *_FILE_ORDER)).alias("complex"),
        F.bool_or(F.contains(F.lower("file_path"), F.lit("test"))).alias("has_tests"),
    )


def _coupling() -> Column:
    fan_out, fan_in = F.col("coupled.out_degree"), F.col("coupled.in_degree")
    return _finding(
        4,
        "coupling-1",
        "coupling",
        capped(35 + (fan_out + fan_in) * 7, 95.0),
        "Coupling hotspot across modules",
        F.format_string("Function has in/out call degree %d/%d.", fan_in, fan_out),
        F.col("coupled.qname"),
    )


def _dead() -> Column:
    finding = _finding(
        5,
        "dead-code-1",
        "dead_code",
        capped(28 + F.col("dead.complexity") * 6, 88.0),
        "Potential dead code path",
        "No inbound and outbound calls observed in static call graph approximation.",
        F.col("dead.qname"),
    )
    return F.when(F.col("dead").isNotNull(), finding)


def _test_gap() -> Column:
    finding = _finding(
        6,
        "test-gap-1",
        "test_gap",
        capped(55 + F.col("complex.complexity") * 3, 94.0),
        "Limited test coverage signals",
        "No test files detected in scanned Python paths while critical logic is complex.",
        F.col("complex.qname"),
    )
    return F.when(~F.col("has_tests"), finding)


def coupling_finding(extremes: DataFrame) -> DataFrame:
    """One finding per run with a function, even at degree 0."""
    return _rows(extremes, _coupling())


def dead_code_finding(extremes: DataFrame) -> DataFrame:
    """The first candidate in file order (not the worst one)."""
    return _rows(extremes, _dead())


def test_gap_finding(extremes: DataFrame) -> DataFrame:
    """Runs in which no function's path contains ``test``."""
    return _rows(extremes, _test_gap())


def empty_risk_finding(runs: DataFrame, with_findings: DataFrame) -> DataFrame:
    """The stand-in finding of runs which do not occur in ``with_findings``."""
    return _rows(
        runs.join(with_findings.select("run_id").distinct(), "run_id", "left_anti"), _empty()
    )


def _empty() -> Column:
    return _finding(
        1,
        "complexity-fallback",
        "complexity",
        F.lit(20.0),
        "Low confidence risk snapshot",
        "Repository contained too few Python symbols for robust risk scoring.",
        F.lit("n/a"),
    )


def risk_findings(runs: DataFrame, profiles: DataFrame) -> DataFrame:
    """All findings; ``finding_ord`` gives their order inside a run.

    Two passes over the profiles: the complexity ranking, and one aggregation for all
    the rest.  A run without a function has no row of extremes and so the stand-in.
    """
    per_run = runs.select("run_id").join(run_extremes(profiles), "run_id", "left")
    known = F.col("coupled").isNotNull()
    others = _rows(
        per_run,
        F.when(known, _coupling()),
        F.when(known, _dead()),
        F.when(known, _test_gap()),
        F.when(~known, _empty()),
    )
    return complexity_findings(profiles).unionByName(others)


def overall_risk(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(F.round(F.avg("score"), 2).alias("overall_score"))
