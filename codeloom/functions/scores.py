"""Score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _banded(score: Column, cuts: list[tuple[float, str]], lowest: str) -> Column:
    """First label whose (inclusive) cut the score reaches."""
    result = F.lit(lowest)
    for cut, label in sorted(cuts):
        result = F.when(score >= cut, F.lit(label)).otherwise(result)
    return result


def severity(score: Column) -> Column:
    return _banded(score, [(85.0, "critical"), (70.0, "high"), (50.0, "medium")], "low")


def readiness_band(score: Column) -> Column:
    return _banded(score, [(70.0, "high"), (45.0, "medium")], "low")


def capped(score: Column, cap: float) -> Column:
    return F.round(F.least(F.lit(cap), score.cast("double")), 2)


def clamped(score: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), score))


def hash_score(values: list[Column], low: float, high: float) -> Column:
    """Stable pseudo-score in [low, high] from the SHA-256 of the joined values."""
    head = F.substring(F.sha2(F.concat_ws("::", *values), 256), 1, 8)
    ratio = F.conv(head, 16, 10).cast("bigint") / F.lit(float(0xFFFFFFFF))
    return F.round(F.lit(low) + F.lit(high - low) * ratio, 2)


def score_bucket(score: Column, scheme: str) -> Column:
    """Display bucket; the three schemes have different cuts."""
    if scheme == "panel":
        return F.when(score > 60, F.lit("high")).when(score >= 40, F.lit("medium")).otherwise(F.lit("low"))
    if scheme == "node":
        return F.when(score > 70, F.lit("high")).when(score >= 50, F.lit("medium")).otherwise(F.lit("low"))
    if scheme == "detail":
        return (
            F.when(score > 70, F.lit("high"))
            .when(score > 50, F.lit("elevated"))
            .when(score >= 30, F.lit("moderate"))
            .otherwise(F.lit("low"))
        )
    raise ValueError(f"unknown scheme: {scheme}")
