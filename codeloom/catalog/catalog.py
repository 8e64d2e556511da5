"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.catalog import (  # noqa: F401
    answers_and_views,
    graphs_and_risk,
    runs_and_responses,
    sources_and_parsing,
    summaries,
)
from codeloom.catalog import adapters as ad
from codeloom.catalog.registry import ORACLES, QUERIES  # noqa: F401
from codeloom.operators import callgraph, risk
from codeloom.plans.analyze import parse_corpus
from codeloom.session import stored
from codeloom.sources.files import select_sources


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk findings of every run: parse, tag, resolve calls, rank and score."""
    _, functions = parse_corpus(select_sources(ad.source_files(spark, sf_dir), None))
    functions = stored(functions)
    profiles = stored(callgraph.with_degrees(functions, callgraph.call_edges(functions)))
    return risk.risk_findings(ad.run_table(spark, sf_dir), profiles)
