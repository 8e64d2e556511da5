"""The whole analysis of a corpus, from files and repositories to all products."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import (
    callgraph,
    evidence,
    fallback,
    lineage,
    migration,
    ontology,
    risk,
    tagging,
    workflow,
)
from codeloom.sources.extract import extract_facts, extract_functions
from codeloom.sources.files import decoded

Keep = Callable[[DataFrame], DataFrame]


def _as_is(df: DataFrame) -> DataFrame:
    return df


@dataclass(frozen=True)
class Products:
    """Result tables; one row set per run."""

    workflow_nodes: DataFrame
    workflow_edges: DataFrame
    lineage_nodes: DataFrame
    lineage_edges: DataFrame
    findings: DataFrame
    overall: DataFrame
    evidence: DataFrame
    ontology: DataFrame
    migration: DataFrame

    def union(self, other: "Products") -> "Products":
        return Products(
            **{
                name: getattr(self, name).unionByName(getattr(other, name))
                for name in self.__dataclass_fields__
            }
        )


def parse_corpus(files: DataFrame, keep: Keep = _as_is) -> tuple[DataFrame, DataFrame]:
    """files(run_id, path, content) to (facts, functions).

    ``keep`` marks tables which are used many times; pass ``DataFrame.persist`` or a
    function which writes and reads back a table.
    """
    facts = keep(extract_facts(decoded(files)))
    return facts, keep(tagging.tag_functions(extract_functions(facts)))


class Analysis:
    """Products of runs(run_id, root_name) from their functions, each made on first use.

    Tables which several products need go through ``keep`` once.
    """

    def __init__(self, runs: DataFrame, functions: DataFrame, keep: Keep = _as_is) -> None:
        self.runs = runs
        self.functions = functions
        self._keep = keep

    @cached_property
    def edges(self) -> DataFrame:
        return self._keep(callgraph.call_edges(self.functions))

    @cached_property
    def profiles(self) -> DataFrame:
        return self._keep(callgraph.with_degrees(self.functions, self.edges))

    @cached_property
    def findings(self) -> DataFrame:
        return self._keep(risk.risk_findings(self.runs, self.profiles))

    @cached_property
    def overall(self) -> DataFrame:
        return risk.overall_risk(self.findings)

    @cached_property
    def selected(self) -> DataFrame:
        return self._keep(workflow.select_workflow(self.profiles))

    @cached_property
    def control_edges(self) -> DataFrame:
        return self._keep(workflow.workflow_edges(self.selected, self.edges))

    @cached_property
    def _workflow(self) -> tuple[DataFrame, DataFrame]:
        return workflow.workflow_graph(self.selected, self.control_edges, self.overall)

    @property
    def workflow_nodes(self) -> DataFrame:
        return self._workflow[0]

    @property
    def workflow_edges(self) -> DataFrame:
        return self._workflow[1]

    @cached_property
    def entity_counts(self) -> DataFrame:
        return self._keep(lineage.entity_counts(self.functions))

    @cached_property
    def top_entities(self) -> DataFrame:
        defaults = lineage.default_entities(self.runs, self.entity_counts)
        return self._keep(lineage.top_entities(self.entity_counts.unionByName(defaults)))

    @cached_property
    def data_edges(self) -> DataFrame:
        transitions = lineage.entity_transitions(self.functions, self.top_entities)
        return self._keep(lineage.lineage_edges(transitions))

    @cached_property
    def _lineage(self) -> tuple[DataFrame, DataFrame]:
        return lineage.lineage_graph(self.top_entities, self.data_edges)

    @property
    def lineage_nodes(self) -> DataFrame:
        return self._lineage[0]

    @property
    def lineage_edges(self) -> DataFrame:
        return self._lineage[1]

    @cached_property
    def evidence(self) -> DataFrame:
        return evidence.evidence(self.selected, self.functions, self.top_entities, self.findings)

    @cached_property
    def exposure(self) -> DataFrame:
        return self._keep(ontology.integration_exposure(self.runs, self.functions))

    @cached_property
    def ontology(self) -> DataFrame:
        clusters = ontology.capability_clusters(self.runs, self.functions)
        return ontology.ontology_summary(self.runs, self.entity_counts, clusters, self.exposure)

    @cached_property
    def migration(self) -> DataFrame:
        boundaries = self._keep(migration.extraction_boundaries(self.findings, self.functions))
        return migration.migration_summary(boundaries, self.overall, self.exposure)

    def products(self) -> Products:
        return Products(**{name: getattr(self, name) for name in Products.__dataclass_fields__})


def products_of(runs: DataFrame, functions: DataFrame, keep: Keep = _as_is) -> Products:
    """All products at once."""
    return Analysis(runs, functions, keep).products()


def fallback_products(repos: DataFrame) -> Products:
    """All products of repos(run_id, name) without source."""
    nodes, edges = fallback.fallback_workflow(repos)
    data_nodes, data_edges = fallback.fallback_lineage(repos)
    findings = fallback.fallback_risk(repos)
    overall = findings.select("run_id", F.col("score").alias("overall_score"))
    return Products(
        workflow_nodes=nodes,
        workflow_edges=edges,
        lineage_nodes=data_nodes,
        lineage_edges=data_edges,
        findings=findings,
        overall=overall,
        evidence=fallback.fallback_evidence(nodes, data_nodes),
        ontology=fallback.fallback_ontology(repos),
        migration=fallback.fallback_migration(repos, overall),
    )


def analyze(resolved: DataFrame, functions: DataFrame, keep: Keep = _as_is) -> Products:
    """Both paths in one result set.

    ``resolved(run_id, name, source_root)`` says where each run's source is; a null root
    takes the fallback path.  ``functions`` come from scanning those roots, so only runs
    with a source have any.
    """
    with_source = resolved.where(F.col("source_root").isNotNull()).select(
        "run_id", F.element_at(F.split(F.regexp_replace("source_root", "/+$", ""), "/"), -1).alias("root_name")
    )
    without = resolved.where(F.col("source_root").isNull()).select("run_id", "name")
    return products_of(with_source, functions, keep).union(fallback_products(without))
