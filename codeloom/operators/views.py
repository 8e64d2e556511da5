"""Derived views over findings, evidence and enrichment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import coerce
from codeloom.functions import lexicons as lx
from codeloom.functions.text import display_class, entity_from_text, humanise_label, modules_of_files


# ---- findings ---------------------------------------------------------------


def findings_view(findings: DataFrame, severity: str | None = None) -> DataFrame:
    """Findings by run and falling score, optionally of one severity."""
    chosen = findings if severity is None else findings.where(F.col("severity") == severity)
    return chosen.orderBy("run_id", F.col("score").desc(), "finding_ord")


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per run and severity, with the total."""
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in lx.SEVERITIES]
    return findings.groupBy("run_id").agg(*counts, F.count("*").alias("total"))


def category_counts(findings: DataFrame) -> DataFrame:
    """Findings per run and category, zero filled; unknown categories are ignored."""
    counts = [F.count_if(F.col("category") == c).alias(c) for c in lx.RISK_CATEGORIES]
    wide = findings.groupBy("run_id").agg(*counts)
    rows = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(c).alias("findings")) for c in lx.RISK_CATEGORIES]
    )
    return wide.select("run_id", F.inline(rows))


def distinct_categories(findings: DataFrame) -> DataFrame:
    return findings.groupBy("run_id").agg(F.count_distinct("category").alias("categories"))


# ---- nodes and evidence -----------------------------------------------------


def neighbours(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct other ends of the edges at requests(run_id, node_id)."""
    both = edges.where(F.col("source") != F.col("target")).select(
        "run_id",
        F.inline(
            F.array(
                F.struct(F.col("source").alias("node_id"), F.col("target").alias("neighbour")),
                F.struct(F.col("target").alias("node_id"), F.col("source").alias("neighbour")),
            )
        ),
    )
    return both.join(requests.select("run_id", "node_id").distinct(), ["run_id", "node_id"], "left_semi").distinct()


def findings_for_node(nodes: DataFrame, evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings whose symbol is in a node's evidence, or equals its label or id.

    Written as an equality join on the candidate symbols.  Nodes without evidence have
    no findings.
    """
    wanted = (
        nodes.select("run_id", "node_id", "label")
        .join(evidence.select("run_id", "node_id", "symbols"), ["run_id", "node_id"])
        .select(
            "run_id",
            "node_id",
            F.explode(F.array_distinct(F.concat("symbols", F.array("label", "node_id")))).alias("symbol"),
        )
    )
    return wanted.join(findings, ["run_id", "symbol"]).select(
        "run_id", "node_id", "finding_id", "symbol", "score"
    )


def symbol_node_index(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Symbol to node over the evidence of a graph; the last node wins."""
    rows = nodes.select("run_id", "node_id", "node_ord").join(
        evidence.select("run_id", "node_id", F.explode("symbols").alias("symbol")), ["run_id", "node_id"]
    )
    return rows.groupBy("run_id", "symbol").agg(F.max_by("node_id", "node_ord").alias("node_id"))


def node_display_name(nodes: DataFrame, evidence: DataFrame, graph: str) -> DataFrame:
    """Readable name per node; nodes without evidence keep their (readable) label."""
    joined = nodes.select("run_id", "node_id", "label").join(evidence, ["run_id", "node_id"], "left")
    if graph == "lineage":
        name = F.coalesce(entity_from_text(F.col("explanation")), humanise_label(F.col("label")))
    else:
        first = F.nullif(F.get("symbols", F.lit(0)), F.lit(""))
        name = F.coalesce(humanise_label(display_class(first)), humanise_label(F.col("label")))
    return joined.select("run_id", "node_id", name.alias("display_name"))


def modules_of_evidence(evidence: DataFrame) -> DataFrame:
    return evidence.select("run_id", "node_id", F.explode(modules_of_files(F.col("files"))).alias("module"))


def module_count(evidence: DataFrame) -> DataFrame:
    return modules_of_evidence(evidence).groupBy("run_id").agg(F.count_distinct("module").alias("modules"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge count per run and graph."""
    n = nodes.groupBy("run_id", "graph").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("run_id", "graph").agg(F.count("*").alias("edges"))
    return n.join(e, ["run_id", "graph"], "left").na.fill(0, ["edges"])


# ---- enrichment and blueprint displays --------------------------------------


def enrichment_state(status: Column) -> Column:
    """available / running / unavailable / other from the status text (null: unavailable)."""
    return (
        F.when(status == "completed", F.lit("available"))
        .when(status.isin("queued", "running"), F.lit("running"))
        .when(status.isNull() | status.isin("not_configured", "failed", "error"), F.lit("unavailable"))
        .otherwise(F.lit("other"))
    )


def _display_order(entries: Column) -> Column:
    """Keys as the display orders them: whole numbers first and ascending, then the others
    in document order; a repeated key has its last value."""
    number = lambda e: e["key"].rlike("^(0|[1-9][0-9]{0,8})$")
    by_number = lambda a, b: a["key"].cast("int") - b["key"].cast("int")
    return coerce.bind(
        coerce.last_of_keys(entries),
        lambda own: F.concat(F.array_sort(F.filter(own, number), by_number), F.filter(own, lambda e: ~number(e))),
    )


def _entries(text: Column) -> Column:
    """Entries of a JSON object in display order, values as VARIANT."""
    return _display_order(F.map_entries(F.from_json(text, "map<string,variant>")))


def _text_entries(text: Column) -> Column:
    """Entries of a JSON object in display order, values as JSON text (strings bare)."""
    return _display_order(F.map_entries(F.from_json(text, "map<string,string>")))


def _scalar(value: Column) -> Column:
    """Printed scalar; a whole number has no decimals."""
    text = F.try_variant_get(value, "$", "string")
    plain = F.regexp_replace(text, r"\.0+$", "")
    return F.when(coerce.is_number(value), plain).otherwise(text)


def _shown(value: Column) -> Column:
    """A JSON value the way the display prints it: lists joined by commas."""
    items = F.transform(
        F.try_variant_get(value, "$", "array<variant>"), lambda v: F.coalesce(_scalar(v), F.lit(""))
    )
    return (
        F.when(coerce.is_array(value), F.array_join(items, ","))
        .when(coerce.is_object(value), F.lit("[object Object]"))
        .otherwise(F.coalesce(_scalar(value), F.lit("null")))
    )


def _passes(value: Column) -> Column:
    """Display truth: any list or object is true."""
    container = coerce.is_array(value) | coerce.is_object(value)
    return container | coerce.truthy(value)


def _printed(value: Column) -> Column:
    return F.coalesce(value, F.lit("null"))


def enrichment_pairs(enrichment: DataFrame) -> DataFrame:
    """Display rows of enrichment(run_id, ontology_enrichment, migration_hints, quality_checks).

    The first eight ontology entries, all hints as ``key: value`` and all checks with
    their result.  Lists are accepted for hints and checks.
    """
    array_of = lambda c: F.try_variant_get(coerce.parse(F.col(c)), "$", "array<variant>")
    row = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    nothing = F.lit(None).cast("string")

    ontology = F.transform(
        F.slice(_text_entries(F.col("ontology_enrichment")), 1, 8),
        lambda e: row(e["key"], _printed(e["value"])),
    )
    hints = F.coalesce(
        F.transform(array_of("migration_hints"), lambda v: row(_shown(v), nothing)),
        F.transform(
            _entries(F.col("migration_hints")),
            lambda e: row(F.concat(e["key"], F.lit(": "), _shown(e["value"])), nothing),
        ),
    )

    def check(item: Column) -> Column:
        text = lambda k: F.try_variant_get(item, f"$.{k}", "string")
        given = lambda k: F.when(
            coerce.kind(coerce.at(item, f"$.{k}")) != "VOID", _passes(coerce.at(item, f"$.{k}"))
        )
        label = F.coalesce(text("name"), text("label"), text("check"), F.lit("Check"))
        passed = F.coalesce(given("passed"), given("pass"), text("status") == "pass", F.lit(False))
        is_object = coerce.is_object(item)
        return row(
            F.when(is_object, label).otherwise(_shown(item)),
            F.when(is_object, passed).otherwise(F.lit(True)).cast("string"),
        )

    checks = F.coalesce(
        F.transform(array_of("quality_checks"), check),
        F.transform(
            _entries(F.col("quality_checks")),
            lambda e: row(e["key"], _passes(e["value"]).cast("string")),
        ),
    )
    sections = F.array(
        F.struct(F.lit("ontology").alias("section"), ontology.alias("rows")),
        F.struct(F.lit("hint").alias("section"), hints.alias("rows")),
        F.struct(F.lit("check").alias("section"), checks.alias("rows")),
    )
    return (
        enrichment.select("run_id", F.inline(sections))
        .select("run_id", "section", F.posexplode("rows").alias("ord", "row"))
        .select("run_id", "section", "ord", "row.*")
    )


def node_ontology(nodes: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Entries of the ontology enrichment of each node, found by label, else by id."""
    joined = nodes.select("run_id", "node_id", "label").join(
        enrichment.select("run_id", F.from_json("ontology_enrichment", "map<string,string>").alias("m")), "run_id"
    )
    entry = F.coalesce(F.col("m")[F.col("label")], F.col("m")[F.col("node_id")])
    return joined.select("run_id", "node_id", F.posexplode(_entries(entry)).alias("ord", "e")).select(
        "run_id", "node_id", "ord", F.col("e.key").alias("key"), _shown(F.col("e.value")).alias("value")
    )


def blueprint_rows(blueprints: DataFrame) -> DataFrame:
    """Display rows of blueprints(run_id, doc JSON text): boundaries, routing and top risks.

    Several alias keys are accepted per field.
    """
    doc = coerce.parse(F.col("doc"))

    def listed(path: str) -> Column:
        return F.try_variant_get(doc, path, "array<variant>")

    def first_of(item: Column, *keys: str) -> Column:
        return F.coalesce(*[F.try_variant_get(item, f"$.{k}", "string") for k in keys], F.lit(""))

    def entities(item: Column) -> Column:
        names = F.try_variant_get(item, "$.required_entities", "array<string>")
        return F.coalesce(F.array_join(names, ", "), first_of(item, "required_entities"))

    pair = lambda a, b: F.struct(a.alias("title"), b.alias("detail"))
    boundaries = F.transform(
        listed("$.extraction_boundaries"),
        lambda b: pair(first_of(b, "anchor_symbol", "anchor", "symbol"), entities(b)),
    )
    risks = F.transform(
        listed("$.top_risks"),
        lambda r: pair(first_of(r, "title", "risk", "description"), first_of(r, "detail", "rationale", "impact")),
    )
    nothing = F.lit(None).cast("string")
    routing_list = F.transform(
        listed("$.integration_routing"),
        lambda v: pair(_shown(v), nothing),
    )
    routing_map = F.transform(
        _entries(F.get_json_object("doc", "$.integration_routing")),
        lambda e: pair(F.concat(e["key"], F.lit(": "), _shown(e["value"])), nothing),
    )
    sections = F.array(
        F.struct(F.lit("boundary").alias("section"), boundaries.alias("rows")),
        F.struct(F.lit("routing").alias("section"), F.coalesce(routing_list, routing_map).alias("rows")),
        F.struct(F.lit("risk").alias("section"), risks.alias("rows")),
    )
    return (
        blueprints.select("run_id", F.inline(sections))
        .select("run_id", "section", F.posexplode("rows").alias("ord", "row"))
        .select("run_id", "section", "ord", "row.*")
    )
