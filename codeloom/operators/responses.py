"""Provider responses: JSON documents to clean, typed values.

A response is one row, so all work on its inner lists happens inside the row with
array expressions; nothing is exploded and grouped again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import coerce
from codeloom.functions import lexicons as lx
from codeloom.functions.text import blank_to_null, platform_label, strip
from codeloom.operators.ranking import ranked
from codeloom.session import stored

# Default texts (fixed values).
CITATION_REASON = "Dust citation"
UNTITLED = "Untitled source"
NO_SNIPPET = "No snippet provided."
GROUNDED_TITLE = "Referenced source"
GROUNDED_REASON = "Grounded web reference used by Gemini search."
DEFAULT_SUMMARY = "Relevant public discussions were found for comparison."

_VARIANTS = "array<variant>"
_REFERENCE = "struct<platform:string,title:string,url:string,snippet:string,why_relevant:string>"


# ---- trigger and poll documents ---------------------------------------------


def wrap_non_object(text: Column) -> Column:
    """JSON text as an object: anything else becomes ``{"result": ...}``; broken text is null."""
    wrapped = F.concat(F.lit('{"result":'), text, F.lit("}"))
    return coerce.bind(
        coerce.parse(text), lambda v: F.when(coerce.is_object(v), text).when(v.isNotNull(), wrapped)
    )


def response_object(text: Column) -> Column:
    """``wrap_non_object`` as VARIANT, parsing an object only once."""
    wrapped = coerce.read_variant(F.concat(F.lit('{"result":'), text, F.lit("}")))
    return coerce.bind(
        coerce.parse(text), lambda v: F.when(coerce.is_object(v), v).when(v.isNotNull(), wrapped)
    )


def infer_status(doc: Column) -> Column:
    """Status of a response object (VARIANT): the first matching word rule decides."""
    texts = [coerce.truthy_text(doc, f"$.{k}") for k in ("status", "state", "phase")]
    result = coerce.kind(coerce.at(doc, "$.result"))
    rules = lambda word: (
        F.when(word.rlike("fail|error"), F.lit("failed"))
        .when(word.rlike("done|success|complete") | (word == "ok"), F.lit("completed"))
        .when(word.rlike("queue|pend"), F.lit("queued"))
        .when(word.rlike("run|process"), F.lit("running"))
        .when(coerce.truthy_text(doc, "$.error").isNotNull(), F.lit("failed"))
        .when(F.coalesce(result != "VOID", F.lit(False)), F.lit("completed"))
        .otherwise(F.lit("running"))
    )
    return coerce.bind(F.lower(F.coalesce(*texts, F.lit(""))), rules)


def request_id(doc: Column) -> Column:
    """First non-empty of request_id, requestId, id and result.request_id."""
    paths = ["$.request_id", "$.requestId", "$.id", "$.result.request_id"]
    return F.coalesce(*[coerce.truthy_text(doc, p) for p in paths])


def trigger_status(status: Column, request: Column, async_mode: Column) -> Column:
    """An accepted asynchronous request is queued, whatever ``completed`` says."""
    return F.when(
        async_mode & request.isNotNull() & (status == "completed"), F.lit("queued")
    ).otherwise(status)


def trigger_responses(responses: DataFrame, async_mode: bool = True) -> DataFrame:
    """responses(request_key, body) to status and request id; broken bodies are ``invalid``."""
    parsed = responses.select("request_key", response_object(F.col("body")).alias("doc")).select(
        "request_key",
        F.when(F.col("doc").isNotNull(), infer_status(F.col("doc"))).alias("inferred"),
        request_id(F.col("doc")).alias("request_id"),
    )
    status = trigger_status(F.col("inferred"), F.col("request_id"), F.lit(async_mode))
    return parsed.select(
        "request_key", "request_id", F.coalesce(status, F.lit("invalid")).alias("status")
    )


def enrichment_rows(results: DataFrame) -> DataFrame:
    """results(run_id, result JSON text) to enrichment columns.

    Inner dictionaries which are not objects become ``{}``; an error text is merged
    into the quality checks; everything but the raw response is runtime data.
    """
    parsed = results.select("run_id", "result", coerce.parse(F.col("result")).alias("v"))
    v = F.col("v")
    as_map = lambda text: F.from_json(text, "map<string,string>")
    checks = as_map(coerce.to_object_json(v, "$.raw.quality_checks"))
    error = coerce.truthy_text(v, "$.error")
    with_error = F.map_concat(
        F.map_filter(checks, lambda k, _: k != "integration_error"),
        F.create_map(F.lit("integration_error"), error),
    )
    return parsed.select(
        "run_id",
        blank_to_null(coerce.text_at(v, "$.service_id")).alias("service_id"),
        blank_to_null(coerce.text_at(v, "$.request_id")).alias("request_id"),
        F.coalesce(coerce.truthy_text(v, "$.status"), F.lit("unknown")).alias("status"),
        coerce.to_object_json(v, "$.raw.ontology_enrichment").alias("ontology_enrichment"),
        coerce.to_object_json(v, "$.raw.migration_hints").alias("migration_hints"),
        F.to_json(F.when(error.isNotNull(), with_error).otherwise(checks)).alias("quality_checks"),
        F.map_filter(
            F.map_from_entries(coerce.last_of_keys(F.map_entries(as_map(F.col("result"))))), lambda k, _: k != "raw"
        ).alias("runtime"),
        coerce.to_object_json(v, "$.raw").alias("response"),
    )


# ---- answers ----------------------------------------------------------------


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """conversations(conversation_id, raw JSON text) to messages in branch order."""
    branches = F.try_variant_get(coerce.parse(F.col("raw")), "$.conversation.content", _VARIANTS)
    messages = F.flatten(
        F.transform(
            F.filter(branches, coerce.is_array), lambda b: F.try_variant_get(b, "$", _VARIANTS)
        )
    )
    return conversations.select("conversation_id", F.posexplode(messages).alias("pos", "m")).select(
        "conversation_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.try_variant_get("m", "$.type", "string").alias("kind"),
        F.when(
            coerce.kind(coerce.at(F.col("m"), "$.content")) == "STRING",
            F.try_variant_get("m", "$.content", "string"),
        ).alias("content"),
    )


def last_agent_message(messages: DataFrame, agent_kind: str = "agent_message") -> DataFrame:
    """Last non-blank agent text of messages(conversation_id, pos, kind, content)."""
    text = strip(F.col("content"))
    return (
        messages.where((F.col("kind") == agent_kind) & (text != ""))
        .groupBy("conversation_id")
        .agg(F.max_by(text, "pos").alias("answer"))
    )


def extract_json_object(text: Column, strict_arrays: bool = False) -> Column:
    """VARIANT object in a text: the whole text, else its first ``{`` to its last ``}``.

    With ``strict_arrays`` a text which is valid JSON but no object gives null at
    once; without it an object inside an array is still found.
    """
    inner = coerce.bind(
        coerce.parse(F.regexp_extract(text, r"(?s)\{.*\}", 0)), lambda v: F.when(coerce.is_object(v), v)
    )

    def choose(whole: Column) -> Column:
        salvaged = F.when(whole.isNull(), inner) if strict_arrays else inner
        return F.when(coerce.is_object(whole), whole).otherwise(salvaged)

    return coerce.bind(coerce.parse(text), choose)


def no_citations() -> Column:
    """Typed empty citation list."""
    return F.array().cast(
        "array<struct<file_path:string,symbol:string,reason:string,line_start:int,line_end:int>>"
    )


def normalise_citations(citations: Column, default_reason: str = CITATION_REASON) -> Column:
    """ARRAY<STRUCT> of a VARIANT array: defaults filled, non-objects dropped."""
    items = F.filter(F.try_variant_get(citations, "$", _VARIANTS), coerce.is_object)

    def line(item: Column, path: str) -> Column:
        value = coerce.at(item, path)
        number = F.when(coerce.is_number(value), F.try_variant_get(value, "$", "double").cast("int"))
        flag = F.when(coerce.kind(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int"))
        return F.coalesce(number, flag)

    def clean(item: Column) -> Column:
        get = lambda key: coerce.truthy_text(item, f"$.{key}")
        return F.struct(
            F.coalesce(get("file_path"), get("file"), F.lit("unknown")).alias("file_path"),
            F.coalesce(get("symbol"), F.lit("unknown")).alias("symbol"),
            F.coalesce(get("reason"), F.lit(default_reason)).alias("reason"),
            line(item, "$.line_start").alias("line_start"),
            line(item, "$.line_end").alias("line_end"),
        )

    return F.when(coerce.is_array(citations), F.transform(items, clean)).otherwise(no_citations())


def clean_string_list(items: Column) -> Column:
    """Texts of a VARIANT array without the blank ones; the kept ones are not stripped."""
    texts = F.transform(F.try_variant_get(items, "$", _VARIANTS), coerce.printed)
    return F.coalesce(F.filter(texts, lambda s: strip(s) != ""), lx.string_array([]))


# ---- web references ---------------------------------------------------------


def normalise_platforms(platforms: Column) -> Column:
    """Allowed platform names, distinct in order; nothing left gives the default pair."""
    names = F.transform(platforms, lambda p: F.lower(strip(p)))
    names = F.transform(names, lambda p: F.when(p == "twitter", F.lit("x")).otherwise(p))
    kept = F.array_distinct(F.filter(names, lambda p: p.isin(lx.PLATFORMS)))
    return F.when(F.size(kept) > 0, kept).otherwise(lx.string_array(lx.DEFAULT_PLATFORMS))


def _wanted(reference: Column, platforms: Column) -> Column:
    """HTTP references on a requested platform; ``other`` always passes."""
    web = reference["url"].rlike("^https?://")
    on_platform = (
        (F.size(platforms) == 0)
        | F.array_contains(platforms, reference["platform"])
        | (reference["platform"] == "other")
    )
    return web & on_platform


def first_per_url(references: Column) -> Column:
    """First reference of every URL in a list, order kept.

    The list is folded once.  A lambda over a second copy of the list would evaluate
    that copy, with all the parsing behind it, for each element.
    """
    none = F.array().cast(f"array<{_REFERENCE}>")
    return F.aggregate(
        references,
        none,
        lambda kept, r: F.when(F.exists(kept, lambda k: k["url"] == r["url"]), kept).otherwise(
            F.array_append(kept, r)
        ),
    )


def normalise_references(items: Column, platforms: Column) -> Column:
    """References of a VARIANT array of items: typed, filtered, one per URL."""

    def clean(item: Column) -> Column:
        get = lambda key: strip(F.coalesce(coerce.text_at(item, f"$.{key}"), F.lit("")))
        filled = lambda key, default: F.coalesce(F.nullif(get(key), F.lit("")), F.lit(default))
        return F.struct(
            platform_label(get("platform"), get("url")).alias("platform"),
            filled("title", UNTITLED).alias("title"),
            get("url").alias("url"),
            filled("snippet", NO_SNIPPET).alias("snippet"),
            get("why_relevant").alias("why_relevant"),
        )

    objects = F.filter(F.try_variant_get(items, "$", _VARIANTS), coerce.is_object)
    rows = F.filter(F.transform(objects, clean), lambda r: _wanted(r, platforms))
    return first_per_url(rows)


def grounding_references(raw: Column, platforms: Column) -> Column:
    """References from candidates -> grounding chunks -> web of a VARIANT response."""
    candidates = F.try_variant_get(raw, "$.candidates", _VARIANTS)
    chunks = F.flatten(
        F.transform(
            candidates,
            lambda c: F.coalesce(
                F.try_variant_get(c, "$.groundingMetadata.groundingChunks", _VARIANTS),
                F.array().cast(_VARIANTS),
            ),
        )
    )
    webs = F.filter(F.transform(chunks, lambda c: coerce.at(c, "$.web")), coerce.is_object)

    def clean(web: Column) -> Column:
        url = strip(F.coalesce(coerce.text_at(web, "$.uri"), F.lit("")))
        title = F.coalesce(blank_to_null(coerce.text_at(web, "$.title")), F.lit(GROUNDED_TITLE))
        return F.struct(
            platform_label(F.lit(""), url).alias("platform"),
            title.alias("title"),
            url.alias("url"),
            title.alias("snippet"),
            F.lit(GROUNDED_REASON).alias("why_relevant"),
        )

    rows = F.filter(F.transform(webs, clean), lambda r: _wanted(r, platforms))
    return first_per_url(rows)


def dedupe_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key of a table, by ``order``; cut per map task before the shuffle."""
    first = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def first_text_part(raw: Column) -> Column:
    """First non-blank text over candidates x parts of a VARIANT response, stripped."""
    candidates = F.try_variant_get(raw, "$.candidates", _VARIANTS)
    parts = F.flatten(
        F.transform(
            candidates,
            lambda c: F.coalesce(
                F.try_variant_get(c, "$.content.parts", _VARIANTS), F.array().cast(_VARIANTS)
            ),
        )
    )
    texts = F.transform(
        parts,
        lambda p: F.when(
            coerce.kind(coerce.at(p, "$.text")) == "STRING", strip(F.try_variant_get(p, "$.text", "string"))
        ),
    )
    return F.get(F.filter(texts, lambda t: t.isNotNull() & (t != "")), F.lit(0))


def reference_result(responses: DataFrame) -> DataFrame:
    """responses(request_id, raw JSON text, platforms, max_results) to status, summary, items.

    Listed items come first; only a response without usable ones falls back to its
    grounding data.
    """
    staged = (
        responses.withColumn("doc", coerce.parse(F.col("raw")))
        .withColumn("wanted", normalise_platforms(F.col("platforms")))
        .withColumn("parsed", extract_json_object(first_text_part(F.col("doc")), strict_arrays=True))
        .withColumn("listed", normalise_references(coerce.at(F.col("parsed"), "$.items"), F.col("wanted")))
        .withColumn("grounded", grounding_references(F.col("doc"), F.col("wanted")))
    )
    found = F.when(F.coalesce(F.size("listed"), F.lit(0)) > 0, F.col("listed")).otherwise(F.col("grounded"))
    items = F.slice(found, F.lit(1), F.col("max_results"))
    summary = blank_to_null(coerce.text_at(F.col("parsed"), "$.summary"))
    has_items = F.coalesce(F.size(items), F.lit(0)) > 0
    return staged.select(
        "request_id",
        F.when(has_items, F.lit("completed")).otherwise(F.lit("empty")).alias("status"),
        F.coalesce(summary, F.lit(DEFAULT_SUMMARY)).alias("summary"),
        items.alias("items"),
    )


# ---- provider probes --------------------------------------------------------


def _failure_text() -> Column:
    return F.concat("url", F.lit("->"), F.coalesce(F.nullif("detail", F.lit("")), F.lit("unreachable")))


def _joined_failures(rows: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """The texts of every key in order, as one text."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("text"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["text"]), "; ").alias(name))


def provider_readiness(probes: DataFrame, keys: list[str], listed: int = 1000) -> DataFrame:
    """Readiness per key of probes(*keys, ord, url, reachable, latency_ms, detail).

    The fastest reachable probe is shown, where a latency of 0 sorts as 10,000.  The
    detail of an unreachable provider lists its failures.  Failure texts are kept
    only for keys which turn out unreachable, one text per probe and in probe order.  A key
    with more than ``listed`` of them, by its counted size, is joined block by block: no list
    holds more than ``listed`` probes, or the blocks of one key.
    """
    speed = F.struct(
        F.coalesce(F.nullif("latency_ms", F.lit(0)), F.lit(10_000)).alias("ms"), F.col("ord")
    )
    best = stored(probes.groupBy(*keys).agg(
        F.bool_or("reachable").alias("reachable"),
        F.count("*").alias("probes"),
        F.min_by(
            F.struct("url", "latency_ms", "detail"), F.when(F.col("reachable"), speed)
        ).alias("best"),
    ))
    down = best.where(~F.col("reachable"))
    few, many = (down.where(size).select(*keys) for size in (F.col("probes") <= listed, F.col("probes") > listed))
    texts = probes.select(*keys, "ord", _failure_text().alias("text"))
    failures = _joined_failures(texts.join(few, keys, "left_semi"), keys, "ord", "failures")
    if not many.isEmpty():
        placed = ranked(texts.join(many, keys, "left_semi"), keys, ["ord"], "place")
        blocks = placed.withColumn("block", F.floor((F.col("place") - 1) / listed))
        blocks = _joined_failures(blocks, [*keys, "block"], "place", "text")
        failures = failures.unionByName(_joined_failures(blocks, keys, "block", "failures"))
    good = F.coalesce(F.nullif("best.detail", F.lit("")), F.concat(F.lit("ok:"), F.col("best.url")))
    return best.join(failures, keys, "left").select(
        *keys,
        "reachable",
        F.col("best.latency_ms").alias("latency_ms"),
        F.when(F.col("reachable"), good).otherwise(F.col("failures")).alias("detail"),
    )


def probe_failures(probes: DataFrame, keys: list[str]) -> DataFrame:
    """The failures of unreachable providers as rows, for providers with very many probes."""
    up = probes.where("reachable").select(*keys).distinct()
    return probes.join(up, keys, "left_anti").select(*keys, "ord", _failure_text().alias("failure"))


def single_probe_detail(detail: Column) -> Column:
    """Detail of a provider with one fixed address: the probe's own text, else ``ok``."""
    return F.coalesce(F.nullif(detail, F.lit("")), F.lit("ok"))


def configured_readiness(providers: DataFrame, checked: DataFrame, keys: list[str]) -> DataFrame:
    """Readiness of every provider, also those which are not configured or have no probe.

    ``providers(*keys, provider, configured)``; a configured one without any probe counts
    as reachable.
    """
    probed = F.col("reachable").isNotNull()
    missing = F.when(F.col("provider") == "mcp", F.lit("mcp_config_missing")).otherwise(
        F.concat("provider", F.lit("_not_configured"))
    )
    return providers.join(checked, keys, "left").select(
        *keys,
        "provider",
        "configured",
        (F.col("configured") & F.coalesce("reachable", F.lit(True))).alias("reachable"),
        F.when(F.col("configured"), F.col("latency_ms")).alias("latency_ms"),
        F.when(~F.col("configured"), missing)
        .when(probed, F.col("detail"))
        .otherwise(F.lit("mcp_config_loaded_no_http_probe"))
        .alias("detail"),
    )


def server_listing(configs: DataFrame) -> DataFrame:
    """One row per server of configs(config_id, raw JSON text): its url, its command, whether
    it has headers, and their sorted names; never a header's value.

    A text which is no JSON object, or has no servers, gives no row.
    """
    servers = coerce.at(coerce.parse(F.col("raw")), "$.mcpServers")
    names = F.from_json(F.when(coerce.is_object(servers), F.to_json(servers)), "map<string,string>")
    rows = configs.select("config_id", F.explode(names).alias("server", "body"))
    doc = coerce.parse(F.col("body"))
    rows = rows.select("config_id", "server", doc.alias("doc")).where(coerce.is_object(F.col("doc")))
    headers = coerce.at(F.col("doc"), "$.headers")
    keys = F.map_keys(F.from_json(F.when(coerce.is_object(headers), F.to_json(headers)), "map<string,string>"))
    return rows.select(
        "config_id", "server", coerce.text_at(F.col("doc"), "$.url").alias("url"), coerce.text_at(F.col("doc"), "$.command").alias("command"),
        headers.isNotNull().alias("has_headers"), F.array_sort(F.coalesce(keys, lx.string_array([]))).alias("header_keys"),
    )
