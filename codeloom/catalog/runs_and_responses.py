"""Queries: run state, polling, provider responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import adapters as ad
from codeloom.catalog.registry import query
from codeloom.functions import coerce
from codeloom.functions.text import platform_label
from codeloom.operators import responses, runs
from codeloom.session import scratch_path
from codeloom.streaming import run_state

_TICK = """user_id AS run_id, event_id AS seq, ts, event_type AS step, value - 50 AS pct,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
  CASE event_type WHEN 'error' THEN props END AS error"""

_STATE_SQL = f"""
    WITH t AS (SELECT {_TICK} FROM events)
    SELECT run_id, last(status ORDER BY seq) AS status, last(step ORDER BY seq) AS current_step,
      greatest(0e0, least(100e0, last(pct ORDER BY seq))) AS progress_pct,
      (array_agg(error ORDER BY seq))[-1] AS error_message,
      strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
      strftime(max(ts) FILTER (status <> 'running'), '%Y-%m-%d %H:%M:%S.%f') AS finished_at
    FROM t GROUP BY 1"""


def _state_rows(state):
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)
    return state.select(
        "run_id", "status", "current_step", "progress_pct", "error_message", stamp("started_at"), stamp("finished_at")
    )


@query("J1_latest_run_state", _STATE_SQL)
def latest_state(spark, sf_dir):
    ticks = ad.table(spark, sf_dir, "events").selectExpr(*_split(_TICK))
    return _state_rows(runs.latest_run_state(ticks))


def _split(text):
    """Top-level comma split of a select list."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(text[start:i])
            start = i + 1
    return [p.strip() for p in [*parts, text[start:]]]


@query("J2_latest_run_state_stream", _STATE_SQL)
def streamed_state(spark, sf_dir):
    schema = ad.table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    table = scratch_path(spark, "run-state")
    started = run_state.start_run_state(
        source.selectExpr(*_split(_TICK)), table, scratch_path(spark, "run-state-checkpoint")
    )
    started.awaitTermination()
    return _state_rows(run_state.read_run_state(spark, table))


_STEP = """CASE o_orderpriority WHEN '1-URGENT' THEN 'parsing-python-ast' WHEN '2-HIGH' THEN 'resolving-source'
  WHEN '3-MEDIUM' THEN 'fallback-analysis' WHEN '4-NOT SPECIFIED' THEN 'queued' ELSE 'persisting-artifacts' END"""


@query("J3_step_progress_map", """
    SELECT o_orderkey AS run_id, CASE o_orderpriority WHEN '1-URGENT' THEN 35e0 WHEN '2-HIGH' THEN 15e0
      WHEN '3-MEDIUM' THEN 55e0 WHEN '5-LOW' THEN 85e0 END AS pct FROM orders""")
def step_progress(spark, sf_dir):
    steps = ad.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS run_id", f"{_STEP} AS step")
    return steps.select("run_id", runs.step_progress(F.col("step")).alias("pct"))


@query("J4_step_status_matrix", """
    WITH s(step_no, step) AS (VALUES (0, 'ingesting'), (1, 'parsing-python-ast'), (2, 'building-graphs'),
        (3, 'persisting-artifacts'), (4, 'completed'))
    SELECT o_orderkey AS run_id, step_no, step, CASE WHEN o_orderstatus = 'F' THEN 'completed'
      ELSE CASE o_orderpriority
        WHEN '1-URGENT' THEN ['completed', 'active', 'pending', 'pending', 'pending']
        WHEN '2-HIGH' THEN ['active', 'pending', 'pending', 'pending', 'pending']
        WHEN '3-MEDIUM' THEN ['completed', 'completed', 'active', 'pending', 'pending']
        WHEN '4-NOT SPECIFIED' THEN ['pending', 'pending', 'pending', 'pending', 'pending']
        ELSE ['completed', 'completed', 'completed', 'active', 'pending'] END[step_no + 1] END AS state
    FROM orders CROSS JOIN s""")
def step_matrix(spark, sf_dir):
    table = ad.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id", "if(o_orderstatus = 'F', 'completed', 'running') AS status", f"{_STEP} AS current_step"
    )
    return runs.step_status_matrix(table)


@query("J5_merge_summary", """
    SELECT o_orderkey AS run_id, 'a=' || CASE o_orderstatus WHEN 'F' THEN 'new' WHEN 'O' THEN 'null' ELSE 'old' END
      || '|b=' || o_custkey || CASE WHEN o_orderstatus = 'P' THEN '' ELSE '|c=' || o_orderpriority END AS merged FROM orders""")
def merged(spark, sf_dir):
    base = F.expr("map('a', 'old', 'b', cast(o_custkey AS string))")
    patch = F.expr(
        """CASE o_orderstatus WHEN 'F' THEN map('a', 'new', 'c', o_orderpriority)
             WHEN 'O' THEN map('a', cast(null AS string), 'c', o_orderpriority) ELSE cast(map() AS map<string,string>) END"""
    )
    entries = F.array_sort(F.map_entries(runs.merge_summary(base, patch)))
    text = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.array_join(text, "|").alias("merged"))


_POLL = """l_orderkey AS request_id, l_linenumber AS attempt,
  CASE l_returnflag WHEN 'R' THEN 'completed' WHEN 'A' THEN 'failed' ELSE 'running' END AS status"""


@query("J6_poll_fold", f"""
    WITH p AS (SELECT {_POLL} FROM lineitem),
    e AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY attempt, status) AS place FROM p
      WHERE status <> 'running' AND attempt <= 4)
    SELECT r.request_id, coalesce(status, 'running') AS status, coalesce(attempt, 4) AS poll_attempts
    FROM (SELECT DISTINCT request_id FROM p) r LEFT JOIN e ON e.request_id = r.request_id AND place = 1""")
def polls(spark, sf_dir):
    return runs.poll_fold(ad.table(spark, sf_dir, "lineitem").selectExpr(*_split(_POLL)), max_attempts=4)


@query("J7_hook_outcome", """
    SELECT o_orderkey AS run_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'disabled'
        WHEN o_orderpriority = '2-HIGH' THEN 'not_configured' WHEN o_orderpriority = '3-MEDIUM' THEN 'skipped'
        WHEN o_custkey % 5 = 0 THEN 'error' WHEN o_orderstatus = 'F' THEN 'completed'
        WHEN o_orderstatus = 'P' THEN 'queued' WHEN o_custkey % 5 = 1 THEN 'running' ELSE 'failed' END AS status,
      CASE WHEN o_orderpriority < '4' OR o_custkey % 5 = 0 OR o_orderstatus <> 'O' THEN 0
        WHEN o_custkey % 5 = 1 THEN 0 ELSE 3 END AS poll_attempts,
      CASE WHEN o_orderpriority = '3-MEDIUM' THEN 'run_not_found'
        WHEN o_orderpriority >= '4' AND o_custkey % 5 = 0 THEN 'boom' END AS error
    FROM orders""")
def hooks(spark, sf_dir):
    table = ad.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id",
        "o_orderpriority <> '1-URGENT' AS enabled",
        "o_orderpriority <> '2-HIGH' AS configured",
        "o_orderpriority <> '3-MEDIUM' AS run_found",
        "if(o_custkey % 5 = 0, 'boom', null) AS error",
        "if(o_orderstatus = 'F', 'completed', 'queued') AS trigger_status",
        "if(o_orderstatus = 'P', null, concat('q-', o_orderkey)) AS request_id",
        "if(o_custkey % 5 = 1, null, 'failed') AS poll_status",
        "if(o_custkey % 5 = 1, null, 3) AS poll_attempts",
    )
    return runs.hook_outcome(table)


@query("J8_normalise_counters", """
    SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'ast-local' ELSE 'fallback' END AS analysis_mode,
      CASE o_orderpriority WHEN '1-URGENT' THEN o_custkey WHEN '2-HIGH' THEN o_custkey WHEN '3-MEDIUM' THEN o_custkey ELSE 0 END AS workflow_nodes,
      CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS files_scanned,
      CASE WHEN o_orderstatus = 'O' THEN '{"a":1}' ELSE '{}' END AS ontology
    FROM orders""")
def normalised(spark, sf_dir):
    doc = F.expr(
        """concat('{"analysis_mode": ', CASE o_orderstatus WHEN 'F' THEN '"ast-local"' WHEN 'O' THEN '""' ELSE 'null' END,
             ', "workflow_nodes": ', CASE o_orderpriority WHEN '1-URGENT' THEN cast(o_custkey AS string)
               WHEN '2-HIGH' THEN concat('" ', o_custkey, ' "') WHEN '3-MEDIUM' THEN concat(o_custkey, '.7')
               WHEN '4-NOT SPECIFIED' THEN '"7.9"' ELSE '[1]' END,
             ', "files_scanned": ', if(o_orderstatus = 'P', 'true', 'false'),
             ', "ontology": ', if(o_orderstatus = 'O', '{"a": 1}', '[1, 2]'), '}')"""
    )
    table = ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), doc.alias("summary"))
    return runs.normalise_counters(table).select("run_id", "analysis_mode", "workflow_nodes", "files_scanned", "ontology")


@query("J9_artifact_readiness", """
    WITH a AS (SELECT o_custkey AS run_id, bool_or(o_orderpriority = '1-URGENT') AS w, bool_or(o_orderpriority = '2-HIGH') AS l,
        bool_or(o_orderpriority = '3-MEDIUM') AS r,
        coalesce(max(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 9 ELSE 0 END), 0) AS n FROM orders GROUP BY 1),
    q AS (SELECT c_custkey AS run_id, c_acctbal >= 0 AS known, unnest(['answer', 'blueprint']) AS purpose FROM customer)
    SELECT run_id * 2 + (purpose = 'blueprint')::INT AS request_id, run_id, purpose, CASE WHEN NOT known THEN 'RUN_NOT_FOUND'
      WHEN purpose = 'blueprint' THEN CASE WHEN coalesce(l AND r, false) THEN 'OK' ELSE 'MIGRATION_ARTIFACTS_NOT_READY' END
      WHEN NOT coalesce(w AND r, false) THEN 'SEMANTIC_ARTIFACTS_NOT_READY' WHEN n = 0 THEN 'EMPTY_WORKFLOW_GRAPH' ELSE 'OK' END AS outcome
    FROM q LEFT JOIN a USING (run_id)""")
def ready(spark, sf_dir):
    known = ad.table(spark, sf_dir, "customer").where("c_acctbal >= 0").selectExpr("c_custkey AS run_id")
    stored = ad.table(spark, sf_dir, "orders").selectExpr(
        "o_custkey AS run_id",
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'workflow' WHEN '2-HIGH' THEN 'lineage' WHEN '3-MEDIUM' THEN 'risk' ELSE 'evidence' END AS kind",
        "if(o_orderstatus = 'F', 9, 0) AS size",
    )
    asked = ad.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS run_id", "posexplode(array('answer', 'blueprint')) AS (n, purpose)"
    ).selectExpr("run_id * 2 + n AS request_id", "run_id", "purpose")
    return runs.artifact_readiness(asked, known, stored)


# ---- provider responses -----------------------------------------------------

_BODY = """CASE o_orderpriority
  WHEN '1-URGENT' THEN concat('{"status": "', CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'OK' ELSE 'Pending' END,
    '", "request_id": "r-', o_orderkey, '"}')
  WHEN '2-HIGH' THEN concat('{"status": "", "state": "', CASE o_orderstatus WHEN 'F' THEN 'error: x' WHEN 'O' THEN 'incomplete' ELSE 'Processing' END,
    '", "requestId": "q-', o_orderkey, '"}')
  WHEN '3-MEDIUM' THEN concat('{"phase": "', CASE o_orderstatus WHEN 'F' THEN 'queued' WHEN 'O' THEN 'done' ELSE 'run' END,
    '", "result": {"request_id": "n-', o_orderkey, '"}}')
  WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN concat('{"error": "boom", "id": "i-', o_orderkey, '"}')
    WHEN 'O' THEN '{"result": [1, 2]}' ELSE '{"result": null, "error": ""}' END
  ELSE CASE o_orderstatus WHEN 'F' THEN '[1, 2]' WHEN 'O' THEN '"text"' ELSE concat('not json ', o_orderkey) END END"""

_STATUS_SQL = """CASE o_orderpriority
  WHEN '1-URGENT' THEN CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'queued' END
  WHEN '2-HIGH' THEN CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END
  WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'queued' WHEN 'O' THEN 'completed' ELSE 'running' END
  WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'completed' ELSE 'running' END
  ELSE CASE o_orderstatus WHEN 'P' THEN NULL ELSE 'completed' END END"""

_ID_SQL = """CASE o_orderpriority WHEN '1-URGENT' THEN 'r-' || o_orderkey WHEN '2-HIGH' THEN 'q-' || o_orderkey
  WHEN '3-MEDIUM' THEN 'n-' || o_orderkey WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'i-' || o_orderkey END END"""


def _bodies(spark, sf_dir):
    return ad.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_key", f"{_BODY} AS body")


def _documents(spark, sf_dir):
    return _bodies(spark, sf_dir).select("request_key", responses.response_object(F.col("body")).alias("doc"))


@query("N1_infer_status", f"SELECT o_orderkey AS request_key, coalesce({_STATUS_SQL}, 'none') AS status FROM orders")
def statuses(spark, sf_dir):
    status = F.when(F.col("doc").isNotNull(), responses.infer_status(F.col("doc")))
    return _documents(spark, sf_dir).select("request_key", F.coalesce(status, F.lit("none")).alias("status"))


@query("N2_request_id", f"SELECT o_orderkey AS request_key, {_ID_SQL} AS request_id FROM orders")
def request_ids(spark, sf_dir):
    return _documents(spark, sf_dir).select("request_key", responses.request_id(F.col("doc")).alias("request_id"))


@query("N3_trigger_status", f"""
    SELECT o_orderkey AS request_key, {_ID_SQL} AS request_id,
      coalesce(CASE WHEN {_ID_SQL} IS NOT NULL AND {_STATUS_SQL} = 'completed' THEN 'queued' ELSE {_STATUS_SQL} END, 'invalid') AS status FROM orders""")
def triggers(spark, sf_dir):
    return responses.trigger_responses(_bodies(spark, sf_dir))


@query("N4_wrap_non_object", """
    SELECT o_orderkey AS request_key, CASE WHEN o_orderpriority = '5-LOW' THEN CASE o_orderstatus WHEN 'F' THEN '{"result":[1, 2]}'
      WHEN 'O' THEN '{"result":"text"}' END WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O' THEN '{"result": [1, 2]}'
      ELSE 'object' END AS wrapped FROM orders""")
def wrapped(spark, sf_dir):
    text = responses.wrap_non_object(F.col("body"))
    short = F.when(text.startswith('{"result":') & ~text.contains("null"), text).when(text.isNotNull(), F.lit("object"))
    return _bodies(spark, sf_dir).select("request_key", short.alias("wrapped"))


@query("N5_enrichment_rows", """
    SELECT o_orderkey AS run_id, 'svc' AS service_id, CASE o_orderstatus WHEN 'F' THEN NULL ELSE 'q' || o_orderkey END AS request_id,
      CASE o_orderpriority WHEN '5-LOW' THEN 'unknown' ELSE 'completed' END AS status,
      CASE o_orderstatus WHEN 'P' THEN '{}' ELSE '{"k":' || o_custkey || '}' END AS ontology_enrichment,
      '{' || CASE o_orderstatus WHEN 'P' THEN '' ELSE '"lint":"true"' END
        || CASE WHEN o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT' THEN ',' ELSE '' END
        || CASE o_orderpriority WHEN '1-URGENT' THEN '"integration_error":"boom"' ELSE '' END || '}' AS quality_checks,
      o_orderpriority <> '1-URGENT' AS runtime_clean
    FROM orders""")
def enrichment(spark, sf_dir):
    doc = F.expr(
        """concat('{"service_id": " svc ", "request_id": ', if(o_orderstatus = 'F', '" "', concat('"q', o_orderkey, '"')),
             ', "status": ', if(o_orderpriority = '5-LOW', 'null', '"completed"'),
             if(o_orderpriority = '1-URGENT', ', "error": "boom"', ''),
             ', "raw": ', if(o_orderstatus = 'P', '[1]',
               concat('{"ontology_enrichment": {"k": ', o_custkey, '}, "migration_hints": 7, "quality_checks": {"lint": true}}')), '}')"""
    )
    rows = responses.enrichment_rows(
        ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), doc.alias("result"))
    )
    clean = ~F.map_contains_key("runtime", "error") & ~F.map_contains_key("runtime", "raw")
    return rows.select(
        "run_id", "service_id", "request_id", "status", "ontology_enrichment", "quality_checks", clean.alias("runtime_clean")
    )


@query("N6_last_agent_message", """
    SELECT conv_id AS conversation_id, last(regexp_replace(text, '^\\s+|\\s+$', '', 'g') ORDER BY turn) AS answer FROM conversations
    WHERE role = 'assistant' AND trim(text) <> '' GROUP BY 1""")
def agent_messages(spark, sf_dir):
    messages = ad.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS conversation_id", "turn AS pos", "role AS kind", "text AS content"
    )
    return responses.last_agent_message(messages, "assistant")


@query("N7_extract_json_object", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN NULL ELSE 'k' || o_custkey END AS answer,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'k' || o_custkey WHEN '2-HIGH' THEN 'k' || o_custkey END AS strict_answer FROM orders""")
def json_objects(spark, sf_dir):
    text = F.expr(
        """CASE o_orderpriority WHEN '1-URGENT' THEN concat(' {"a": "k', o_custkey, '"}\\n')
             WHEN '2-HIGH' THEN concat('Here it is:\\n```{"a": "k', o_custkey, '",\\n "b": {"c": 1}}``` bye')
             WHEN '3-MEDIUM' THEN concat('[{"a": "k', o_custkey, '"}]')
             WHEN '4-NOT SPECIFIED' THEN concat('{"a": "k', o_custkey) ELSE ' ' END"""
    )
    get = lambda v: coerce.text_at(v, "$.a")
    return ad.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        get(responses.extract_json_object(text)).alias("answer"),
        get(responses.extract_json_object(text, strict_arrays=True)).alias("strict_answer"),
    )


@query("N8_normalise_citations", """
    SELECT o_orderkey, unnest([1, 2]) AS ord, unnest(['f' || o_custkey || '.py', CASE o_orderstatus WHEN 'F' THEN 'g.py' ELSE 'unknown' END]) AS file_path,
      unnest(['unknown', 's']) AS symbol, unnest(['Dust citation', 'why']) AS reason,
      unnest([o_custkey, NULL])::INT AS line_start, unnest([o_custkey + 1, NULL])::INT AS line_end
    FROM orders WHERE o_orderpriority <> '5-LOW'""")
def citations(spark, sf_dir):
    text = F.expr(
        """if(o_orderpriority = '5-LOW', '{"no": "list"}', concat('[{"file_path": "f', o_custkey, '.py", "symbol": "", "line_start": ', o_custkey,
             ', "line_end": ', o_custkey + 1, '.9}, "text", 7, {"file_path": "", ', if(o_orderstatus = 'F', '"file": "g.py", ', ''),
             '"symbol": "s", "reason": "why", "line_start": "12", "line_end": null}]'))"""
    )
    found = responses.normalise_citations(coerce.parse(text))
    return (
        ad.table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(found).alias("ord", "c"))
        .select("o_orderkey", (F.col("ord") + 1).alias("ord"), "c.*")
    )


@query("N9_clean_string_list", """
    SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN '' ELSE 'a | ' || o_custkey || '|7|True|1.0' END AS items FROM orders""")
def string_lists(spark, sf_dir):
    text = F.expr("""if(o_orderstatus = 'P', '"x"', concat('["a ", " ", " ', o_custkey, '", "", 7, true, 1.0]'))""")
    return ad.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(responses.clean_string_list(coerce.parse(text)), "|").alias("items")
    )


# Links of every kind, made from the page addresses.
_LINKS = """array(url, replace(url, 'example.com', 'reddit.com'), replace(url, 'example.org', 'X.com'),
  replace(url, 'example.net', 'netflix.com'), replace(url, 'http', 'ftp'))"""
_EXPLICIT = "CASE ord WHEN 3 THEN CASE lang WHEN 'en' THEN ' Twitter ' WHEN 'fr' THEN 'other' ELSE 'blog' END ELSE '' END"
_LANG = "regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1)"

_LINK_SQL = f"""
    p AS (SELECT page_id, url AS page_url, {_LANG} AS lang FROM pages),
    k AS (SELECT page_id, lang, unnest(range(5)) AS ord, unnest([page_url, replace(page_url, 'example.com', 'reddit.com'),
        replace(page_url, 'example.org', 'X.com'), replace(page_url, 'example.net', 'netflix.com'), replace(page_url, 'http', 'ftp')]) AS url FROM p),
    lab AS (SELECT *, CASE WHEN ord = 3 AND lang = 'en' THEN 'x' WHEN ord = 3 AND lang = 'fr' THEN 'other'
        WHEN ord = 1 AND contains(url, 'reddit.com/') THEN 'reddit' WHEN ord = 2 AND contains(url, 'X.com/') THEN 'x'
        WHEN ord = 3 AND contains(url, 'netflix.com/') THEN 'x' ELSE 'other' END AS platform FROM k)"""


def _links(spark, sf_dir):
    return (
        ad.table(spark, sf_dir, "pages")
        .selectExpr("page_id", f"{_LANG} AS lang", f"posexplode({_LINKS}) AS (ord, url)")
        .selectExpr("*", f"{_EXPLICIT} AS explicit")
    )


@query("N10_platform_label", f"WITH {_LINK_SQL} SELECT page_id, ord, url, platform FROM lab")
def platforms(spark, sf_dir):
    return _links(spark, sf_dir).select(
        "page_id", "ord", "url", platform_label(F.col("explicit"), F.col("url")).alias("platform")
    )


@query("N11_normalise_platforms", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'x|other' WHEN '2-HIGH' THEN 'reddit' WHEN '3-MEDIUM' THEN 'other|x|reddit'
      ELSE 'reddit|x' END AS platforms FROM orders""")
def platform_lists(spark, sf_dir):
    given = F.expr(
        """CASE o_orderpriority WHEN '1-URGENT' THEN array(' Twitter', 'X', 'other') WHEN '2-HIGH' THEN array('REDDIT', 'blog')
             WHEN '3-MEDIUM' THEN array('other', 'x ', 'reddit', 'x') WHEN '4-NOT SPECIFIED' THEN array('blog')
             ELSE cast(array() AS array<string>) END"""
    )
    return ad.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(responses.normalise_platforms(given), "|").alias("platforms")
    )


def _raw_responses(spark, sf_dir):
    """One search response per page: listed items for some languages, grounding for all."""
    item = """concat('{"platform": "', CASE i WHEN 3 THEN CASE lang WHEN 'en' THEN ' Twitter ' WHEN 'fr' THEN 'other' ELSE 'blog' END ELSE '' END,
      '", "url": " ', u, '", "title": "', if(i = 1, ' ', concat('t', i)), '", "why_relevant": "w"}')"""
    chunk = """concat('{"web": {"uri": "', u, '"', if(i = 1, '', concat(', "title": "t', i, ' "')), '}}')"""
    pages = ad.table(spark, sf_dir, "pages").selectExpr("page_id", f"{_LANG} AS lang", f"{_LINKS} AS links")
    listed = f"concat('{{\"items\": [', array_join(transform(links, (u, i) -> {item}), ', '), ', 5], \"summary\": \" s', page_id, ' \"}}')"
    docs = pages.selectExpr("page_id", "lang", "links", f"{listed} AS listed")
    quoted = "replace(replace(if(lang = 'en', concat('Sure: ', listed), if(lang = 'fr', listed, 'nothing found')), '\\\\', '\\\\\\\\'), '\"', '\\\\\"')"
    raw = f"""concat('{{"candidates": [7, {{"content": {{"parts": [{{"text": " "}}, {{"text": "', {quoted},
        '"}}]}}}}, {{"groundingMetadata": {{"groundingChunks": [3, ', array_join(transform(links, (u, i) -> {chunk}), ', '), ']}}}}]}}')"""
    return docs.selectExpr(
        "page_id AS request_id", "lang", "links", f"{raw} AS raw",
        "array('reddit', 'x') AS platforms", "2 + cast(page_id % 3 AS int) AS max_results",
    )


_WANTED = "ord < 4 AND platform IN ('reddit', 'x', 'other')"
_ITEM_SQL = f"""
    it AS (SELECT page_id AS request_id, lang, url, platform, ord, CASE ord WHEN 1 THEN 'Untitled source' ELSE 't' || ord END AS title
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY ord) AS copy FROM lab WHERE {{wanted}}) WHERE copy = 1)"""


@query("N12_normalise_references", f"""
    WITH {_LINK_SQL}, {_ITEM_SQL.format(wanted="ord < 4 AND platform IN ('x', 'other')")}
    SELECT request_id, ord, platform, title, url, 'No snippet provided.' AS snippet FROM it""")
def references(spark, sf_dir):
    item = """concat('{"platform": "', CASE i WHEN 3 THEN CASE lang WHEN 'en' THEN ' Twitter ' WHEN 'fr' THEN 'other' ELSE 'blog' END ELSE '' END,
      '", "url": " ', u, '", "title": "', if(i = 1, ' ', concat('t', i)), '", "snippet": ""}')"""
    items = f"concat('[', array_join(transform(links, (u, i) -> {item}), ', '), ', 5, \"x\"]')"
    pages = ad.table(spark, sf_dir, "pages").selectExpr("page_id AS request_id", f"{_LANG} AS lang", f"{_LINKS} AS links")
    found = responses.normalise_references(coerce.parse(F.expr(items)), F.array(F.lit("x")))
    rows = pages.select("request_id", "links", F.inline(found))
    return rows.select(
        "request_id", (F.array_position("links", F.col("url")) - 1).alias("ord"), "platform", "title", "url", "snippet"
    )


@query("N13_grounding_references", f"""
    WITH {_LINK_SQL}, g AS (SELECT *, CASE WHEN contains(lower(url), 'reddit.com/') THEN 'reddit'
        WHEN contains(lower(url), 'x.com/') THEN 'x' ELSE 'other' END AS plain FROM k),
    it AS (SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY ord) AS copy FROM g WHERE ord < 4)
    SELECT page_id AS request_id, plain AS platform, CASE ord WHEN 1 THEN 'Referenced source' ELSE 't' || ord END AS title, url
    FROM it WHERE copy = 1""")
def grounding(spark, sf_dir):
    raw = _raw_responses(spark, sf_dir)
    found = responses.grounding_references(coerce.parse(F.col("raw")), F.array(F.lit("reddit"), F.lit("x")))
    return raw.select("request_id", F.inline(found)).select("request_id", "platform", "title", "url")


@query("N14_dedupe_first", f"""
    WITH {_LINK_SQL} SELECT url, page_id, ord FROM (
      SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, ord) AS place FROM k) WHERE place = 1""")
def deduped(spark, sf_dir):
    return responses.dedupe_first(_links(spark, sf_dir), ["url"], ["page_id", "ord"]).select("url", "page_id", "ord")


@query("N15_reference_result", f"""
    WITH {_LINK_SQL}, {_ITEM_SQL.format(wanted=_WANTED)},
    listed AS (SELECT request_id, ord, platform, title, url FROM it WHERE lang IN ('en', 'fr')),
    g AS (SELECT page_id AS request_id, ord, CASE WHEN contains(lower(url), 'reddit.com/') THEN 'reddit' WHEN contains(lower(url), 'x.com/') THEN 'x'
        ELSE 'other' END AS platform, CASE ord WHEN 1 THEN 'Referenced source' ELSE 't' || ord END AS title, url,
        row_number() OVER (PARTITION BY page_id, url ORDER BY ord) AS copy FROM k WHERE ord < 4 AND lang NOT IN ('en', 'fr')),
    al AS (SELECT * FROM listed UNION ALL SELECT request_id, ord, platform, title, url FROM g WHERE copy = 1),
    ra AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ord) AS place FROM al)
    SELECT request_id, 'completed' AS status,
      CASE WHEN lang IN ('en', 'fr') THEN 's' || request_id ELSE 'Relevant public discussions were found for comparison.' END AS summary,
      place, platform, title, url
    FROM ra JOIN (SELECT page_id AS request_id, lang FROM p) USING (request_id) WHERE place <= 2 + request_id % 3""")
def reference_results(spark, sf_dir):
    found = responses.reference_result(_raw_responses(spark, sf_dir))
    return found.select("request_id", "status", "summary", F.posexplode("items").alias("at", "item")).select(
        "request_id", "status", "summary", (F.col("at") + 1).cast("bigint").alias("place"), "item.platform", "item.title", "item.url"
    )


@query("N16_first_text_part", f"""
    WITH {_LINK_SQL}, own AS (SELECT page_id, any_value(lang) AS lang, '{{"items": [' || string_agg('{{"platform": "' || {_EXPLICIT}
        || '", "url": " ' || url || '", "title": "' || CASE ord WHEN 1 THEN ' ' ELSE 't' || ord END || '", "why_relevant": "w"}}', ', ' ORDER BY ord)
        || ', 5], "summary": " s' || page_id || ' "}}' AS listed FROM k GROUP BY page_id)
    SELECT page_id AS request_id, CASE lang WHEN 'en' THEN 'Sure: ' || listed WHEN 'fr' THEN listed ELSE 'nothing found' END AS text FROM own""")
def first_texts(spark, sf_dir):
    text = responses.first_text_part(coerce.parse(F.col("raw")))
    return _raw_responses(spark, sf_dir).select("request_id", text.alias("text"))


_PROBE = """l_orderkey AS check_id, (l_partkey * 1000000 + l_suppkey) * 10 + l_linenumber AS ord, concat('http://s-', l_suppkey) AS url,
  l_returnflag = 'R' AND l_linestatus = 'O' AS reachable,
  CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN cast(l_quantity AS int) - 1 END AS latency_ms,
  CASE WHEN l_linenumber > 4 THEN 'http_500' WHEN l_linenumber > 2 THEN '' END AS detail"""


@query("N17_provider_readiness", f"""
    WITH pr AS (SELECT {_PROBE} FROM lineitem),
    b AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY coalesce(nullif(latency_ms, 0), 10000), ord) AS place FROM pr WHERE reachable),
    d AS (SELECT check_id, string_agg(url || '->' || coalesce(nullif(detail, ''), 'unreachable'), '; ' ORDER BY ord) AS f FROM pr GROUP BY 1)
    SELECT o_orderkey AS check_id, o_orderpriority <> '5-LOW' AS configured,
      o_orderpriority <> '5-LOW' AND (b.check_id IS NOT NULL OR d.check_id IS NULL) AS reachable,
      CASE WHEN o_orderpriority <> '5-LOW' THEN latency_ms END AS latency_ms,
      CASE WHEN o_orderpriority = '5-LOW' THEN 'mcp_config_missing' WHEN d.check_id IS NULL THEN 'mcp_config_loaded_no_http_probe'
        WHEN b.check_id IS NOT NULL THEN coalesce(nullif(detail, ''), 'ok:' || url) ELSE f END AS detail
    FROM orders LEFT JOIN b ON b.check_id = o_orderkey AND place = 1 LEFT JOIN d ON d.check_id = o_orderkey""")
def provider_readiness(spark, sf_dir):
    probes = ad.table(spark, sf_dir, "lineitem").selectExpr(*_split(_PROBE))
    providers = ad.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS check_id", "'mcp' AS provider", "o_orderpriority <> '5-LOW' AS configured"
    )
    checked = responses.provider_readiness(probes, ["check_id"])
    return responses.configured_readiness(providers, checked, ["check_id"]).drop("provider")


# ---- beyond the inventory: outcomes and listings --------------------------------


@query("J10_comparison_outcome", """
    SELECT o_orderkey AS request_id, o_custkey AS run_id,
      CASE WHEN c_custkey IS NULL THEN 404 WHEN o_orderstatus = 'F' THEN 502 WHEN o_orderstatus = 'P' THEN 502 ELSE 200 END AS code,
      CASE WHEN c_custkey IS NULL THEN 'RUN_NOT_FOUND' WHEN o_orderstatus IN ('F', 'P') THEN 'GEMINI_WEB_COMPARISON_FAILED' END AS detail,
      CASE WHEN c_custkey IS NULL THEN 'Run not found' WHEN o_orderstatus = 'F' THEN 'boom ' || o_orderkey WHEN o_orderstatus = 'P' THEN '' END AS message
    FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY') ON o_custkey = c_custkey""")
def comparison_outcomes(spark, sf_dir):
    """Runs of one market segment are unknown; some requests failed, and some have no result."""
    orders = ad.table(spark, sf_dir, "orders")
    requests = orders.selectExpr("o_orderkey AS request_id", "o_custkey AS run_id")
    known = ad.table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").selectExpr("c_custkey AS run_id")
    results = orders.where("o_orderstatus <> 'P'").selectExpr(
        "o_orderkey AS request_id", "if(o_orderstatus = 'F', concat('boom ', o_orderkey), null) AS error"
    )
    return runs.comparison_outcome(requests, known, results, "gemini")


@query("N18_server_listing", """
    SELECT o_orderkey AS config_id, s.server, CASE s.server WHEN 'docs' THEN 'http://d/' || o_custkey END AS url,
      CASE s.server WHEN 'run' THEN 'run-' || o_orderkey END AS command,
      s.server = 'docs' AND o_orderstatus <> 'O' AS has_headers,
      CASE WHEN s.server = 'docs' AND o_orderstatus = 'F' THEN 'Authorization,X-Key' ELSE '' END AS header_keys
    FROM orders CROSS JOIN (VALUES ('docs'), ('run')) s(server) WHERE o_orderpriority <> '5-LOW'""")
def servers(spark, sf_dir):
    raw = F.expr("""CASE WHEN o_orderpriority = '5-LOW' THEN if(o_orderstatus = 'F', '{"mcpServers": [1]}', 'no json') ELSE
      concat('{"source": "x", "mcpServers": {"docs": {"url": "http://d/', o_custkey, '"',
        CASE o_orderstatus WHEN 'F' THEN ', "headers": {"X-Key": "secret", "Authorization": "secret"}' WHEN 'P' THEN ', "headers": {}' ELSE '' END,
        '}, "run": {"command": "run-', o_orderkey, '", "args": [1]}}}') END""")
    found = responses.server_listing(ad.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("config_id"), raw.alias("raw")))
    return found.withColumn("header_keys", F.array_join("header_keys", ","))
