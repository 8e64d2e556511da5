"""Queries: sources and sinks, extraction, call graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import adapters as ad
from codeloom.catalog import oracle_parts as op
from codeloom.catalog.registry import query
from codeloom.functions import lexicons as lx
from codeloom.functions.text import decode_source, module_name
from codeloom.operators import callgraph, tagging
from codeloom.plans.analyze import parse_corpus
from codeloom.session import scratch_path, stored
from codeloom.sources import artifacts, extract, files, repositories


def parsed(spark, sf_dir, wanted=extract.RECORD_TYPES):
    """Facts of the generated corpus."""
    kept = files.select_sources(ad.source_files(spark, sf_dir), None)
    return extract.extract_facts(files.decoded(kept), wanted)


# ---- sources and sinks ------------------------------------------------------


@query(
    "S1_scan_sources",
    op.with_parts(op.BASE, select="""
    SELECT run_id, 'svc/order_' || k || '.py' AS path FROM o
    UNION ALL
    SELECT run_id, dir || '/part_' || p || CASE WHEN sz = 48 THEN '/__init__.py' ELSE '.py' END AS path
    FROM allparts WHERE sz NOT IN (47, 49)"""),
)
def scan_sources(spark, sf_dir):
    return files.select_sources(ad.source_files(spark, sf_dir)).select("run_id", "path")


@query("S2_decode_source", "SELECT doc_id, length(text) AS chars, md5(text) AS digest FROM documents")
def decode(spark, sf_dir):
    # Texts which Latin-1 can hold are stored in it, the others in UTF-8.
    content = F.when(
        F.col("text").rlike(r"^[\x{0}-\x{ff}]*$"), F.encode("text", "ISO-8859-1")
    ).otherwise(F.encode("text", "UTF-8"))
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    text = decode_source(F.col("content"))
    return docs.select("doc_id", F.length(text).cast("bigint").alias("chars"), F.md5(text).alias("digest"))


@query(
    "S3_module_name",
    op.with_parts(op.BASE, select="""
    SELECT 'svc/order_' || k || '.py' AS path, 'svc.order_' || k AS module FROM o
    UNION ALL
    SELECT CASE sz WHEN 47 THEN dir || '/part_' || p || '.txt' WHEN 48 THEN dir || '/part_' || p || '/__init__.py'
             WHEN 49 THEN 'venv/' || dir || '/part_' || p || '.py' ELSE dir || '/part_' || p || '.py' END,
           CASE sz WHEN 47 THEN dir || '.part_' || p || '.txt' WHEN 49 THEN 'venv.' || dir || '.part_' || p
             ELSE dir || '.part_' || p END
    FROM allparts"""),
)
def modules(spark, sf_dir):
    return ad.source_files(spark, sf_dir).select("path", module_name(F.col("path")).alias("module"))


_URL_VARIANTS = "array(url, regexp_replace(url, '/[0-9]+', '/a.git.gitb'), regexp_extract(url, '^https?://[^/]+/[^/]+', 0))"


@query(
    "S4_parse_repo_url",
    """
    WITH u AS (
      SELECT page_id, unnest([url, regexp_replace(url, '/[0-9]+', '/a.git.gitb'),
        regexp_extract(url, '^https?://[^/]+/[^/]+')]) AS url FROM pages),
    p AS (
      SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/'),
        lambda s: s <> '') AS parts FROM u)
    SELECT page_id, url, CASE WHEN len(parts) >= 2 THEN parts[1] END AS owner,
      CASE WHEN len(parts) >= 2 THEN replace(parts[2], '.git', '') END AS name, len(parts) >= 2 AS valid
    FROM p""",
)
def repo_urls(spark, sf_dir):
    urls = ad.table(spark, sf_dir, "pages").selectExpr("page_id", f"explode({_URL_VARIANTS}) AS url")
    return repositories.parse_repo_url(urls)


def _repositories(spark, sf_dir):
    """Customers as repositories, their orders as files in several places."""
    nations = ad.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    customers = ad.table(spark, sf_dir, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    )
    repos = customers.selectExpr(
        "c_custkey AS repo_id",
        "n_name AS owner",
        "concat('cust_', c_custkey) AS name",
        "CASE c_mktsegment WHEN 'BUILDING' THEN concat('/data/cust_', c_custkey) END AS local_path",
        "CASE WHEN c_acctbal < 0 THEN '' WHEN c_acctbal < 5000 THEN 'main' ELSE 'develop' END AS default_branch",
    )
    located = ad.table(spark, sf_dir, "orders").join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    )
    paths = located.selectExpr(
        """CASE o_orderpriority
             WHEN '1-URGENT' THEN concat('/data/cust_', o_custkey, '/o_', o_orderkey, '.py')
             WHEN '2-HIGH' THEN concat('/srv/a/cust_', o_custkey, '/venv/o_', o_orderkey, '.py')
             WHEN '3-MEDIUM' THEN concat('/srv/b/', n_name, '/cust_', o_custkey, '/x/o_', o_orderkey, '.py')
             WHEN '4-NOT SPECIFIED' THEN concat('/cache/', n_name, '__cust_', o_custkey, '/o_', o_orderkey, '.py')
             ELSE concat('/srv/a/cust_', o_custkey, '/o_', o_orderkey, '.txt') END AS path"""
    )
    return repos, paths


_REPO_FACTS = """
    has AS (SELECT o_custkey AS repo_id, bool_or(o_orderpriority = '1-URGENT') AS p1,
        bool_or(o_orderpriority = '2-HIGH') AS p2, bool_or(o_orderpriority = '3-MEDIUM') AS p3,
        bool_or(o_orderpriority = '4-NOT SPECIFIED') AS p4 FROM orders GROUP BY 1),
    r AS (SELECT c_custkey AS repo_id, n_name AS owner, c_mktsegment = 'BUILDING' AS given, c_acctbal AS bal,
        coalesce(p1, false) AS p1, coalesce(p2, false) AS p2, coalesce(p3, false) AS p3, coalesce(p4, false) AS p4
      FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN has ON repo_id = c_custkey)"""


@query(
    "S5_resolve_source",
    f"""
    WITH {_REPO_FACTS}
    SELECT repo_id, CASE WHEN given AND p1 THEN '/data/cust_' || repo_id WHEN p2 THEN '/srv/a/cust_' || repo_id
        WHEN p3 THEN '/srv/b/' || owner || '/cust_' || repo_id END AS source_root,
      CASE WHEN (given AND p1) OR p2 OR p3 THEN 'ast-local' ELSE 'fallback' END AS mode FROM r""",
)
def resolved_sources(spark, sf_dir):
    repos, paths = _repositories(spark, sf_dir)
    return repositories.resolve_source(repos, paths, ["/srv/a", "/srv/b"]).select("repo_id", "source_root", "mode")


@query(
    "S6_ingestion_mode",
    f"""
    WITH {_REPO_FACTS},
    b AS (SELECT *, CASE WHEN bal < 0 THEN 'main' WHEN bal < 5000 THEN 'main' ELSE 'version-15' END AS branch FROM r)
    SELECT repo_id, CASE WHEN given AND p1 THEN 'local' WHEN p4 AND bal < 9000 THEN 'git-clone' ELSE 'fallback' END AS mode,
      CASE WHEN given AND p1 THEN 'Using user-provided local path'
        WHEN bal >= 9000 THEN 'clone failed'
        WHEN p4 THEN 'Repository prepared in local cache (branch=' || branch || ')'
        ELSE 'No Python files found after ingestion' END AS message,
      CASE WHEN given AND p1 THEN CASE WHEN bal < 0 THEN NULL WHEN bal < 5000 THEN 'main' ELSE 'develop' END
        ELSE branch END AS branch FROM b""",
)
def ingestion(spark, sf_dir):
    repos, paths = _repositories(spark, sf_dir)
    # ``develop`` does not exist remotely: the copy has the remote default instead.
    checkouts = (
        repos.join(
            ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("repo_id"), "c_acctbal"), "repo_id"
        )
        .selectExpr(
            "owner", "name", "concat('/cache/', owner, '__', name) AS dir",
            "if(default_branch = 'develop', 'version-15', if(default_branch = '', 'main', default_branch)) AS branch",
            "if(c_acctbal >= 9000, 'clone failed', null) AS error",
        )
    )
    return repositories.ingestion_mode(repos, paths, checkouts)


@query(
    "S7_write_artifacts",
    """SELECT 's-' || s_suppkey AS run_id, 'risk' AS kind,
         CASE WHEN s_nationkey < 10 THEN 'second' ELSE 'first' END AS payload FROM supplier""",
)
def written(spark, sf_dir):
    path = scratch_path(spark, "artifacts")
    base = ad.table(spark, sf_dir, "supplier").selectExpr("concat('s-', s_suppkey) AS run_id", "s_nationkey")
    artifacts.write_artifacts(base.select("run_id", F.lit("first").alias("payload")), "risk", path)
    artifacts.write_artifacts(
        base.where("s_nationkey < 10").select("run_id", F.lit("second").alias("payload")), "risk", path
    )
    return artifacts.read_artifacts(spark, path).select("run_id", "kind", "payload")


@query(
    "S8_latest_by_key",
    """SELECT user_id, event_type, event_id, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place
         FROM events) WHERE place = 1""",
)
def latest(spark, sf_dir):
    events = ad.table(spark, sf_dir, "events")
    return artifacts.latest_by_key(events, ["user_id", "event_type"], ["ts", "event_id"]).select(
        "user_id", "event_type", "event_id", "value"
    )


@query(
    "S9_lookup_artifacts",
    """WITH keys AS (SELECT DISTINCT c_custkey AS run_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'click' ELSE 'view' END AS kind
         FROM customer)
       SELECT run_id, kind, event_id FROM (
         SELECT user_id AS run_id, event_type AS kind, event_id,
           row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events)
       JOIN keys USING (run_id, kind) WHERE place = 1""",
)
def looked_up(spark, sf_dir):
    stored = ad.table(spark, sf_dir, "events").selectExpr(
        "user_id AS run_id", "event_type AS kind", "'' AS node_id", "event_id", "ts"
    )
    keys = ad.table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS run_id", "if(c_mktsegment = 'BUILDING', 'click', 'view') AS kind", "'' AS node_id"
    )
    return artifacts.lookup_artifacts(keys, stored, ["ts", "event_id"]).select("run_id", "kind", "event_id")


@query(
    "S10_run_for_repository",
    "SELECT o_orderkey AS run_id, o_custkey AS repo_id, o_orderstatus AS status FROM orders WHERE o_orderpriority <> '5-LOW'",
)
def run_of_repo(spark, sf_dir):
    runs = ad.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id", "o_custkey AS repo_id", "o_orderstatus AS status"
    )
    # Low-priority runs are asked for under the wrong repository.
    asked = ad.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS run_id", "o_custkey + if(o_orderpriority = '5-LOW', 1, 0) AS repo_id"
    )
    return artifacts.run_for_repository(asked, runs)


@query(
    "S11_export_payloads",
    op.with_parts(op.BASE, op.EDGES, op.RUNS, op.RISK, op.WORKFLOW, """
    jn AS (SELECT run_id, string_agg('{"id":"' || node_id || '","label":"' || label || '","node_type":"' || node_type
        || '","risk_score":' || risk_score || '}', ',' ORDER BY node_ord) AS nodes FROM wnodes GROUP BY 1),
    je AS (SELECT run_id, string_agg('{"source":"' || source || '","target":"' || target || '","edge_type":"' || edge_type
        || '","confidence":' || confidence || '}', ',' ORDER BY edge_ord) AS edges FROM wedges GROUP BY 1),
    sug(category, texts) AS (VALUES
      ('complexity', '"Refactor into smaller functions with single responsibility","Extract service layer to isolate business logic"'),
      ('coupling', '"Introduce interface boundary between modules","Apply dependency injection to decouple components"'),
      ('dead_code', '"Safe to remove after verifying no runtime references","Archive and monitor for regression"'),
      ('test_gap', '"Add unit tests for critical business logic paths","Prioritize integration tests for high-risk flows"')),
    jf AS (SELECT run_id, string_agg('{"id":"' || finding_id || '","category":"' || category || '","severity":"' || severity || '","score":' || score
        || ',"title":"' || title || '","rationale":"' || rationale || '","symbol":"' || symbol || '","migration_suggestions":[' || texts || ']}',
        ',' ORDER BY finding_ord) AS findings FROM findings JOIN sug USING (category) GROUP BY 1)""",
    select="""
    SELECT run_id, 'workflow' AS kind, '{"run_id":"' || run_id || '","nodes":[' || nodes || '],"edges":[' || coalesce(edges, '') || ']}' AS payload
    FROM jn LEFT JOIN je USING (run_id)
    UNION ALL
    SELECT run_id, 'risk', '{"run_id":"' || run_id || '","overall_score":' || overall_score || ',"findings":[' || findings || ']}'
    FROM overall JOIN jf USING (run_id)"""),
)
def exported(spark, sf_dir):
    products = ad.products(spark, sf_dir)
    graphs = artifacts.export_graph(products.workflow_nodes, products.workflow_edges)
    risks = artifacts.export_risk(products.findings, products.overall)
    return graphs.select("run_id", F.lit("workflow").alias("kind"), "payload").unionByName(
        risks.select("run_id", F.lit("risk").alias("kind"), "payload")
    )


@query(
    "S12_effective_branch",
    """SELECT c_custkey AS repo_id, requested, CASE WHEN requested = 'main' AND c_nationkey % 2 = 0 THEN 'main'
         WHEN requested = 'develop' AND c_nationkey % 3 = 0 THEN 'develop' WHEN c_nationkey % 5 <> 4 THEN 'version-' || c_nationkey END AS branch
       FROM (SELECT *, CASE c_mktsegment WHEN 'BUILDING' THEN 'main' ELSE 'develop' END AS requested FROM customer)""",
)
def effective_branches(spark, sf_dir):
    """Some remotes have the branch, some only as part of a longer name, some not; a few list none."""
    customers = ad.table(spark, sf_dir, "customer")
    repos = customers.selectExpr("c_custkey AS repo_id", "if(c_mktsegment = 'BUILDING', 'main', 'develop') AS requested")
    listed = customers.selectExpr(
        "c_custkey AS repo_id",
        """inline(filter(array(
             named_struct('branch', if(c_nationkey % 2 = 0, 'main', null), 'is_default', false),
             named_struct('branch', if(c_nationkey % 3 = 0, 'team/develop', null), 'is_default', false),
             named_struct('branch', 'xmain', 'is_default', false), named_struct('branch', 'main-old', 'is_default', false),
             named_struct('branch', if(c_nationkey % 5 <> 4, concat('version-', c_nationkey), null), 'is_default', true)), b -> b.branch IS NOT NULL))""",
    )
    return repositories.effective_branch(repos, listed)


# ---- extraction -------------------------------------------------------------


@query(
    "P1_extract_functions",
    op.with_parts(op.BASE, """
    words AS (
      SELECT k, call_ord, call, CASE rf WHEN 'A' THEN 'item,' ELSE '' END || 'f' || n || ',order,' || call || ',part_' || p
        || CASE ls WHEN 'O' THEN ',part_' || p || ',parts' ELSE '' END || ',order' || CASE rf WHEN 'R' THEN ',' || lower(noun) || ',order' ELSE '' END AS w
      FROM lcalls JOIN o USING (k)),
    li AS (
      SELECT k, string_agg(w, ',' ORDER BY call_ord) || ',' AS w, string_agg(call, ',' ORDER BY call_ord) AS c FROM words GROUP BY 1)""",
    select="""
    SELECT fn.run_id, file_path, fn_ord, qname, short_name, line_start, line_end,
      md5(CASE WHEN okey IS NOT NULL THEN coalesce(c, '') WHEN pkey IS NULL OR sz <= 10 THEN ''
        WHEN sz <= 20 THEN 'x.update_lead' ELSE alias END) AS calls,
      md5(CASE WHEN okey IS NOT NULL THEN coalesce(w, '') || 'order,' || short_name
           WHEN pkey IS NULL THEN 'x,' || short_name
           WHEN sz <= 10 THEN 'stock,x,x,' || short_name WHEN sz <= 20 THEN 'x.update_lead,update_lead,x,x,x,' || short_name
           ELSE alias || ',' || alias || ',x,x,' || short_name END) AS idents
    FROM fn LEFT JOIN li ON okey = k LEFT JOIN pt ON pkey = p"""),
)
def functions(spark, sf_dir):
    facts = parsed(spark, sf_dir, ("function",))
    return extract.extract_functions(facts).select(
        "run_id", "file_path", "fn_ord", "qname", "short_name", "line_start", "line_end",
        F.md5(F.array_join("calls", ",")).alias("calls"),
        F.md5(F.array_join("idents", ",")).alias("idents"),
    )


@query(
    "P2_extract_imports",
    "SELECT 'run-' || (o_custkey % 32) AS run_id, 'svc.order_' || o_orderkey AS module, 'pkg_' || (o_orderkey % 7) AS imported FROM orders",
)
def imports(spark, sf_dir):
    facts = parsed(spark, sf_dir, ("import",))
    return extract.extract_imports(facts).select("run_id", "module", "imported")


@query(
    "P3_extract_parse_errors",
    op.with_parts(op.BASE, select="""
    SELECT run_id, dir || '/part_' || p || '.py' AS file_path, 1 AS error_line FROM allparts WHERE sz = 50"""),
)
def parse_errors(spark, sf_dir):
    facts = parsed(spark, sf_dir, ("error",))
    return extract.extract_parse_errors(facts).select("run_id", "file_path", "error_line")


# A parameter lexicon for prose: short words, and one inside another.
_PROSE_TOKENS = [("the", "The"), ("he", "He"), ("and", "And"), ("on", "On"), ("que", "Que"), ("er", "Er")]


@query(
    "P4_tag_entities",
    "WITH tok(pos, token, tag) AS (VALUES "
    + ", ".join(f"({i}, '{t}', '{v}')" for i, (t, v) in enumerate(_PROSE_TOKENS))
    + """),
    ws AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents),
    w AS (SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS place FROM ws),
    m AS (SELECT doc_id, place, pos, tag FROM w JOIN tok ON contains(replace(lower(word), '_', '.'), token)),
    g AS (SELECT doc_id, count(*) AS mentions, md5(string_agg(tag, ',' ORDER BY place, pos)) AS digest,
        array_to_string(list_sort(list(DISTINCT tag)), ',') AS entities FROM m GROUP BY 1)
    SELECT d.doc_id, coalesce(mentions, 0) AS mentions, coalesce(digest, md5('')) AS digest, coalesce(entities, '') AS entities
    FROM documents d LEFT JOIN g USING (doc_id)""",
)
def entities(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("idents"))
    sequence = tagging.tag_entities(F.col("idents"), lx.token_table(_PROSE_TOKENS))
    return docs.select("doc_id", sequence.alias("s")).select(
        "doc_id",
        F.size("s").cast("bigint").alias("mentions"),
        F.md5(F.array_join("s", ",")).alias("digest"),
        F.array_join(tagging.as_set(F.col("s")), ",").alias("entities"),
    )


@query(
    "P5_tag_crud",
    "WITH tok(pos, token, tag) AS (VALUES "
    + ", ".join(f"({i}, '{t}', '{v}')" for i, (t, v) in enumerate(lx.CRUD_TOKENS))
    + """),
    w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents)),
    g AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT tag)), ',') AS crud_ops
      FROM w JOIN tok ON contains(replace(lower(word), '_', '.'), token) GROUP BY 1)
    SELECT d.doc_id, coalesce(crud_ops, '') AS crud_ops FROM documents d LEFT JOIN g USING (doc_id)""",
)
def crud(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("idents"))
    return docs.select("doc_id", F.array_join(tagging.tag_crud(F.col("idents")), ",").alias("crud_ops"))


@query(
    "P6_complexity",
    op.with_parts(op.BASE, select="SELECT run_id, qname, complexity FROM fn"),
)
def complexities(spark, sf_dir):
    facts = parsed(spark, sf_dir, ("function",))
    return extract.extract_functions(facts).select(
        "run_id", "qname", tagging.complexity(F.col("branch_kinds")).cast("bigint").alias("complexity")
    )


@query(
    "P7_scan_counters",
    op.with_parts(op.BASE, op.RUNS, """
    f AS (SELECT run_id, count(*) AS c FROM (
        SELECT run_id FROM o UNION ALL SELECT run_id FROM allparts WHERE sz NOT IN (47, 49)) GROUP BY 1)""",
    select="""
    SELECT run_id, coalesce(f.c, 0) AS files_scanned,
      (SELECT count(*) FROM fn WHERE fn.run_id = runs.run_id) AS functions_scanned,
      (SELECT count(*) FROM allparts a WHERE a.run_id = runs.run_id AND sz = 50) AS parse_errors,
      (SELECT count(*) FROM o WHERE o.run_id = runs.run_id) AS imports
    FROM runs LEFT JOIN f USING (run_id)"""),
)
def counters(spark, sf_dir):
    return tagging.scan_counters(ad.run_table(spark, sf_dir), parsed(spark, sf_dir))


# ---- call graph -------------------------------------------------------------


@query(
    "G1_explode_calls",
    op.with_parts(op.BASE, select="SELECT run_id, source, call_ord::INT AS call_ord, call FROM calls"),
)
def all_calls(spark, sf_dir):
    return callgraph.explode_calls(ad.function_table(spark, sf_dir)).select("run_id", "source", "call_ord", "call")


@query(
    "G2_resolve_exact",
    op.with_parts(op.BASE, select="""
    SELECT DISTINCT c.run_id, call, qname AS target FROM calls c JOIN fn ON fn.run_id = c.run_id AND fn.qname = call"""),
)
def exact(spark, sf_dir):
    table = ad.functions(spark, sf_dir)
    names = callgraph.explode_calls(table).select("run_id", "call").distinct()
    return callgraph.resolve_exact(names, table)


@query(
    "G3_resolve_unique_short",
    op.with_parts(op.BASE, op.EDGES, select="""
    SELECT DISTINCT c.run_id, call, target FROM calls c
    JOIN uniq u ON u.run_id = c.run_id AND u.short_name = string_split(call, '.')[-1]"""),
)
def unique_short(spark, sf_dir):
    table = ad.functions(spark, sf_dir)
    names = callgraph.explode_calls(table).select("run_id", "call").distinct()
    return callgraph.resolve_unique_short(names, table)


@query("G4_call_edges", op.with_parts(op.BASE, op.EDGES, select="SELECT run_id, source, target FROM edges"))
def edges(spark, sf_dir):
    kept = files.select_sources(ad.source_files(spark, sf_dir), None)
    _, table = parse_corpus(kept)
    return callgraph.call_edges(stored(table.select("run_id", "file_path", "fn_ord", "qname", "short_name", "calls")))


@query(
    "G5_degrees",
    op.with_parts(op.BASE, op.EDGES, select="""
    SELECT run_id, qname, out_degree::BIGINT AS out_degree, in_degree::BIGINT AS in_degree FROM deg"""),
)
def degrees(spark, sf_dir):
    return callgraph.degrees(callgraph.call_edges(ad.functions(spark, sf_dir)))
