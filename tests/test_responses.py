"""Edge cases of JSON and text helpers."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import coerce, text
from codeloom.operators import responses, runs, views


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


def obj(spark, t, **kw):
    return one(spark, coerce.text_at(responses.extract_json_object(F.col("t"), **kw), "$.a"), t)


@pytest.mark.parametrize(
    ("value", "loose", "strict"),
    [
        ('{"a": 1}', "1", "1"),
        (' {"a": 1}\n', "1", "1"),
        ('say {"a": 1} bye', "1", "1"),
        ('[{"a": 1}]', "1", None),
        ('"{\\"a\\": 1}"', None, None),
        ('{"a": 1} {"a": 2}', None, None),
        ('{"a": 1} and {"b": 2}', None, None),
        ('{"a": 1}], [2', "1", "1"),
        ('{"a": 1}}', None, None),
        ("{'a': 1}", None, None),
        ("", None, None),
        (None, None, None),
    ],
)
def test_json_salvage(spark, value, loose, strict):
    assert obj(spark, value) == loose
    assert obj(spark, value, strict_arrays=True) == strict


@pytest.mark.parametrize(
    ("body", "status"),
    [
        ('{"status": "", "state": 0, "phase": "Incomplete"}', "completed"),
        ('{"status": "OK"}', "completed"),
        ('{"status": "okay"}', "running"),
        ('{"status": "done with errors"}', "failed"),
        ('{"status": "0", "result": 1}', "completed"),
        ('{"error": {}, "result": null}', "running"),
        ('{"error": "false"}', "failed"),
        ("null", "running"),
        ("[1]", "completed"),
        ("{} {}", "invalid"),
    ],
)
def test_status_words(spark, body, status):
    table = spark.createDataFrame([(1, body)], "request_key int, body string")
    assert responses.trigger_responses(table, async_mode=False).first().status == status


@pytest.mark.parametrize(
    ("value", "expected"),
    [("7", 7), ("7.9", 7), ("-7.9", -7), ('" 7 "', 7), ('"7.9"', -1), ("true", 1), ("null", -1), ("[7]", -1), ('""', -1)],
)
def test_int_coercion(spark, value, expected):
    assert one(spark, coerce.to_int(coerce.parse(F.col("t")), "$.n", -1), f'{{"n": {value}}}') == expected


def test_string_list_prints_values(spark):
    value = '{"l": [" a ", "", null, true, 1.5]}'
    assert one(spark, coerce.to_string_list(coerce.parse(F.col("t")), "$.l"), value) == ["a", "None", "True", "1.5"]


def test_conversation_branches(spark):
    raw = (
        '{"conversation": {"content": [[{"type": "user_message", "content": "q"}, {"type": "agent_message", "content": " one "}],'
        ' "x", [{"type": "agent_message", "content": "  "}, {"type": "agent_message", "content": 7}, 3]]}}'
    )
    table = spark.createDataFrame([("a", raw), ("b", '{"conversation": 5}'), ("c", "broken")], "conversation_id string, raw string")
    found = responses.last_agent_message(responses.conversation_messages(table)).collect()
    assert [(r.conversation_id, r.answer) for r in found] == [("a", "one")]


def test_citation_lines(spark):
    value = '[{"file": "f", "line_start": 3.7, "line_end": true}, {"line_start": "3"}, []]'
    rows = one(spark, responses.normalise_citations(coerce.parse(F.col("t"))), value)
    assert [(c.file_path, c.symbol, c.line_start, c.line_end) for c in rows] == [("f", "unknown", 3, 1), ("unknown", "unknown", None, None)]
    assert one(spark, responses.normalise_citations(coerce.parse(F.col("t"))), '{"x": 1}') == []


def test_zero_latency_sorts_last(spark):
    probes = spark.createDataFrame(
        [("p", 1, "u1", True, 0, None), ("p", 2, "u2", True, 90, None), ("q", 1, "u3", False, None, ""), ("q", 2, "u4", False, None, "down")],
        "k string, ord int, url string, reachable boolean, latency_ms int, detail string",
    )
    rows = {r.k: r for r in responses.provider_readiness(probes, ["k"]).collect()}
    assert (rows["p"].latency_ms, rows["p"].detail) == (90, "ok:u2")
    assert (rows["q"].reachable, rows["q"].detail) == (False, "u3->unreachable; u4->down")
    failures = [r.failure for r in responses.probe_failures(probes, ["k"]).orderBy("ord").collect()]
    assert failures == ["u3->unreachable", "u4->down"]


def test_merge_keeps_null_patches(spark):
    merged = runs.merge_summary(F.expr("map('a', '1', 'b', '2')"), F.expr("map('b', cast(null AS string), 'c', '3')"))
    assert one(spark, merged) == {"a": "1", "b": None, "c": "3"}


def test_display_of_enrichment(spark):
    table = spark.createDataFrame(
        [("r", '{"k": {"b": 1, "a": [2]}}', '{"list": [1, "x", null], "obj": {"a": 1}, "n": null, "f": 2.0}',
          '[{"check": "c", "pass": 0}, {"label": "l", "passed": null, "status": "pass"}, {"name": "n", "passed": "false"}, [1, 2]]')],
        "run_id string, ontology_enrichment string, migration_hints string, quality_checks string",
    )
    rows = [(r.section, r.label, r.value) for r in views.enrichment_pairs(table).orderBy("section", "ord").collect()]
    assert rows == [
        ("check", "c", "false"), ("check", "l", "true"), ("check", "n", "true"), ("check", "1,2", "true"),
        ("hint", "list: 1,x,", None), ("hint", "obj: [object Object]", None), ("hint", "n: null", None), ("hint", "f: 2", None),
        ("ontology", "k", '{"b":1,"a":[2]}'),
    ]


@pytest.mark.parametrize(
    ("label", "expected"),
    [
        ("SaleCreateView", "Create Sale"), ("Risk Aggregator", "Risk Aggregator"), ("HTTPServerError", "HTTP Server Error"),
        ("confirm_order", "confirm order"), ("View", "View"), ("CreateView", "Create"), ("sale_item Delete", "sale_item Delete"),
        ("fooBar Update", "Update foo Bar"),
    ],
)
def test_humanise(spark, label, expected):
    assert one(spark, text.humanise_label(F.col("t")), label) == expected


def test_title_and_slug(spark):
    assert one(spark, text.title_label(F.col("t")), "v2x_post_it's") == "V2X Post It'S"
    assert one(spark, text.slug(F.col("t")), "--A  b_é!") == "a-b-é"
    assert one(spark, text.slug(F.col("t")), "!!") == "node"
    assert one(spark, text.module_name(F.col("t")), "__init__.py") == ""
    assert one(spark, text.module_name(F.col("t")), "a/b__init__.py") == "a.b__init__"


def test_repeated_keys_and_special_numbers(spark):
    """The last value of a key counts, and NaN does not spoil a document."""
    rows = [(1, '{"status":"done","status":"failed"}'), (2, '{"status":"done","x":NaN}'), (3, '{"a":1} {'), (4, '{"x":-Infinity}')]
    frame = spark.createDataFrame(rows, "request_key long, body string")
    got = {r["request_key"]: r["status"] for r in responses.trigger_responses(frame).collect()}
    assert got == {1: "failed", 2: "completed", 3: "invalid", 4: "running"}


def test_repeated_error_reaches_both_columns(spark):
    rows = [("r", '{"error":"old","status":"done","error":"new","raw":{"quality_checks":{}}}')]
    row = responses.enrichment_rows(spark.createDataFrame(rows, "run_id string, result string")).first()
    assert row["quality_checks"] == '{"integration_error":"new"}' and row["runtime"] == {"error": "new", "status": "done"}


def test_printed_items(spark):
    value = coerce.parse(F.lit('["a", true, 1.0, 1, null, 2.5]'))
    assert one(spark, responses.clean_string_list(value)) == ["a", "True", "1.0", "1", "None", "2.5"]


def test_display_order_of_keys(spark):
    text = F.lit('{"b":1,"10":2,"a":3,"9":4,"b":5}')
    assert [(e["key"], e["value"]) for e in one(spark, views._text_entries(text))] == [("9", "4"), ("10", "2"), ("b", "5"), ("a", "3")]


def test_failures_of_a_hot_provider(spark):
    """Long lists are joined block by block, in probe order, beside short ones."""
    probes = spark.range(1200).selectExpr(
        "if(id % 3 = 0, concat('k', id % 5), 'hot') AS k", "1000 - id AS ord", "concat('u', id) AS url", "k = 'k1' AND id % 2 = 0 AS reachable",
        "cast(1 AS int) AS latency_ms", "if(id % 2 = 0, 'x', '') AS detail")
    for listed in (7, 10_000):
        rows = {r.k: r for r in responses.provider_readiness(probes, ["k"], listed).collect()}
        for k in ("hot", "k0", "k4"):
            ids = [i for i in range(1199, -1, -1) if ("hot" if i % 3 else f"k{i % 5}") == k]
            assert rows[k].detail == "; ".join(f"u{i}->{'unreachable' if i % 2 else 'x'}" for i in ids)
        assert rows["k1"].reachable and rows["k1"].detail == "x"
