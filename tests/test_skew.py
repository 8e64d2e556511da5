"""Hot groups and input order do not change results."""

import random
from collections import Counter, defaultdict

from codeloom.operators import callgraph, lineage, risk, workflow
from codeloom.plans.analyze import products_of

_SCHEMA = (
    "run_id string, file_path string, fn_ord int, qname string, short_name string, complexity int, "
    "calls array<string>, entity_sequence array<string>, entities array<string>, crud_ops array<string>"
)


def corpus(seed=3):
    """One run with half of the functions; a callee which everybody calls; shared names."""
    rng = random.Random(seed)
    rows = []
    for i in range(1200):
        run = "hot" if i % 2 else f"r{i % 7}"
        short = rng.choice([f"f{i}", "get", "log", f"g{i % 5}"])
        module = f"m{i % 50}"
        calls = ["log_all"] + [rng.choice(["get", f"f{rng.randrange(1200)}", f"m{i % 50}.get", "x.log", "g1"]) for _ in range(4)]
        sequence = [rng.choice(["Order", "Lead", "Stock", "Ledger", "Account", "Invoice", "Payment", "Shipment"]) for _ in range(6)]
        rows.append(
            (run, f"{module}.py", i, f"{module}.{short}", short, rng.randint(1, 9), calls, sequence, sorted(set(sequence)), [])
        )
    for run in ["hot", *[f"r{i}" for i in range(7)]]:
        rows.append((run, "log.py", 1, "log.log_all", "log_all", 1, [], [], [], []))
    return rows


def brute_edges(rows):
    by_run = defaultdict(list)
    for r in rows:
        by_run[r[0]].append(r)
    edges = set()
    for run, members in by_run.items():
        qnames = {m[3] for m in members}
        short = defaultdict(set)
        for m in members:
            short[m[4]].add(m[3])
        for m in members:
            for call in m[6]:
                owners = short.get(call.rsplit(".", 1)[-1], set())
                if call in qnames:
                    edges.add((run, m[3], call))
                elif len(owners) == 1:
                    edges.add((run, m[3], *owners))
    return edges


def test_edges_against_brute_force(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, _SCHEMA)
    edges = callgraph.call_edges(table).persist()
    expected = brute_edges(rows)
    assert {tuple(r) for r in edges.collect()} == expected
    out, inward = Counter((r, s) for r, s, _ in expected), Counter((r, t) for r, _, t in expected)
    for d in callgraph.degrees(edges).collect():
        assert (d.out_degree, d.in_degree) == (out[(d.run_id, d.qname)], inward[(d.run_id, d.qname)])


def test_transitions_against_brute_force(spark):
    rows = corpus()
    table = spark.createDataFrame(rows, _SCHEMA)
    top = lineage.top_entities(lineage.entity_counts(table)).persist()
    allowed = {(r.run_id, r.entity) for r in top.collect()}
    expected = Counter()
    for r in rows:
        kept = [e for e in r[7] if (r[0], e) in allowed]
        expected.update((r[0], a, b) for a, b in zip(kept, kept[1:]) if a != b)
    found = {(r.run_id, r.source, r.target): r.weight for r in lineage.entity_transitions(table, top).collect()}
    assert found == dict(expected)


def test_same_results_for_shuffled_input_and_other_partitions(spark):
    rows = corpus()
    runs = spark.createDataFrame([(r, "erp") for r in sorted({r[0] for r in rows})] + [("none", "crm")], "run_id string, root_name string")

    def results(data, partitions):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            table = spark.createDataFrame(data, _SCHEMA).repartition(int(partitions))
            p = products_of(runs, table.persist(), keep=lambda df: df.persist())
            names = ["workflow_nodes", "workflow_edges", "lineage_nodes", "lineage_edges", "findings", "evidence"]
            return [sorted(map(str, getattr(p, n).collect())) for n in names]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)

    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    assert results(rows, "8") == results(mixed, "3")


def test_top_k_is_cut_before_the_shuffle(spark):
    profiles = callgraph.with_degrees(
        spark.createDataFrame(corpus(), _SCHEMA), spark.createDataFrame([], "run_id string, source string, target string")
    ).persist()
    for frame in (workflow.select_workflow(profiles), risk.most_complex(profiles)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2, plan
    extremes = risk.run_extremes(profiles)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in extremes


def test_calls_of_a_hot_short_name_are_split(spark):
    """One short name in nine of ten calls: no aggregate lies directly below a join, and the
    partition of the hot name is split."""
    rows = [("hot", f"m{i}.py", 1, f"m{i}.f{i}", f"f{i}", 1, ["x.get" if i % 10 else f"f{i - 1}", f"y{i}.get"], [], [], []) for i in range(20000)]
    rows.append(("hot", "g.py", 1, "g.get", "get", 1, [], [], [], []))
    table = spark.createDataFrame(rows, _SCHEMA)
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        edges = callgraph.call_edges(table.repartition(8))
        assert {tuple(r) for r in edges.collect()} == brute_edges(rows)
        plan = edges._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    final = plan.split("== Initial Plan ==")[0].split("== Final Plan ==")[-1]
    assert "SortMergeJoin(skew=true)" in final, final
    lines = [line.lstrip(" :|+-").lstrip("*").split(") ", 1)[-1] for line in final.splitlines()]
    depth = [len(line) - len(line.lstrip(" :|+-")) for line in final.splitlines()]
    for n, line in enumerate(lines):
        if line.startswith("SortMergeJoin"):
            for k in range(n + 1, len(lines)):
                if depth[k] <= depth[n]:
                    break
                if lines[k].startswith(("Exchange", "ShuffleQueryStage", "AQEShuffleRead")):
                    break
                assert "HashAggregate" not in lines[k], final
