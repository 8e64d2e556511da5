"""Layering against a sequential traversal of random graphs, cycles included."""

import random
from collections import deque

from pyspark.sql import functions as F

from codeloom.operators import layers as layers_module
from codeloom.operators.layers import graph_layers, layer_order, layout_extent


def sequential(nodes, edges):
    """Expected layers of one graph: a queue walk in node and edge order."""
    known = {n for n, _ in nodes}
    out = {n: [] for n in known}
    entered = set()
    for s, t, _ in sorted(edges, key=lambda e: e[2]):
        if s in known and t in known:
            out[s].append(t)
            entered.add(t)
    ordered = [n for n, _ in sorted(nodes, key=lambda n: n[1])]
    start = [n for n in ordered if n not in entered] or ordered[:1]
    layer = dict.fromkeys(start, 0)
    waiting, done = deque(start), set()
    while waiting:
        node = waiting.popleft()
        if node in done:
            continue
        done.add(node)
        for t in out[node]:
            if t not in done:
                layer[t] = max(layer.get(t, 0), layer[node] + 1)
                waiting.append(t)
    deepest = max(layer.values(), default=0)
    return {n: layer.get(n, deepest) for n in known}


def test_random_graphs(spark):
    rng = random.Random(7)
    node_rows, edge_rows, expected = [], [], {}
    for run in range(40):
        size = rng.randint(1, 12)
        nodes = [(f"n{i}", i) for i in range(size)]
        density = rng.choice([0, 1, 2, 3])
        links = []
        for e in range(size * density):
            s = rng.randrange(size)
            t = rng.randrange(size + 1)  # the last one is unknown
            if run % 3 and t <= s:
                continue
            links.append((f"n{s}", f"n{t}", e))
        run_id = f"r{run}"
        node_rows += [(run_id, *n) for n in nodes]
        edge_rows += [(run_id, *e) for e in links]
        expected.update({(run_id, n): layer for n, layer in sequential(nodes, links).items()})
    nodes = spark.createDataFrame(node_rows, "run_id string, node_id string, node_ord int")
    edges = spark.createDataFrame(edge_rows, "run_id string, source string, target string, edge_ord int")
    mixed = graph_layers(nodes, edges, small=18)  # both ways in one table
    assert {(r.run_id, r.node_id): r.layer for r in mixed.collect()} == expected
    placed = graph_layers(nodes, edges).persist()
    assert {(r.run_id, r.node_id): r.layer for r in placed.collect()} == expected

    places = {(r.run_id, r.node_id): r.position for r in layer_order(placed).collect()}
    for (run_id, node), layer in expected.items():
        same = [n for (r, n), v in expected.items() if r == run_id and v == layer]
        same.sort(key=lambda n: int(n[1:]))
        assert places[(run_id, node)] == same.index(node) + 1
    extent = {r.run_id: r.layers for r in layout_extent(placed).collect()}
    assert extent["r0"] == len({v for (r, _), v in expected.items() if r == "r0"})


def test_positions_across_blocks(spark):
    layers = spark.range(200_000).selectExpr(
        "'r' AS run_id", "concat('n', id) AS node_id", "id AS node_ord", "cast(id % 2 AS int) AS layer"
    )
    wrong = layer_order(layers).where("position <> cast(substring(node_id, 2) AS bigint) div 2 + 1")
    assert wrong.count() == 0


def test_long_chain(spark):
    """A chain of 1,000 nodes with a short cut, beside a wide run."""
    chain = spark.range(1000).selectExpr("'chain' AS run_id", "concat('n', id) AS node_id", "cast(id AS int) AS node_ord")
    wide = spark.range(500).selectExpr("'wide' AS run_id", "concat('n', id) AS node_id", "cast(id AS int) AS node_ord")
    steps = spark.range(999).selectExpr("'chain' AS run_id", "concat('n', id) AS source", "concat('n', id + 1) AS target", "cast(id AS int) AS edge_ord")
    fan = spark.range(1, 500).selectExpr("'wide' AS run_id", "'n0' AS source", "concat('n', id) AS target", "cast(id AS int) AS edge_ord")
    cut = spark.createDataFrame([("chain", "n0", "n500", 5000)], "run_id string, source string, target string, edge_ord int")
    found = {(r.run_id, int(r.node_id[1:])): r.layer for r in graph_layers(chain.union(wide), steps.union(fan).union(cut)).collect()}
    nodes = [(f"n{i}", i) for i in range(1000)]
    links = [(f"n{i}", f"n{i + 1}", i) for i in range(999)] + [("n0", "n500", 5000)]
    expected = sequential(nodes, links)
    assert all(found["chain", i] == expected[f"n{i}"] for i in range(1000))
    assert all(found["wide", i] == (i > 0) for i in range(500))


def test_chain_over_several_jobs(spark, monkeypatch):
    """Keys are numbered anew on the way; two nodes of a level keep their order."""
    monkeypatch.setattr(layers_module, "_RENUMBER", 6)
    nodes = [(f"n{i}", i) for i in range(40)] + [(f"m{i}", 100 + i) for i in range(40)]
    links = [(f"{a}{i}", f"{b}{i + 1}", 1000 - 10 * i + k) for i in range(20) for k, (a, b) in enumerate(["nm", "nn", "mm", "mn"])]
    links += [("n20", "m20", 2000), ("m3", "n3", 2001), ("n7", "n2", 2002)]
    node_table = spark.createDataFrame([("r", *n) for n in nodes], "run_id string, node_id string, node_ord int")
    edge_table = spark.createDataFrame([("r", *e) for e in links], "run_id string, source string, target string, edge_ord int")
    found = {r.node_id: r.layer for r in graph_layers(node_table, edge_table, small=0).collect()}
    assert found == sequential(nodes, links)


def test_levels_of_a_job_share_the_exchange_of_the_links(spark, tmp_path):
    nodes = spark.range(64).selectExpr("'r' AS run_id", "cast(id AS string) AS node_id", "cast(id AS int) AS node_ord")
    links = spark.range(63).selectExpr("'r' AS run_id", "cast(id AS string) AS node_id", "cast(id + 1 AS string) AS target", "id AS edge_ord")
    links.write.parquet(str(tmp_path / "links"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ways = layers_module._with_self(nodes, spark.read.parquet(str(tmp_path / "links")))
        state = nodes.select("run_id", "node_id", F.lit(0).alias("layer"))
        for _ in range(4):
            state = state.join(ways, ["run_id", "node_id"]).groupBy("run_id", F.col("target").alias("node_id")).agg(F.max("layer").alias("layer"))
        state.collect()
        final = state._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert final.count("FileScan parquet") <= 2 and final.count("ReusedExchange") >= 2, final


def test_positions_with_sparse_numbers(spark):
    layers = spark.range(1000).selectExpr("'r' AS run_id", "cast(id AS string) AS node_id", "id * 1000003 AS node_ord", "0 AS layer")
    assert layer_order(layers).where("position <> cast(node_id AS bigint) + 1").isEmpty()


def test_large_runs_are_followed_by_numbers(spark, monkeypatch):
    """Names of nodes are exchanged where they get their numbers and at the end, not at every level."""
    kinds, known, own = [], [], layers_module._with_self
    monkeypatch.setattr(layers_module, "_with_self", lambda n, l: kinds.append(dict(l.dtypes)) or own(n, l))
    monkeypatch.setattr(layers_module, "known_edges", lambda n, e: known.append(1) or e)
    rows = [("r", f"node-{i}", i) for i in range(12)] + [("r", "node-3", 30), ("r", None, 31), ("q", "node-3", 0)]
    links = [("r", f"node-{i}", f"node-{j}", i * 20 + j) for i in range(10) for j in (i + 1, i + 2)]
    links += [("r", "node-5", "node-2", 500), ("r", "node-1", "elsewhere", 501), ("r", "node-4", "node-4", 502)]
    nodes = spark.createDataFrame(rows, "run_id string, node_id string, node_ord long")
    edges = spark.createDataFrame(links, "run_id string, source string, target string, edge_ord long")
    found = {tuple(r) for r in graph_layers(nodes, edges, small=0).select("run_id", "node_id", "node_ord", "layer").collect()}
    assert kinds and all(k["node_id"] == k["target"] == "bigint" for k in kinds)
    assert not known
    expected = sequential([(n, o) for r, n, o in rows[:12]], [row[1:] for row in links])
    deepest = max(expected.values())
    assert found == {("r", n, o, expected.get(n, deepest)) for r, n, o in rows[:14]} | {("q", "node-3", 0, 0)}
