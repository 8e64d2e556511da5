"""Layered layout of directed graphs, for all runs at once."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ranking import ranked
from codeloom.session import checkpointed, stored

_NODE = ["run_id", "node_id"]

# Nodes and edges of a run which one task walks.
_SMALL = 200_000

# Levels or rounds which one job follows: few at first, more while a graph goes on.
_FIRST_STEPS, _MOST_STEPS = 4, 16

# Levels after which visiting keys become numbers again.
_RENUMBER = 64


def known_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes of the run."""
    ids = nodes.select(*_NODE)
    return edges.join(ids.withColumnRenamed("node_id", "source"), ["run_id", "source"], "left_semi").join(
        ids.withColumnRenamed("node_id", "target"), ["run_id", "target"], "left_semi"
    )


def in_degree_roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return _not_entered(nodes, known_edges(nodes, edges))


def _not_entered(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes which no link of (run_id, target) enters."""
    targets = links.select("run_id", F.col("target").alias("node_id")).distinct()
    return nodes.join(targets, _NODE, "left_anti")


def _first_frontier(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Roots of every run; a run without roots starts at its first node."""
    roots = stored(_not_entered(nodes, links).select(*_NODE, "node_ord"))
    rootless = (
        nodes.join(roots.select("run_id").distinct(), "run_id", "left_anti")
        .groupBy("run_id")
        .agg(F.min(F.struct("node_ord", "node_id")).alias("s"))
        .select("run_id", "s.node_id", "s.node_ord")
    )
    return roots.unionByName(rootless).select(
        *_NODE, F.lit(0).alias("hops"), F.array(F.col("node_ord").cast("bigint")).alias("visit_key")
    )


def _with_self(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` and a row from every node to itself, with a null ``edge_ord``.

    Joined to a state, it gives the rows that stay and those that move on in one go, so a
    plan of many steps has one join and one exchange for each, and the exchange of the links
    is the same in all of them.
    """
    own = nodes.select(*_NODE, F.col("node_id").alias("target"), F.lit(None).cast("bigint").alias("edge_ord"))
    return own.unionByName(links)


def visit_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Breadth-first hop distance and visiting key of every reached node.

    Inside one distance, ``visit_key`` sorts like the queue of a sequential traversal: it is
    the place of an earlier node and the edge order of each step since then.  One job follows
    several levels, all runs at once; every ``_RENUMBER`` levels the keys of the newest one
    become places in their order, so keys stay short on long chains.  Nodes reached in
    earlier jobs are taken out of the links.
    """
    known = known_edges(nodes, edges)
    return _visits(nodes, stored(known.select("run_id", F.col("source").alias("node_id"), "target", F.col("edge_ord").cast("bigint"))))


def _visits(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``visit_order`` along links(run_id, node_id, target, edge_ord) between nodes, a stored table."""
    frontier = checkpointed(_first_frontier(nodes, links))
    reached, level, steps, since = frontier, 0, _FIRST_STEPS, 0
    while not frontier.isEmpty():
        if since >= _RENUMBER:
            placed = ranked(frontier, ["run_id"], ["visit_key"], "place")
            frontier, since = placed.withColumn("visit_key", F.array("place")).drop("place"), 0
        ahead = links.join(reached.select("run_id", F.col("node_id").alias("target")), ["run_id", "target"], "left_anti")
        ways = _with_self(nodes, ahead.select(*_NODE, "target", "edge_ord"))
        state = frontier.select(*_NODE, F.struct("hops", "visit_key").alias("visit"))
        for hop in range(level, level + steps):
            stays = F.col("edge_ord").isNull()
            moved = F.struct(F.lit(hop + 1).alias("hops"), F.concat("visit.visit_key", F.array("edge_ord")).alias("visit_key"))
            state = (
                state.join(ways, _NODE)
                .where(stays | (F.col("visit.hops") == hop))
                .groupBy("run_id", F.col("target").alias("node_id"))
                .agg(F.min(F.when(stays, F.col("visit")).otherwise(moved)).alias("visit"))
            )
        new = checkpointed(state.select(*_NODE, "visit.hops", "visit.visit_key").where(F.col("hops") > level))
        level, since = level + steps, since + steps
        reached = reached.unionByName(new)
        frontier = new.where(F.col("hops") == level)
        steps = min(2 * steps, _MOST_STEPS)
    return reached


def _walk(key: tuple, nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Layers of one run by a walk with a queue."""
    nodes = nodes.sort_values(["node_ord", "node_id"], kind="stable")
    names = nodes["node_id"].tolist()
    place = {name: k for k, name in enumerate(names)}
    known = edges[edges["source"].isin(place) & edges["target"].isin(place)].sort_values("edge_ord", kind="stable")
    following: list[list[int]] = [[] for _ in names]
    entered = [False] * len(names)
    for source, target in zip(known["source"].map(place).tolist(), known["target"].map(place).tolist()):
        following[source].append(target)
        entered[target] = True
    queue = deque([k for k, e in enumerate(entered) if not e] or ([0] if names else []))
    layer: dict[int, int] = dict.fromkeys(queue, 0)
    done = [False] * len(names)
    while queue:
        node = queue.popleft()
        if done[node]:
            continue
        done[node] = True
        for target in following[node]:
            if not done[target]:
                if layer.get(target, -1) <= layer[node]:
                    layer[target] = layer[node] + 1
                queue.append(target)
    deepest = max(layer.values(), default=0)
    return pd.DataFrame({"run_id": key[0], "node_id": names, "node_ord": nodes["node_ord"].tolist(), "layer": [layer.get(k, deepest) for k in range(len(names))]})


def graph_layers(nodes: DataFrame, edges: DataFrame, *, small: int = _SMALL) -> DataFrame:
    """Layer of every node of nodes(run_id, node_id, node_ord), edges(run_id, source,
    target, edge_ord).

    A node lies one layer below the deepest neighbour which is visited before it;
    unreached nodes share the largest layer of their run.  A run of at most ``small`` nodes
    and edges is walked in one task, by its counted size; all larger runs advance together in
    jobs over the whole table.  Both give the same layers.
    """
    counted = nodes.groupBy("run_id").count().unionByName(edges.groupBy("run_id").count())
    sizes = stored(counted.groupBy("run_id").agg(F.sum("count").alias("rows")))
    few = sizes.where(F.col("rows") <= small).select("run_id")
    kinds = dict(nodes.dtypes)
    shape = f"run_id {kinds['run_id']}, node_id {kinds['node_id']}, node_ord {kinds['node_ord']}, layer int"
    own = nodes.select(*_NODE, "node_ord").join(few, "run_id").groupBy("run_id")
    of_edges = edges.select("run_id", "source", "target", "edge_ord").join(few, "run_id").groupBy("run_id")
    walked = own.cogroup(of_edges).applyInPandas(_walk, shape)
    many = sizes.where(F.col("rows") > small).select("run_id")
    if many.isEmpty():
        return walked
    return walked.unionByName(_spread_layers(nodes.join(many, "run_id", "left_semi"), edges.join(many, "run_id", "left_semi")))


def _spread_layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph_layers`` for runs of any size.

    Nodes are followed by numbers, so a name meets its node twice only: where edges are
    numbered, which also drops those that lead elsewhere, and at the end.  Rows settle in
    rounds, several to a job, and a round only follows nodes which moved in the one before.
    """
    names = stored(nodes.select(*_NODE).distinct().withColumn("id", F.monotonically_increasing_id()))
    named = stored(nodes.select(*_NODE, "node_ord").join(names, _NODE, "left"))
    numbers = named.select("run_id", F.col("id").alias("node_id"), "node_ord")
    links = stored(
        edges.join(names.select("run_id", F.col("node_id").alias("source"), F.col("id").alias("from")), ["run_id", "source"])
        .join(names.select("run_id", F.col("node_id").alias("target"), F.col("id").alias("to")), ["run_id", "target"])
        .select("run_id", F.col("from").alias("node_id"), F.col("to").alias("target"), F.col("edge_ord").cast("bigint"))
    )
    visits = stored(_visits(numbers, links))
    rank = F.struct("hops", "visit_key")
    ahead = (
        links.where(F.col("node_id") != F.col("target"))
        .select("run_id", "node_id", "target")
        .join(visits.select(*_NODE, rank.alias("s")), _NODE)
        .join(visits.select("run_id", F.col("node_id").alias("target"), rank.alias("t")), ["run_id", "target"])
        .where(F.col("s") < F.col("t"))
        .select(*_NODE, "target", F.lit(0).cast("bigint").alias("edge_ord"))
    )
    ways = stored(_with_self(visits, ahead.distinct()))
    state = visits.select(*_NODE, F.col("hops").alias("layer"), F.lit(True).alias("moved"))
    steps = _FIRST_STEPS
    while True:
        for _ in range(steps):
            stays = F.col("edge_ord").isNull()
            held, wanted = F.max(F.when(stays, F.col("layer"))), F.max(F.when(~stays, F.col("layer") + 1))
            state = (
                state.join(ways, _NODE)
                .where(stays | F.col("moved"))
                .groupBy("run_id", F.col("target").alias("node_id"))
                .agg(held.alias("held"), wanted.alias("wanted"))
                .select(*_NODE, F.greatest("held", "wanted").alias("layer"), F.coalesce(F.col("wanted") > F.col("held"), F.lit(False)).alias("moved"))
            )
        state = checkpointed(state)
        if state.where("moved").isEmpty():
            break
        steps = min(2 * steps, _MOST_STEPS)

    layers = state.drop("moved")
    deepest = layers.groupBy("run_id").agg(F.max("layer").alias("deepest"))
    return (
        named.join(layers.withColumnRenamed("node_id", "id"), ["run_id", "id"], "left")
        .join(deepest, "run_id", "left")
        .select(*_NODE, "node_ord", F.coalesce("layer", "deepest", F.lit(0)).alias("layer"))
    )


def layer_order(layers: DataFrame) -> DataFrame:
    """Position of every node inside its layer, by ``node_ord``.

    A layer may hold most of the nodes: the numbers come from ranges of the whole order, so
    neither the size of a layer nor gaps in ``node_ord`` matter.
    """
    placed = ranked(layers.select("run_id", "node_id", "layer", "node_ord"), ["run_id", "layer"], ["node_ord", "node_id"], "position")
    return placed.drop("node_ord")


def layer_sizes(layers: DataFrame) -> DataFrame:
    """Nodes per layer."""
    return layers.groupBy("run_id", "layer").agg(F.count("*").alias("nodes"))


def layout_extent(layers: DataFrame) -> DataFrame:
    """Number of layers and widest layer per run."""
    return layer_sizes(layers).groupBy("run_id").agg(
        F.count("*").alias("layers"), F.max("nodes").alias("widest")
    )
