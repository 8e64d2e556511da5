"""Merkle manifest of a dataset, with a witness for every row.

Rows are leaves; every ``WIDTH`` consecutive nodes of a level have one parent, per group,
and the groups' roots are the leaves of one more tree.  Leaves are appended to aligned
blocks: a block keeps its open subtrees, each with the partial witnesses of its leaves, and
the completion of a run of siblings extends all of them.  The root of a block is itself
appended to the block above it, so that the witness of a block, found in the same way,
extends those of its leaves.  Spark deals out the blocks, so a group of any size is many
tasks, and a task holds one block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ranking import ranked
from codeloom.session import stored

WIDTH = 8  # children of a node
LEVELS = 4  # levels of a block: 4,096 leaves


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256, as lowercase hex, of the fields: ``-`` for a null, else its UTF-8 length in
    bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    own = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*own), 256)


def height(n: int) -> int:
    """Levels above ``n`` leaves until one node remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WIDTH), levels + 1
    return levels


class Block:
    """Aligned block of at most ``WIDTH ** levels`` leaves which grows by appends."""

    def __init__(self, levels: int):
        self.levels = levels
        self.open: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[list[str]] = []

    def append(self, digest: str) -> None:
        self.witnesses.append([])
        self._push(0, digest, len(self.witnesses) - 1, len(self.witnesses))

    def _push(self, level: int, digest: str, first: int, end: int) -> None:
        self.open[level].append((digest, first, end))
        if level < self.levels and len(self.open[level]) == WIDTH:
            self._complete(level)

    def _complete(self, level: int) -> None:
        """The open siblings become one node; their leaves' witnesses grow by a step."""
        run, self.open[level] = self.open[level], []
        names = [digest for digest, _, _ in run]
        for place, (_, first, end) in enumerate(run):
            step = f"{place}{len(run) - 1}" + "".join(names[:place] + names[place + 1 :])
            for own in self.witnesses[first:end]:
                own.append(step)
        self._push(level + 1, _hash("".join(names)), run[0][1], run[-1][2])

    def finish(self) -> str:
        """Root of the block; the last runs may be short."""
        for level in range(self.levels):
            if self.open[level]:
                self._complete(level)
        return self.open[self.levels][0][0]


def steps(witness: str) -> list[tuple[int, list[str]]]:
    """(place among its siblings, their digests from left to right) per level."""
    found, at = [], 0
    while at < len(witness):
        place, n = int(witness[at]), int(witness[at + 1])
        found.append((place, [witness[at + 2 + 64 * k : at + 66 + 64 * k] for k in range(n)]))
        at += 2 + 64 * n
    return found


def fold(digest: str, way: list[tuple[int, list[str]]]) -> str:
    """The root which a leaf and its siblings give."""
    for place, siblings in way:
        digest = _hash("".join(siblings[:place]) + digest + "".join(siblings[place:]))
    return digest


def _sorted_blocks(rows: DataFrame, levels: int) -> DataFrame:
    dealt = rows.withColumn("block", F.expr(f"cast(floor(greatest(place, 0) / {WIDTH**levels}) AS bigint)"))
    dealt = dealt.withColumn("block", F.coalesce("head_of", "block")).drop("head_of")
    return dealt.repartition("g", "block").sortWithinPartitions("g", "block", "place")


def _runs(batches: Iterator[pa.RecordBatch], key: tuple[str, ...] = ("g", "block")) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of one key, also across batches."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for own, run in groupby(rows, key=itemgetter(*key)):
        yield own, list(run)


def _block_roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(g, place, digest, n) of the blocks of ``nodes``, which has the same columns."""

    def run(batches):
        for (g, block), rows in _runs(batches):
            own = Block(min(levels, height(rows[0]["n"])))
            for row in rows:
                own.append(row["digest"])
            yield pa.RecordBatch.from_pylist(
                [{"g": g, "place": block, "digest": own.finish(), "n": -(-rows[0]["n"] // WIDTH**levels)}],
                schema=pa.schema([("g", pa.string()), ("place", pa.int64()), ("digest", pa.string()), ("n", pa.int64())]),
            )

    plain = nodes.select("g", "place", "digest", "n", F.lit(None).cast("bigint").alias("head_of"))
    return _sorted_blocks(plain, levels).mapInArrow(run, "g string, place long, digest string, n long")


def _witnesses(nodes: DataFrame, above: DataFrame | None, levels: int) -> DataFrame:
    """(g, place, witness) of ``nodes``; ``above``: the same for the blocks."""

    def run(batches):
        for (g, _), rows in _runs(batches):
            rest = "".join(r["witness"] for r in rows if r["place"] < 0)
            own = Block(min(levels, height(rows[-1]["n"])))
            rows = [r for r in rows if r["place"] >= 0]
            for row in rows:
                own.append(row["digest"])
            own.finish()
            yield pa.RecordBatch.from_pylist(
                [{"g": g, "place": r["place"], "witness": "".join(w) + rest} for r, w in zip(rows, own.witnesses)],
                schema=pa.schema([("g", pa.string()), ("place", pa.int64()), ("witness", pa.string())]),
            )

    none = F.lit(None)
    rows = nodes.select("g", "place", "digest", "n", none.cast("string").alias("witness"), none.cast("bigint").alias("head_of"))
    if above is not None:
        heads = above.select("g", F.lit(-1).alias("place"), none.cast("string"), none.cast("bigint"), "witness", F.col("place").alias("head_of"))
        rows = rows.union(heads)
    return _sorted_blocks(rows, levels).mapInArrow(run, "g string, place long, witness string")


def _grown(nodes: DataFrame, largest: int, levels: int) -> list[DataFrame]:
    """``nodes`` and the block roots above them, round by round, until every group has one."""
    rounds = [nodes]
    while largest > 1:
        rounds.append(stored(_block_roots(rounds[-1], levels)))
        largest = -(-largest // WIDTH**levels)
    return rounds


def _blocks_above(rounds: list[DataFrame], levels: int) -> DataFrame | None:
    """(g, place, witness) of the blocks of the first round."""
    above = None
    for nodes in reversed(rounds[1:]):
        above = stored(_witnesses(nodes, above, levels))
    return above


def manifest(rows: DataFrame, *, group: str, key: str, leaf: str, probe: str, with_witness: bool = False, levels: int = LEVELS) -> DataFrame:
    """``key``, leaf, subroot, root, proof_sha256, folded_root, verified (and witness) per row.

    ``rows`` has a text column ``group`` (one tree each; null is a group, and the first), the
    ``key`` which orders a group's leaves (nulls first), the leaf digests, and the digests
    ``probe`` that are checked against the manifest.  ``proof_sha256`` is the hash of the
    leaf's siblings, level by level and left to right, through the group's root to the root;
    ``folded_root`` is what the probe and these siblings give.  Rows with equal keys are
    ordered by their leaf; repeated rows are leaves each.  An empty table gives no rows.
    """
    named = rows.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("g"),
        F.col(key).alias("key"), F.col(leaf).alias("digest"), F.col(probe).alias("probe"),
    )
    placed = ranked(stored(named), ["g"], ["key", "digest"], "place").withColumn("place", F.col("place") - 1)
    sizes = stored(placed.groupBy("g").agg(F.count("*").alias("n")))
    leaves = stored(placed.join(sizes, "g"))
    largest, groups = sizes.agg(F.max("n"), F.count("*")).first()
    rounds = _grown(leaves, largest or 0, levels)
    if len(rounds) == 1:  # lone leaves are their own blocks
        rounds.append(stored(_block_roots(leaves, levels)))
    subroots = rounds[-1]

    top = ranked(subroots.select("g", "digest"), [], ["g"], "place")
    top = stored(top.select(F.lit("").alias("g"), (F.col("place") - 1).alias("place"), "digest", F.lit(groups).cast("bigint").alias("n"), F.col("g").alias("of")))
    tops = _grown(top, groups, levels)
    root = tops[-1].select(F.col("digest").alias("root")).first()
    over = stored(_witnesses(top, _blocks_above(tops, levels), levels)).join(top, ["g", "place"])
    over = stored(over.select(F.col("of").alias("g"), F.col("digest").alias("subroot"), F.col("witness").alias("over")))

    blocks = _blocks_above(rounds, levels).join(over, "g")
    none = F.lit(None)
    own = leaves.select("g", "place", "digest", "n", "key", "probe", none.cast("string").alias("witness"),
                        none.cast("string").alias("subroot"), none.cast("bigint").alias("head_of"))
    heads = blocks.select("g", F.lit(-1), none.cast("string"), none.cast("bigint"), none, none.cast("string"), F.concat("witness", "over"),
                          "subroot", F.col("place").alias("head_of"))
    kind = dict(rows.dtypes)[key]
    whole = root["root"] if root else ""
    fields = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches):
        for batch in _proved(batches, whole, levels):
            yield batch if with_witness else batch.drop_columns(["witness"])

    shape = f"key {kind}, {', '.join(f'{f} string' for f in fields)}, verified boolean" + (", witness string" if with_witness else "")
    return _sorted_blocks(own.union(heads), levels).mapInArrow(run, shape).withColumnRenamed("key", key)


def _proved(batches: Iterator[pa.RecordBatch], root: str, levels: int) -> Iterator[pa.RecordBatch]:
    """Witnesses of one block after the other, and what they prove."""
    kind = None

    def typed():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("key").type
            yield batch

    for _, rows in _runs(typed()):
        head = next(r for r in rows if r["place"] < 0)
        rows = [r for r in rows if r["place"] >= 0]
        own = Block(min(levels, height(rows[0]["n"])))
        for row in rows:
            own.append(row["digest"])
        own.finish()
        upper = steps(head["witness"])
        upper_text = "".join("".join(s) for _, s in upper)
        folded: dict[str, str] = {}  # root which a root of this block gives
        out = {name: [] for name in ("proof_sha256", "folded_root", "witness")}
        for row, witness in zip(rows, own.witnesses):
            way = steps("".join(witness))
            end = fold(row["probe"], way)
            if end not in folded:
                folded[end] = fold(end, upper)
            out["proof_sha256"].append(_hash("".join("".join(s) for _, s in way) + upper_text))
            out["folded_root"].append(folded[end])
            out["witness"].append("".join(witness) + head["witness"])
        names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "witness"]
        yield pa.RecordBatch.from_arrays([
            pa.array([r["key"] for r in rows], kind), pa.array([r["digest"] for r in rows]), pa.array([head["subroot"]] * len(rows)),
            pa.array([root] * len(rows)), pa.array(out["proof_sha256"]), pa.array(out["folded_root"]),
            pa.array([f == root for f in out["folded_root"]]), pa.array(out["witness"]),
        ], names)
