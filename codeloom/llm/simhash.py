"""SimHash near-duplicates by a self-join of a binary trie.

Distinct fingerprints are the leaves of a binary trie.  Two nodes of equal depth are
followed together; every level adds the differing bit, and a pair of nodes over the error
budget is left.  The upper levels of the trie are dealt out by Spark: a fingerprint goes to
the subtree of its prefix and, as a visitor, to the subtrees whose prefix is within the
budget.  Each subtree's pairs are followed in one task, all node pairs of a level at once.
A task gives a spanning forest of its links, so groups of copies never become all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import checkpointed, stored

SUBTREE = 1 << 14  # fingerprints which a subtree has on average
LEAF = 32  # node pairs with at most so many fingerprint pairs are compared directly


def _shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every word shingle, big-endian; none for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, ">u8")
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed=42)], ">u8")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())], ">u8")


def _fingerprint(text: str | None, width: int) -> int:
    hashes = _shingle_hashes(text, width)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long): SimHash of the word shingles of whole texts.

    A text with fewer words than ``width`` has one shingle of all its words; one without
    words (or null) has fingerprint 0.  ``fp`` holds the 64 bits as a signed long.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_fingerprint(t.as_py(), width) for t in batch.column(1)]
            fp = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, fp long")


def close_pairs(home: np.ndarray, other: np.ndarray | None, depth: int, spent_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into ``home``, into ``other``) within the budget; sorted unsigned input.

    Without ``other`` the pairs are inside ``home``, each once.  All have a common prefix of
    ``depth`` bits each; the prefixes differ in whatever the values say.
    ``spent_bits`` is the budget.
    """
    same = other is None
    right = home if same else other
    if not len(home) or not len(right):
        return
    top = np.uint64(0) if depth == 0 else np.uint64(((1 << depth) - 1) << (64 - depth))
    first = int(np.bitwise_count((home[0] ^ right[0]) & top))
    if first > spent_bits:
        return
    a0, a1, b0, b1 = (np.array([x], np.int64) for x in (0, len(home), 0, len(right)))
    spent = np.array([first], np.int8)
    while len(a0):
        small = ((a1 - a0) * (b1 - b0) <= LEAF) | (depth == 64)
        if small.any():
            n = (a1 - a0)[small] * (b1 - b0)[small]
            step = max(1, int(np.searchsorted(np.cumsum(n), 1 << 22)) or 1)
            pick = np.flatnonzero(small)
            for at in range(0, len(pick), step):
                own = pick[at : at + step]
                n = (a1 - a0)[own] * (b1 - b0)[own]
                node = np.repeat(own, n)
                k = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
                wide = (b1 - b0)[node]
                i, j = a0[node] + k // wide, b0[node] + k % wide
                near = np.bitwise_count(home[i] ^ right[j]) <= spent_bits
                if same:
                    near &= i < j
                yield i[near], j[near]
        a0, a1, b0, b1, spent = a0[~small], a1[~small], b0[~small], b1[~small], spent[~small]
        if not len(a0):
            return
        shift = np.uint64(63 - depth)

        def halves(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            """Where the ones begin: the node's values are sorted and agree above this bit."""
            ones = np.concatenate([[0], np.cumsum((values >> shift) & np.uint64(1), dtype=np.int64)])
            return high - (ones[high] - ones[low])

        am, bm = halves(home, a0, a1), halves(right, b0, b1)
        parts = []
        for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            cost = spent + np.int8(more)
            keep = (cost <= spent_bits) & (x1 > x0) & (y1 > y0)
            if same and more and x0 is am:  # a node with itself: 01 and 10 are the same pairs
                keep &= a0 != b0
            parts.append([v[keep] for v in (x0, x1, y0, y1, cost)])
        a0, a1, b0, b1, spent = (np.concatenate(v) for v in zip(*parts))
        depth += 1


class Forest:
    """Components over positions 0..n-1, joined by batches of links."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.root[i], self.root[j]
            open_ = a != b
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            if not len(i):
                return
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _subtree_links(values: np.ndarray, home: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that begin at home: pairs of fingerprints."""
    own = np.sort(values[home])
    guests = np.sort(values[~home])
    every = np.concatenate([own, guests])
    forest = Forest(len(every))
    for i, j in close_pairs(own, None, depth, budget):
        forest.join(i, j)
    if len(guests):
        top = guests >> np.uint64(64 - depth) if depth else np.zeros(len(guests), np.uint64)
        edges = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            for i, j in close_pairs(own, guests[a:b], depth, budget):
                forest.join(i, j + len(own) + a)
    child = np.flatnonzero(forest.root != np.arange(len(every)))
    return every[child], every[forest.root[child]]


def links(distinct: DataFrame, *, budget: int = 2, subtree: int = SUBTREE) -> DataFrame:
    """(a, b): links between different fingerprints which span the components.

    ``distinct``: a stored table with one row per fingerprint (``fp``).  The depth at which
    the trie is dealt out follows the number of fingerprints.  A subtree with far more of
    them than the others is dealt out again by blocks of its home fingerprints; what it
    visits is then sent to each block.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    depth = max(4, int(np.ceil(np.log2(max(n, 1) / subtree + 1))))
    masks = [sum(1 << (depth - 1 - k) for k in c) for r in range(budget + 1) for c in combinations(range(depth), r)]
    prefix = F.shiftrightunsigned("fp", 64 - depth)
    rows = distinct.select("fp", prefix.alias("prefix"))
    sizes = rows.groupBy("prefix").agg(F.ceil(F.count("*") / F.lit(2 * subtree)).cast("int").alias("blocks"))
    sizes = sizes.withColumnRenamed("prefix", "node")  # at most 2^depth rows: n / subtree
    guests = rows.select(
        "fp", "prefix", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("prefix").bitwiseXOR(m))).alias("node")
    ).where("node <= prefix")
    # every row of a node: its own fingerprints go to one block as home, and like all
    # visitors they are sent to the blocks of the same node before it
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    sent = (
        guests.join(sizes, "node")
        .withColumn("own", F.when(F.col("node") == F.col("prefix"), block).otherwise(F.col("blocks") - 1))
        .select("fp", "node", "own", (F.col("node") == F.col("prefix")).alias("inside"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("block"))
        .select("fp", "node", "block", (F.col("inside") & (F.col("own") == F.col("block"))).alias("home"))
    )

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        values = group["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = _subtree_links(values, group["home"].to_numpy(bool), depth, budget)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return sent.groupBy("node", "block").applyInPandas(follow, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes with a link.

    Large-star and small-star steps in turn: in each every node's neighbours are linked to
    the smallest one they know.  Minima are partial aggregates and the rest are joins, so a
    node with very many links is no task of its own.  Every round is checkpointed.
    """
    links_ = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = links_.union(links_.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = checkpointed(small.where("u <> v").distinct())
        if new.count() == links_.count() and new.exceptAll(links_).isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        links_ = new


def near_duplicates(docs: DataFrame, *, width: int = 3, budget: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id, n_links) per row of ``docs``.

    ``component_id`` is the smallest document id that can be reached by links of at most
    ``budget`` differing bits.  Equal fingerprints are linked, among them the zero of texts
    without words.  Rows with a null document id belong to the component like others; the
    smallest non-null id names it.  Repeated rows are returned each.
    """
    prints = stored(fingerprints(docs, width=width, doc_id=doc_id, text=text))
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    found = stored(components(stored(links(classes.select("fp"), budget=budget))))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(rooted.join(smallest, "root").select("fp", "component_id"))
    return prints.join(named, "fp")
