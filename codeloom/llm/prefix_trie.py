"""Prefix trie of conversations, from sorted sequences and their common prefixes.

Distinct sequences of turns are sorted; the common prefix (in turns) of neighbours is an
array of numbers, and a trie node is an interval of the order in which that array never
falls below the node's depth.  Each candidate prefix finds its interval by itself: a sparse
table of range minima answers, by powers of two, how far it reaches to the left and to the
right.  There is no stack and no walk over the order, so the order is cut into blocks: a
block knows the sequences next to it, finishes the nodes inside it, and passes on what it
holds of the prefixes which reach over its edges; those parts are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.ranking import ranked
from codeloom.session import stored

HEX = 32  # hex digits of a turn's digest
BLOCK = 8192  # sequences of a block
CHUNK = 2048  # ids which are joined to one text before they travel
NO_ENDS = hashlib.sha256(b"").hexdigest()


# ---- sequences --------------------------------------------------------------


def turn_lists(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, seq): the turns of each conversation in order, as (digest, bytes).

    A null role or text counts as empty; a null turn comes first; turns with one number are
    ordered by the digest of role and text, repeated rows are turns each.  Rows without a
    conversation id belong to no conversation and are left out.
    """
    who, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256), 1, HEX)
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).isNotNull().alias("numbered"), F.col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes")).alias("t"),
    )
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return listed.select("conv_id", F.transform("ts", lambda t: F.struct(t.digest.alias("digest"), t.bytes.alias("bytes"))).alias("seq"))


def regrafted(lists: DataFrame, *, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % family in place of
    its own first h; h = crc32(decimal c) % most.  A base with fewer turns gives all it has,
    an absent one none."""
    heads = lists.select(F.col("conv_id").alias("base"), F.slice("seq", 1, most - 1).alias("head"))
    own = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    h = F.expr(f"cast(crc32(cast(conv_id AS string)) % {most} AS int)")
    none = F.expr("slice(seq, 1, 0)")
    lead = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq"), F.lit(1)))
    return own.join(heads, "base", "left").withColumn("h", h).select("conv_id", F.concat(lead, rest).alias("seq"))


# ---- members which end ------------------------------------------------------


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to (key, first id, ids as one text of at most ``CHUNK``)."""
    kept: tuple | None = None  # key and ids which the next batch may go on with
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if kept:
            keys, ids = [kept[0]] * len(kept[1]) + keys, kept[1] + ids
        starts = [0]
        for i in range(1, len(keys)):
            if keys[i] != keys[i - 1] or i - starts[-1] == CHUNK:
                starts.append(i)
        if not keys:
            continue
        kept = (keys[-1], ids[starts[-1] :])
        yield _chunks(keys, ids, starts)
    if kept:
        yield _chunks([kept[0]], kept[1], [0, len(kept[1])])


def _chunks(keys: list, ids: list, starts: list[int]) -> pa.RecordBatch:
    rows = [(keys[a], ids[a], ",".join(map(str, ids[a:b]))) for a, b in zip(starts[:-1], starts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[], [], []], (pa.string(), pa.int64(), pa.string()))], ["key", "first", "ids"])


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, first, ids) to (key, SHA-256 of all ids of the key, comma-joined)."""
    own, key = None, None
    for batch in batches:
        done = []
        for row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if row != key or own is None:
                if own is not None:
                    done.append((key, own.hexdigest()))
                own, key = hashlib.sha256(ids.encode()), row
            else:
                own.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pylist([{"key": k, "ends": e} for k, e in done], pa.schema([("key", pa.string()), ("ends", pa.string())]))
    if own is not None:
        yield pa.RecordBatch.from_pylist([{"key": key, "ends": own.hexdigest()}])


def ends_hashes(members: DataFrame) -> DataFrame:
    """(key, ends) of members(key, conv_id): a hash over the ascending ids of each key.

    The ids of a hot key are first joined to texts in many tasks, range by range, so that the
    one task which must hash them in order reads a row for every ``CHUNK`` of them.
    """
    placed = members.orderBy("key", "conv_id").mapInArrow(_joined_ids, "key string, first long, ids string")
    return placed.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashed_ids, "key string, ends string")


# ---- blocks of the order ----------------------------------------------------


class RangeMinima:
    """Sparse table: minima of every range whose length is a power of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (step := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[: len(last) - step], last[step:]))

    def least(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minimum of values[a:b] for non-empty ranges."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), self.levels[0].dtype)
        for k in np.unique(level):
            own = level == k
            out[own] = np.minimum(self.levels[k][a[own]], self.levels[k][b[own] - (1 << int(k))])
        return out

    def reach(self, start: np.ndarray, depth: np.ndarray, way: int) -> np.ndarray:
        """How many values in a row are at least ``depth``: from ``start`` up (``way`` 1) or
        from ``start`` - 1 down (``way`` -1).  A binary search by powers of two."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            own, step = self.levels[k], 1 << k
            low = at if way > 0 else at - step
            fits = (low >= 0) & (low < len(own))
            fits[fits] = own[low[fits]] >= depth[fits]
            at = np.where(fits, at + way * step, at)
        return np.abs(at - start)


def _common(a: str, b: str) -> int:
    """Turns which two sequences share from the start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // HEX
    x, y = (np.frombuffer(s[:n].encode(), np.uint8) for s in (a, b))
    return int(np.argmax(x != y)) // HEX


def _prefix(key: str, depth: int) -> str:
    return f"{depth}:" + hashlib.sha256(key[: HEX * depth].encode()).hexdigest()[:HEX]


def _block_nodes(rows: list[dict], before: str | None, after: str | None) -> dict[str, list | np.ndarray]:
    """Trie nodes of the sorted sequences of one block, given the neighbours' keys.

    Columns: depth, conv_id, n, children, leaves, shared (bytes), above (bytes of the turns
    over the node's own), ends, up (parent's conv_id), open (the prefix reaches over an
    edge: then its values are those of this block), name, up_name (prefixes that are open).
    """
    m = len(rows)
    keys = [r["key"] for r in rows]
    size = np.array([len(k) // HEX for k in keys], np.int64)
    weight = np.array([r["n"] for r in rows], np.int64)
    lowest = np.array([r["conv_id"] for r in rows], np.int64)
    sums = [np.concatenate([[0], np.cumsum(np.array(r["bytes"], np.int64))]) for r in rows]
    lcp = np.array([-1 if before is None else _common(before, keys[0]), *(_common(a, b) for a, b in zip(keys, keys[1:])),
                    -1 if after is None else _common(keys[-1], after)], np.int64)
    inner = RangeMinima(lcp[1:m])  # inner[k] is between rows k and k + 1
    smallest = RangeMinima(lowest)

    def interval(at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return at - inner.reach(at, depth, -1), at + inner.reach(at, depth, 1)

    # candidates: what neighbours share, and whole sequences
    at = np.concatenate([np.arange(1, m), np.arange(m)])
    depth = np.concatenate([lcp[1:m], size])
    left, right = interval(at, depth)
    branch = np.arange(len(at)) < m - 1
    code, first, which = np.unique(left * m + right, return_index=True, return_inverse=True)
    forks = np.bincount(which[branch], minlength=len(code))
    left, right, depth = left[first], right[first], depth[first]
    # every candidate stands for the depths down from it to the next wider one
    wider = np.maximum(np.where(left > 0, lcp[left], -1), np.where(right < m - 1, lcp[right + 1], -1))
    times = depth - wider
    own = np.repeat(np.arange(len(left)), times)
    d = np.repeat(depth, times) - (np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times))
    l, r, deepest = left[own], right[own], np.repeat(depth, times) == d
    starts = lcp[l] < d  # the prefix begins here, not in a block before
    open_ = ~starts | (lcp[r + 1] >= d)

    def over(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[r + 1] - total[l]

    bytes_of = np.array([s[-1] for s in sums], np.int64)
    met = np.array([s[max(k, 0)] for s, k in zip(sums, lcp[:m])], np.int64)  # bytes shared with the row before
    above = np.array([sums[i][max(k - 1, 0)] for i, k in zip(l.tolist(), d.tolist())], np.int64)
    low = smallest.least(l, r + 1)
    up_l, up_r = interval(l, np.maximum(d - 1, 0))
    up = smallest.least(up_l, up_r + 1)
    up_open = (d > 0) & ((lcp[up_l] >= d - 1) | (lcp[up_r + 1] >= d - 1))
    return {
        "depth": d,
        "conv_id": low,
        "n": over(weight),
        # a child begins with the first row, or where the next row leaves what it shared
        "children": np.where(deepest, forks[own], 0) + ((size[l] > d) & starts) + ((lcp[l] == d) & (l == 0) & (size[l] > d)),
        "leaves": over((lcp[1:] < size).astype(np.int64)),
        "shared": over((weight - 1) * bytes_of) + over(met) - np.where(starts, met[l], 0),
        "above": above,
        "ends": [rows[i]["ends"] if s and size[i] == k else None for i, k, s in zip(l.tolist(), d.tolist(), starts.tolist())],
        "up": np.where(d > 0, up, -1),
        "open": open_,
        "name": [_prefix(keys[i], k) if o else None for i, k, o in zip(l.tolist(), d.tolist(), open_.tolist())],
        "up_name": [_prefix(keys[i], k - 1) if o else None for i, k, o in zip(l.tolist(), d.tolist(), up_open.tolist())],
    }


_SHAPE = {
    "block": "long", "depth": "long", "conv_id": "long", "n": "long", "children": "long", "leaves": "long", "shared": "long",
    "above": "long", "ends": "string", "up": "long", "open": "boolean", "name": "string", "up_name": "string",
}


def _follow_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (block, place) to the nodes of each block."""
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def nodes(block: int, rows: list[dict]) -> pa.RecordBatch:
        inside = [r for r in rows if r["own"]]
        before = next((r["key"] for r in rows if not r["own"] and r["place"] < inside[0]["place"]), None)
        after = next((r["key"] for r in rows if not r["own"] and r["place"] > inside[0]["place"]), None)
        found = _block_nodes(inside, before, after)
        found["block"] = np.full(len(found["depth"]), block)
        return pa.RecordBatch.from_arrays([pa.array(found[c], kinds[k]) for c, k in _SHAPE.items()], list(_SHAPE))

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[0]["block"] != row["block"]:
                yield nodes(held[0]["block"], held)
                held = []
            held.append(row)
    if held:
        yield nodes(held[0]["block"], held)


def prefix_trie(sequences: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """One row per distinct prefix of sequences(conv_id long, seq array<digest, bytes>):
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conv_id`` is the smallest id whose sequence begins with the prefix, so a node is named
    by (conv_id, depth).  ``saved_tokens`` sums, over the subtree, the bytes of a node's last
    turn for every member but one.  The root (depth 0) has all sequences, empty ones too; an
    empty table has no root.  A task holds ``block`` distinct sequences; equal sequences are
    one, however many there are.
    """
    named = sequences.select("conv_id", F.array_join(F.transform("seq", lambda t: t.digest), "").alias("key"), F.transform("seq", lambda t: t.bytes).alias("bytes"))
    named = stored(named)
    hashed: Column = F.sha2("key", 256)
    ends = ends_hashes(named.select(hashed.alias("key"), "conv_id")).withColumnRenamed("key", "of")
    classes = named.groupBy("key", "bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    classes = stored(classes.join(ends, hashed == F.col("of")).drop("of"))

    order = ranked(classes, [], ["key"], "place").withColumn("place", F.col("place") - 1)
    last = (max(classes.count(), 1) - 1) // block
    home = F.expr(f"cast(floor(place / {block}) AS bigint)")
    edge = F.when(F.col("place") % block == 0, home - 1).when(F.col("place") % block == block - 1, home + 1)
    sent = order.withColumn("home", home).withColumn("block", F.explode(F.array_compact(F.array(home, edge))))
    sent = sent.where(F.col("block").between(0, last)).withColumn("own", F.col("block") == F.col("home")).drop("home")
    sent = sent.repartition("block").sortWithinPartitions("block", "place")
    found = stored(sent.mapInArrow(_follow_blocks, ", ".join(f"{c} {k}" for c, k in _SHAPE.items())))

    parts = found.where("open")
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "shared")]
    whole = parts.groupBy("name", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.first("above").alias("above"), F.max("ends").alias("ends"), F.first("up_name", True).alias("up_name"))
    whole = stored(whole)
    ids = whole.select(F.col("name").alias("up_name"), F.col("conv_id").alias("whole_up"))
    # what an open prefix is called is sent back to the blocks which hold a part of it
    told = stored(parts.select("block", "name").join(whole.select("name", F.col("conv_id").alias("whole_up")), "name").withColumnRenamed("name", "up_name"))
    inside = found.where("not open").join(told, ["block", "up_name"], "left").withColumn("up", F.coalesce("whole_up", "up"))
    reaching = whole.join(ids, "up_name", "left").withColumnRenamed("whole_up", "up")
    columns = ["conv_id", "depth", "up", "n", "children", "leaves", "shared", "above", "ends"]
    return inside.select(*columns).union(reaching.select(*columns)).select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("up")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("shared") - (F.col("n") - 1) * F.col("above")).alias("saved_tokens"), F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
