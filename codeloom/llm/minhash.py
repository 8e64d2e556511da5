"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of word shingles.  Signatures are cut into bands; sets which agree in a
band are candidates.  The signatures of a pair are compared batch by batch: with a uniform
prior, the matches so far give a posterior of the similarity, and a pair is dropped as soon
as the posterior chance to reach the limit is below the miss probability.  What survives all
batches is decided on the whole shingle sets.

Equal sets are one class.  Every class first meets two classes of each bucket it is in, the
most popular one and one by a hash, which settles groups of near copies.  Buckets which still
hold several components are then compared inside, in blocks of bounded size, and only pairs
of different components are looked at.  A large bucket's sets travel with its rows, so that
its pairs are decided where they meet and only a spanning forest of links leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.simhash import components
from codeloom.session import stored

BANDS, ROWS = 25, 5  # a pair of similarity 0.85 shares no band with a chance of 4e-7
HASHES = BANDS * ROWS
BATCH = 25  # hashes compared between two looks at the posterior
MISS = 1e-6  # posterior chance below which a pair is dropped
SMALL = 64  # buckets with at most so many rows send out all pairs that survive
BLOCK = 256  # rows of one side of a comparison inside a larger bucket
FILTER_BITS = 26  # the texts whose sets are needed as a bit table of fixed size: 8 MB
WORDS_KEPT = 1 << 18  # word hashes which a worker keeps
_SPLIT = 1 << 20  # pairs compared at once


# ---- sets and signatures ----------------------------------------------------


class _WordHashes(dict):
    """XXH64 of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) > 64:
            return xxhash.xxh64_intdigest(word)
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text, A-Z lower-cased;
    fewer words than ``width`` are one shingle, no words none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(42)
    return random.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 1 << 63, HASHES, np.uint64)


def signature(own: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """Least value of every hash function over a non-empty set."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), 512):
        np.minimum(low, (own[a : a + 512, None] * factors + shifts).min(axis=0), out=low)
    return low


def prints(docs: DataFrame, *, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, d0, d1, bands array<long>, sig binary) per row.

    ``d0`` and ``d1`` are a 128-bit digest of the set, ``text_key`` one of the text; ``bands``
    hashes the signature band by band (none for an empty set) and ``sig`` has 8 bits of
    every value: by chance different values match once in 256 times, which only lets more
    pairs through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, (factors, shifts) = _WordHashes(), _seeds()
        for batch in batches:
            sizes, digests, bands, short = [], [], [], []
            for t in batch.column(2):
                own = shingle_set(t.as_py(), width, known)
                sizes.append(len(own))
                digests.append(xxhash.xxh128_digest(own.tobytes()))
                if len(own):
                    values = _mixed(signature(own, factors, shifts))
                    parts = (values >> np.uint64(32)).astype(np.uint32).reshape(BANDS, ROWS)
                    bands.append([xxhash.xxh64_intdigest(p.tobytes(), k) - (1 << 63) for k, p in enumerate(parts)])
                    short.append((values & np.uint64(0xFF)).astype(np.uint8).tobytes())
                else:
                    bands.append([])
                    short.append(b"")
            pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(d)) for d in pair.T),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(short, pa.binary())],
                ["doc_id", "text_key", "n_shingles", "d0", "d1", "bands", "sig"],
            )

    kind = dict(docs.dtypes)[doc_id]
    return _keyed(docs, doc_id, text).mapInArrow(run, f"doc_id {kind}, text_key string, n_shingles long, d0 long, d1 long, bands array<long>, sig binary")


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.md5(own).alias("text_key"), own.alias("text"))


# ---- sequential verification ------------------------------------------------


def fewest_matches(limit: float, miss: float = MISS) -> list[int]:
    """Matches that a pair needs after 1, 2, ... batches to be looked at further.

    With a uniform prior the similarity after m of n matches is Beta(m + 1, n - m + 1); its
    chance to be ``limit`` or more is that of at most m successes in n + 1 trials of
    ``limit``."""
    need = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * limit**m * (1 - limit) ** (n + 1 - m)
        need.append(m)
    return need


def survivors(left: np.ndarray, right: np.ndarray, need: list[int]) -> np.ndarray:
    """Indices of the row pairs of two signature tables that no batch rules out."""
    open_, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for k, least in enumerate(need):
        own = slice(BATCH * k, BATCH * (k + 1))
        matches += (left[open_, own] == right[open_, own]).sum(axis=1)
        keep = matches >= least
        open_, matches = open_[keep], matches[keep]
    return open_


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, HASHES)


def _sizes_fit(a: Column | np.ndarray, b: Column | np.ndarray, percent: int):
    """Set sizes that are further apart cannot be similar enough."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def _pruned(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs which neither sizes nor signatures rule out."""
    need = fewest_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array(survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), need))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("x"), F.col("n_shingles").alias("n_x"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("y"), F.col("n_shingles").alias("n_y"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").where(_sizes_fit(F.col("n_x"), F.col("n_y"), percent))
    return met.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


# ---- whole sets ---------------------------------------------------------------


def _bit(key: str | Column) -> Column:
    """The place of a text's key (MD5 in hex) in the bit table."""
    return F.shiftright(F.conv(F.substring(key, 1, 7), 16, 10).cast("long"), 28 - FILTER_BITS)


def _bit_table(named: DataFrame) -> np.ndarray:
    """Bit table, of fixed size, of the wanted texts."""
    place = _bit("first_key")
    words = named.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("at"))
    found = words.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def _sets(nodes: DataFrame, classes: DataFrame, docs: DataFrame, *, width: int, doc_id: str, text: str) -> DataFrame:
    """(node, shingles), stored: the whole sets of some classes.

    Sets are not kept from the first pass: they are made anew from the texts of the classes'
    first documents.  A bit table keeps other texts out of the exchange; what it lets through
    by chance has no partner in the join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, known).view(np.int64) for t in batch.column(1)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            every = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), every)], ["node", "shingles"])

    wanted = nodes.distinct()
    named = classes.select("node", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"))
    named = stored(named.join(wanted.hint("merge"), "node", "left_semi"))
    shared = docs.sparkSession.sparkContext.broadcast(_bit_table(named))

    @F.pandas_udf("boolean")
    def likely(place: pd.Series) -> pd.Series:
        at = place.to_numpy(np.int64)
        return pd.Series((shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0)

    keyed = _keyed(docs, doc_id, text).where(likely(_bit("text_key")))
    met = keyed.join(named.hint("merge"), (F.col("text_key") == F.col("first_key")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return stored(met.select("node", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs whose whole sets have the similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    found = met.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return found.where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both"))).select("a", "b")


# ---- open buckets -----------------------------------------------------------


def _run_pairs(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j inside runs, in slices of bounded size."""
    rows = np.repeat(starts + lengths, lengths) - np.arange(starts[0], starts[0] + lengths.sum()) - 1  # later rows of the run
    first, ends = int(starts[0]), np.cumsum(rows)
    a = 0
    while a < len(rows):
        done = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, done + _SPLIT, "right")))
        n = rows[a:b]
        i = np.repeat(np.arange(a, b), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        yield i + first, j + first
        a = b


class _Runs:
    """Rows sorted by (key, x, y), handed over in whole runs of equal values."""

    def __init__(self, handle):
        self.handle = handle

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k) for k in range(3)]
            if held and any(held[-1].column(k)[-1] != own[k][0] for k in range(3)):
                yield self.handle(pa.Table.from_batches(held))
                held = []
            last = pc.and_(pc.and_(*(pc.equal(c, c[-1]) for c in own[:2])), pc.equal(own[2], own[2][-1]))
            cut = batch.num_rows - pc.sum(last).as_py()  # the last run may go on
            if cut:
                yield self.handle(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield self.handle(pa.Table.from_batches(held))


def _alike(table: pa.Table, need: list[int], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of different components inside the runs of (key, x, y) that neither sizes
    nor signatures rule out.  In a run of two blocks only rows of different ones meet."""
    column = {c: table.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "x", "y", "own", "root", "n_shingles")}
    sigs, n, own = _signatures(table.column("sig").combine_chunks()), column["n_shingles"], column["own"]
    change = np.zeros(len(sigs), bool)
    change[0] = True
    for c in ("key", "x", "y"):
        change[1:] |= column[c][1:] != column[c][:-1]
    starts = np.flatnonzero(change)
    for i, j in _run_pairs(starts, np.diff(np.concatenate([starts, [len(sigs)]]))):
        fits = (column["root"][i] != column["root"][j]) & _sizes_fit(n[i], n[j], percent)
        fits &= (own[i] != own[j]) | (column["x"][i] == column["y"][i])
        i, j = i[fits], j[fits]
        for a in range(0, len(i), 1 << 16):
            keep = survivors(sigs[i[a : a + (1 << 16)]], sigs[j[a : a + (1 << 16)]], need)
            yield i[a + keep], j[a + keep]


def _pair_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    every = np.unique(np.sort(np.stack([a, b], axis=1), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v), pa.int64()) for v in every.T], ["a", "b"])


def _open_buckets(members: DataFrame) -> DataFrame:
    """(key, node, root, rows, own, t): the rows of buckets with several components, once for
    each comparison (t.x, t.y) they take part in.

    A bucket of at most ``SMALL`` rows is one comparison.  In a larger one the rows of the
    component with most rows in it (its main one) only meet the others; blocks of both sides
    meet, two at a time, so a bucket of any size is spread.
    """
    rows = members.groupBy("key", "root").agg(F.count("*").alias("rows"))
    main = rows.groupBy("key").agg(F.max(F.struct("rows", "root")).alias("m"), F.sum("rows").alias("rows"), F.count("*").alias("roots"))
    main = stored(main.where("roots > 1").selectExpr(
        "key", "rows", "m.root AS main", f"cast(ceil(m.rows / {BLOCK}) AS int) AS n_main", f"cast(ceil((rows - m.rows) / {BLOCK}) AS int) AS n_rest"))
    spread = F.xxhash64("node")
    own = F.when(F.col("root") == F.col("main"), -1 - F.pmod(spread, F.col("n_main"))).otherwise(F.pmod(spread, F.col("n_rest")))
    own = F.when(F.col("rows") > SMALL, own).otherwise(0).cast("int")
    placed = members.select("key", "node", "root").join(main.hint("merge"), "key").withColumn("own", own)
    others = F.sequence(F.lit(0), F.col("n_rest") - 1)
    mains = F.sequence(F.lit(-1), -F.col("n_main"), F.lit(-1))
    met = F.when(F.col("own") < 0, F.transform(others, lambda o: F.struct(F.col("own").alias("x"), o.alias("y")))).otherwise(
        F.concat(
            F.transform(mains, lambda m: F.struct(m.alias("x"), F.col("own").alias("y"))),
            F.transform(others, lambda o: F.struct(F.least("own", o).alias("x"), F.greatest("own", o).alias("y"))),
        )
    )
    alone = F.array(F.struct(F.col("own").alias("x"), F.col("own").alias("y")))
    return placed.select("key", "node", "root", "rows", "own", F.explode(F.when(F.col("rows") > SMALL, met).otherwise(alone)).alias("t"))


_SENT = ["key", "x", "y", "own", "root", "node", "n_shingles", "sig"]


def _dealt(rows: DataFrame, classes: DataFrame) -> DataFrame:
    sigs = classes.select("node", "n_shingles", "sig").hint("merge")
    return rows.select("key", "t.x", "t.y", "own", "root", "node").join(sigs, "node")


def _small_pairs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidate pairs of the small buckets."""
    need = fewest_matches(percent / 100)

    def handle(table: pa.Table) -> pa.RecordBatch:
        node = table.column("node").combine_chunks().to_numpy()
        found = [(node[i], node[j]) for i, j in _alike(table, need, percent)]
        none = np.zeros(0, np.int64)
        return _pair_batch(*(np.concatenate([none, *v]) for v in (zip(*found) if found else ((), ()))))

    sent = _dealt(rows, classes).select(*_SENT).repartition("key").sortWithinPartitions("key", "x", "y")
    return sent.mapInArrow(_Runs(handle), "a long, b long").distinct()


def _large_links(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the large buckets, decided on whole sets where the rows meet; a
    spanning forest for each comparison of two blocks."""
    need = fewest_matches(percent / 100)

    def handle(table: pa.Table) -> pa.RecordBatch:
        node = table.column("node").combine_chunks().to_numpy()
        _, root = np.unique(table.column("root").combine_chunks().to_numpy(), return_inverse=True)
        sets_ = table.column("shingles").combine_chunks()
        up = list(range(int(root.max()) + 1))  # components of the rows at hand

        def find(v: int) -> int:
            while up[v] != v:
                up[v] = up[up[v]]
                v = up[v]
            return v

        found = []
        for i, j in _alike(table, need, percent):
            for p, q in zip(i.tolist(), j.tolist()):
                a, b = find(root[p]), find(root[q])
                if a != b:
                    x, y = (sets_[k].values.to_numpy() for k in (p, q))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        up[max(a, b)] = min(a, b)
                        found.append((node[p], node[q]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return _pair_batch(pairs[:, 0], pairs[:, 1])

    sent = _dealt(rows, classes).join(sets.hint("merge"), "node").select(*_SENT, "shingles")
    sent = sent.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    return sent.mapInArrow(_Runs(handle), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    Texts are linked if 100 times the shingles they share is at least ``percent`` times those
    that either has; ``component_id`` is the smallest id that can be reached.  Rows with a
    null id belong to the component like others and never name it; a component of such rows
    only has a null name.  Texts without words (and null) are linked with nothing, not even
    with each other.  Repeated rows are returned each.  A pair is missed if no band agrees or
    if its first batches match by chance as rarely as ``MISS`` says; links are exact.
    """
    rows = stored(prints(docs, width=width, doc_id=doc_id, text=text))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")).alias("first")
    classes = rows.where("n_shingles > 0").groupBy("d0", "d1").agg(
        first, F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()))
    source = {"width": width, "doc_id": doc_id, "text": text}

    every = classes.select("node", F.explode("bands").alias("key"))
    shared = stored(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    members = stored(every.join(shared.hint("merge"), "key"))
    popular = stored(members.groupBy("node").agg(F.sum("n").alias("pop")))
    pivots = members.join(popular.hint("merge"), "node").groupBy("key").agg(
        F.max(F.struct("pop", "node")).alias("p"), F.max(F.struct(F.xxhash64("key", "node").alias("h"), "node")).alias("q"))
    pivots = stored(pivots.select("key", F.array_distinct(F.array("p.node", "q.node")).alias("pivots")))
    met = members.select("key", "node").join(pivots.hint("merge"), "key").select("node", F.explode("pivots").alias("pivot"))
    stars = met.where("node <> pivot").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    likely = stored(_pruned(stored(stars), classes, percent))
    sets = _sets(likely.select(F.explode(F.array("a", "b")).alias("node")), classes, docs, **source)
    linked = stored(_confirmed(likely, sets, percent))

    known = stored(components(linked))
    placed = members.select("key", "node").join(known.hint("merge"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    open_ = stored(_open_buckets(stored(placed)))
    small, large = open_.where(F.col("rows") <= SMALL), open_.where(F.col("rows") > SMALL)
    pairs = stored(_small_pairs(small, classes, percent))
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")), classes, docs, **source)
    more = stored(_confirmed(pairs, sets, percent).union(_large_links(large, classes, sets, percent)))
    found = stored(components(linked.union(more)))

    rooted = classes.join(found.hint("merge"), "node", "left")
    rooted = stored(rooted.select("d0", "d1", F.coalesce("root", "node").alias("root"), F.col("first.doc_id").alias("first_id")))
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = stored(rooted.join(named, "root").select("d0", "d1", "component_id"))
    full = rows.where("n_shingles > 0").join(named, ["d0", "d1"]).select("doc_id", "n_shingles", "component_id")
    return full.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
