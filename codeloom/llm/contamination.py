"""Benchmark decontamination with spaced seeds.

A mask picks some positions of a window of tokens and ignores the others, so a window with
substituted tokens still hashes like its source wherever some mask misses them.  Windows of
the training texts meet those of the benchmark in a join on the hash; around each hit the
two texts are aligned and the overlap is verified token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.registry import fresh
from codeloom.llm.sift import likely
from codeloom.llm.tokens import slices
from codeloom.session import stored

# Every way to change a fifth of 13 to 25 tokens leaves a window of one of these masks (the
# tests enumerate them); a longer overlap has a stretch of 13 to 25 with no larger share.
MASKS = ("11101111", "11010010111", "111110011", "11101000111", "1110011011", "1111010101", "1111111")
SPAN = 13  # tokens of the longest window
SHORTEST = 5  # benchmark items with fewer tokens cannot be told from common phrases
OVERLAP = 13  # tokens an overlap needs, or the whole item if it has fewer
EQUAL = 4  # equal tokens an overlap needs for each other one
FILTER_BITS = 24  # the benchmark's hashes as a bit table of fixed size: 2 MB
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(max(n, 1), np.uint64(base))
    steps[0] = 1
    return np.multiply.accumulate(steps)


_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes in a row, how many each text has): lower-cased runs of letters, digits
    and bytes beyond ASCII."""
    low = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    offsets = np.frombuffer(low.buffers()[1], np.int64, len(low) + 1, 8 * low.offset)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(0, np.uint64), np.zeros(len(low), np.int64)
    data = np.frombuffer(low.buffers()[2], np.uint8, last - first, first)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TOKEN[data]
    cut = inside[1:] != inside[:-1]
    bounds = offsets - first
    cut[bounds] |= inside[bounds] & inside[bounds + 1]  # texts do not run into each other
    edges = np.flatnonzero(cut)
    both = inside[edges] & inside[edges + 1]
    edges = np.sort(np.concatenate([edges, edges[both]]))
    starts, stops = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_powers(_BASE, len(data)) * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * _powers(_BACK, len(data) + 1)[starts]
    hashes ^= hashes >> np.uint64(31)
    return hashes * np.uint64(0x9E3779B97F4A7C15), np.diff(np.searchsorted(starts, bounds))


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The masked hash of the window at each position that has a whole window."""
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(int(mask, 2) | len(mask) << 32))
    for k, bit in enumerate(mask):
        if bit == "1":
            total = (total ^ hashes[k : k + n]) * np.uint64(0x2545F4914F6CDD1D)
            total ^= total >> np.uint64(29)
    return total


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.uint64(64 - FILTER_BITS)
    return hashes >> top, (hashes * np.uint64(0x9E3779B97F4A7C15)) >> top


def benchmark_items(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, tokens): items with at least ``SHORTEST`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sizes = tokens(batch.column(1))
            parts = np.split(hashes.view(np.int64), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], ["item_id", "tokens"])

    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, tokens array<long>").where(F.size("tokens") >= SHORTEST)


def _item_masks(n: int) -> tuple[str, ...]:
    """An item below ``OVERLAP`` tokens counts as a whole: its masks omit as many of five
    blocks as tokens may be changed, in every way."""
    if n >= OVERLAP:
        return MASKS
    block = np.arange(n) * 5 // n
    return tuple("".join("0" if b in gone else "1" for b in block) for gone in combinations(range(5), n // (EQUAL + 1)))


def item_seeds(items: DataFrame) -> DataFrame:
    """(hash, item_id, item_at); an item below ``OVERLAP`` tokens has one seed a mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, own in zip(batch["item_id"], batch["tokens"]):
                own = np.asarray(own, np.int64).view(np.uint64)
                for mask in _item_masks(len(own)):
                    found = seeds(own, mask).view(np.int64)
                    yield pd.DataFrame({"hash": found, "item_id": item, "item_at": np.arange(len(found), dtype=np.int32)})

    return items.mapInPandas(run, "hash long, item_id long, item_at int")


def _filter_table(spots: DataFrame) -> np.ndarray:
    """Bit table of all benchmark hashes: at most 2^FILTER_BITS bits, whatever their number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = np.concatenate(_probes(batch["hash"].to_numpy(np.int64).view(np.uint64)))
            yield pd.DataFrame({"word": (bits >> np.uint64(6)).astype(np.int64), "bit": (np.uint64(1) << (bits & np.uint64(63))).view(np.int64)})

    words = spots.select("hash").distinct().mapInPandas(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def hit_runs(docs: DataFrame, table: np.ndarray, masks: list[str], reach: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, at, tokens, hits): stretches of documents around windows which the bit table
    lets through, and ``reach`` tokens to either side; ``at`` is the first token's place,
    ``hits`` are (hash, place)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        hit = pa.struct([("hash", pa.int64()), ("place", pa.int32())])
        names = ["doc_id", "at", "tokens", "hits"]
        for batch in batches:
            for a, b in slices(batch.column(1)):
                hashes, sizes = tokens(batch.column(1)[a:b])
                ends = np.cumsum(sizes)
                found_at, found_hash, found_doc = [], [], []
                for mask in masks:
                    own = seeds(hashes, mask)
                    pass_ = np.ones(len(own), bool)
                    for probe in _probes(own):
                        pass_ &= (bits[(probe >> np.uint64(6)).astype(np.int64)] >> (probe & np.uint64(63))) & np.uint64(1) > 0
                    at = np.flatnonzero(pass_)
                    doc = np.searchsorted(ends, at, side="right")
                    whole = at + len(mask) <= ends[doc] if len(at) else np.zeros(0, bool)
                    found_at.append(at[whole])
                    found_hash.append(own[at[whole]].view(np.int64))
                    found_doc.append(doc[whole])
                at, own, doc = (np.concatenate(x) for x in (found_at, found_hash, found_doc))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, own, doc = at[order], own[order], doc[order]
                breaks = np.flatnonzero((doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > 2 * reach)) + 1
                rows = []
                for x, y in zip([0, *breaks.tolist()], [*breaks.tolist(), len(at)]):
                    d = doc[x]
                    begin = ends[d] - sizes[d]
                    low, high = max(begin, at[x] - reach), min(ends[d], at[y - 1] + SPAN + reach)
                    hits = [{"hash": h, "place": p} for h, p in zip(own[x:y].tolist(), (at[x:y] - begin).tolist())]
                    rows.append((int(a + d), int(low - begin), hashes[low:high].view(np.int64).tolist(), hits))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(hit)),
                ], names)

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, at int, tokens array<long>, hits array<struct<hash: long, place: int>>")


def aligned(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int]:
    """(start in the item, tokens, equal tokens) of the longest stretch with enough equal
    tokens, the one with most of them and then the first; item token i lies on document
    token i + shift."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    same = doc[low + shift : high + shift] == item[low:high]
    equal = np.concatenate([[0], np.cumsum(same)])
    level = (EQUAL + 1) * equal - EQUAL * np.arange(len(equal))
    # the first place that is not above each end's level
    start = np.searchsorted(-np.minimum.accumulate(level), -level)
    sizes = np.arange(len(equal)) - start
    best = np.lexsort((start, -(equal - equal[start]), -sizes))[0]
    return low + int(start[best]), int(sizes[best]), int(equal[best] - equal[start[best]])


def overlaps(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_start, doc_start, n_tokens, n_equal): the longest verified
    overlap of each document with each benchmark item, of at least ``OVERLAP`` tokens (or
    the whole item) with ``EQUAL`` equal tokens or more for each other one, wherever these lie.

    Null and empty texts overlap with nothing, nor do items below ``SHORTEST`` tokens.
    Repeated rows of a document count as one.
    """
    items = stored(benchmark_items(benchmark))
    spots = stored(item_seeds(items))
    sizes = [r["n"] for r in items.select(F.size("tokens").alias("n")).groupBy("n").count().collect()]
    # the masks of a short length are few; an overlap is nowhere longer than its item
    masks = [*MASKS, *(m for n in sorted(sizes) if n < OVERLAP for m in _item_masks(n))]
    reach = max(sizes, default=0)
    runs = stored(
        hit_runs(docs, _filter_table(spots), masks, reach, doc_id=doc_id, text=text)
        .withColumn("run", F.monotonically_increasing_id())
    )
    hits = runs.select("run", F.explode("hits").alias("hit")).select("run", F.col("hit.hash").alias("hash"), F.col("hit.place").alias("place"))
    pairs = stored(
        hits.join(spots, "hash").select("run", "item_id", (F.col("place") - F.col("item_at")).alias("shift")).distinct()
    )
    # both are plain shuffles of stored tables: a hot item or run can be split
    meeting = pairs.join(runs.select("run", "doc_id", "at", "tokens"), "run").join(
        items.select("item_id", F.col("tokens").alias("item_tokens")), "item_id"
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                item = np.asarray(r.item_tokens)
                start, n, equal = aligned(np.asarray(r.tokens), item, r.shift - r.at)
                if n >= min(OVERLAP, len(item)):
                    rows.append((r.doc_id, r.item_id, start, start + r.shift, n, equal))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_start", "doc_start", "n_tokens", "n_equal"])

    kind = dict(docs.dtypes)[doc_id]
    found = meeting.select("doc_id", "item_id", "shift", "at", "tokens", "item_tokens").mapInPandas(
        verify, f"doc_id {kind}, item_id long, item_start int, doc_start int, n_tokens int, n_equal int"
    )
    best = F.max(F.struct("n_tokens", "n_equal", (-F.col("item_start")).alias("i"), (-F.col("doc_start")).alias("d"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).selectExpr(
        "doc_id", "item_id", "-best.i AS item_start", "-best.d AS doc_start", "best.n_tokens", "best.n_equal"
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps with the benchmark.

    Rows are told apart by their texts, so null and repeated ids decide nothing; a null text
    stays.  All columns are returned as they were.  Texts which are surely clean are not
    shuffled.
    """
    key = F.coalesce(F.sha2(F.col("text").cast("string"), 256), F.lit(""))
    name = fresh(docs, "found")
    found = overlaps(docs.select(key.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(name))
    found = stored(found.distinct())
    near = likely(found, name, key)
    rest = docs.where(near).join(found.hint("merge"), key == F.col(name), "left_anti")
    return docs.where(~near).unionByName(rest)
