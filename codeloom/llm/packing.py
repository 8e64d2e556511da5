"""Best-two-fit packing of documents into sequences of a fixed capacity.

Which pieces share a sequence depends on their lengths alone, and there are at most
``capacity`` different lengths.  So the plan is made on the histogram of lengths (one row
per length, whatever the size of the corpus), and Spark deals the pieces out to its slots
by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.tokens import slices, tokenizer
from codeloom.session import stored

CAPACITY = 4096


def pieces(
    docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int = 1,
    doc_id: str = "doc_id", text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents cut to the capacity.

    A null or empty text is its end id alone.  Repeated rows give repeated pieces.  A
    document longer than ``capacity`` is cut into full pieces, the last may be shorter.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts):
                ids, sizes = encoder.encode(texts[a:b])
                ids = np.insert(ids.astype("<u4"), np.cumsum(sizes), end_id)
                sizes = sizes + 1
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(b - a), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                at = (np.cumsum(sizes) - sizes)[doc] + start
                parts = [ids[x : x + m].tobytes() for x, m in zip(at.tolist(), length.tolist())]
                columns = [
                    keys.take(pa.array(doc + a)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = dict(docs.dtypes)[doc_id]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[(pattern, bins)]: a pattern lists (length, how many), largest first.

    Each bin is filled greedily with the largest length that still fits.  Then its smallest
    document is taken out, and if two unpacked lengths fit the widened gap more tightly,
    they take its place.  The pattern is repeated while the lengths it needs last.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    lengths = np.arange(capacity + 1)
    # below[x]: the largest length of at most x that is left, 0 for none
    below = np.maximum.accumulate(np.where(left > 0, lengths, 0))
    done: list[tuple[list[tuple[int, int]], int]] = []

    def take(length: int, n: int) -> None:
        """Remove n of a length; mend ``below`` if that was the last."""
        had = left[length]
        left[length] -= n
        if had > 0 and left[length] == 0:
            stop = length + int(np.argmax(below[length:] > length)) if below[-1] > length else capacity + 1
            below[length:stop] = below[length - 1]
        elif had == 0 and left[length] > 0:
            stop = length + int(np.argmax(below[length:] > length)) if below[-1] > length else capacity + 1
            below[length:stop] = length

    while below[-1]:
        bin_: dict[int, int] = {}
        gap = capacity
        while gap and (length := int(below[gap])):
            n = int(min(left[length], gap // length))
            bin_[length] = bin_.get(length, 0) + n
            take(length, n)
            gap -= n * length
        small = min(bin_)
        if gap and sum(bin_.values()) > 1:
            wide = gap + small
            first = lengths[1:wide][left[1:wide] > 0]
            if len(first):
                second = below[wide - first]
                # two of one length need two of it
                alone = (second == first) & (left[second] < 2)
                second = np.where(alone, below[np.maximum(second - 1, 0)], second)
                both = np.where(second > 0, first + second, 0)
                k = int(np.argmax(both))
                if both[k] > small:
                    take(small, -1)
                    bin_[small] -= 1
                    for x in (int(first[k]), int(second[k])):
                        take(x, 1)
                        bin_[x] = bin_.get(x, 0) + 1
        pattern = sorted(((x, n) for x, n in bin_.items() if n), reverse=True)
        more = int(min(left[x] // n for x, n in pattern))
        for x, n in pattern:
            if more:
                take(x, n * more)
        done.append((pattern, 1 + more))
    return done


def ranked(cut: DataFrame, buckets: int) -> DataFrame:
    """``cut`` with ``rank``: the place of a row among those of its length, from 0.

    Rows of a length are ranked in ``buckets`` hashed groups and moved by the sizes of the
    groups before, so no length is ranked in a single task.
    """
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = (
        keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(
            Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ) - F.col("n")).drop("n")
    )
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    return (
        keyed.withColumn("own", own).join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("own") - 1)
        .drop("bucket", "own", "before")
    )


def pack(cut: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (a table with doc_id, piece, length) with sequence_id and offset.

    Sequences hold at most ``capacity`` tokens without gaps.  An empty table gives an empty
    result.  Equal rows get different places.
    """
    spark = cut.sparkSession
    # at most ``capacity`` rows reach the driver
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots: dict[int, list[tuple[int, int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, bins in plan(histogram, capacity):
        offset = 0
        for length, each in pattern:
            first = used.get(length, 0)
            slots.setdefault(length, []).append((first, each, offset, sequence))
            used[length] = first + each * bins
            offset += length * each
        sequence += bins
    places = {length: np.array(rows, np.int64).T for length, rows in slots.items()}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            where = np.zeros((2, len(batch)), np.int64)
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            for length, rows in pd.Series(np.arange(len(batch))).groupby(lengths).indices.items():
                first, each, offset, sequence_id = places[length]
                k = np.searchsorted(first, ranks[rows], side="right") - 1
                nth = ranks[rows] - first[k]
                where[0, rows] = sequence_id[k] + nth // each[k]
                where[1, rows] = offset[k] + nth % each[k] * length
            yield batch.drop(columns="rank").assign(sequence_id=where[0], offset=where[1])

    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = ranked(cut, buckets).select(*cut.columns, "rank")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return rows.mapInPandas(placed, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Cut and pack documents; options as in ``pieces``."""
    cut = stored(pieces(docs, tokenizer_path, **options))
    return pack(cut, capacity=options.get("capacity", CAPACITY))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences; needs pieces made ``with_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
