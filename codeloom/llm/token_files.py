"""Token ids in rANS-coded binary files.

A corpus folder has one shared table of symbol frequencies and data files in ascending
order of document id.  A data file is a row of independent blocks of whole documents; each
block is coded by interleaved range-asymmetric coders (lanes) which numpy steps together.
The manifest is the table of checkpoints: where each block starts in its file, in its
file's tokens, and the block's checksum.  Any block can be decoded alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.shared_files import attempt_name, create, open_input
from codeloom.llm.tokens import slices, tokenizer
from codeloom.session import scratch_path, stored

BLOCK_TOKENS = 1 << 18
LANES = 1024
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sIQIIII")  # mark, documents, tokens, lanes, words, crc of ids, crc of body
WORD = np.uint64(32)


class FrequencyTable:
    """Symbol frequencies scaled to a power of two, each at least 1."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        self.symbols = np.asarray(symbols, np.uint32)
        n = len(self.symbols)
        self.bits = max(12, int(np.ceil(np.log2(max(n, 1)))) + 2)
        size = 1 << self.bits
        share = np.asarray(counts, np.float64) * (size / max(1, np.sum(counts)))
        freq = np.maximum(1, np.floor(share)).astype(np.int64)
        if n:
            extra = size - int(freq.sum())
            order = np.argsort(-freq, kind="stable")
            if extra >= 0:
                freq[order[0]] += extra
            else:  # take from the largest, each stays at 1 at least
                for k in order:
                    part = min(int(freq[k]) - 1, -extra)
                    freq[k] -= part
                    extra += part
                    if not extra:
                        break
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slot = np.repeat(np.arange(n, dtype=np.uint32), freq)
        self.code = np.zeros(int(self.symbols.max()) + 1 if n else 1, np.uint32)
        self.code[self.symbols] = np.arange(n)

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """(lane states, words in reading order)."""
        code = self.code[ids]
        freq, start = self.freq[code], self.start[code]
        bits, top = np.uint64(self.bits), np.uint64(63 - self.bits)
        state = np.full(lanes, LOW, np.uint64)
        words = []
        for a in range((len(ids) - 1) // lanes * lanes if len(ids) else -1, -1, -lanes):
            f, c = freq[a : a + lanes], start[a : a + lanes]
            x = state[: len(f)]
            full = x >= (f << top)
            words.append(x[full].astype("<u4"))
            x = np.where(full, x >> WORD, x)
            turn = x // f
            state[: len(f)] = (turn << bits) + (x - turn * f) + c
        return state, np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")

    def decode(self, n: int, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        lanes, bits, mask = len(state), np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        state, wide, at = state.copy(), words.astype(np.uint64), 0
        out = np.zeros(n, np.uint32)
        for a in range(0, n, lanes):
            x = state[: min(lanes, n - a)]
            low = x & mask
            code = self.slot[low]
            x = self.freq[code] * (x >> bits) + low - self.start[code]
            need = np.flatnonzero(x < LOW)
            x[need] = (x[need] << WORD) | wide[at : at + len(need)]
            at += len(need)
            state[: len(x)] = x
            out[a : a + len(x)] = code
        return self.symbols[out]


def write_block(table: FrequencyTable, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray, lanes: int = LANES) -> bytes:
    """One block: header, document ids, sizes, lane states, words."""
    lanes = max(1, min(lanes, len(ids) // 64))
    state, words = table.encode(ids, lanes)
    body = keys.astype("<i8").tobytes() + sizes.astype("<u4").tobytes() + state.astype("<u8").tobytes() + words.tobytes()
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    return HEAD.pack(b"RNS1", len(keys), len(ids), lanes, len(words), crc, zlib.crc32(body)) + body


def read_block(table: FrequencyTable, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document ids, sizes, token ids); a damaged block is an error."""
    mark, docs, n, lanes, words, crc, body_crc = HEAD.unpack_from(data)
    if mark != b"RNS1" or zlib.crc32(data[HEAD.size :]) != body_crc:
        raise ValueError("damaged block")
    at = HEAD.size
    keys = np.frombuffer(data, "<i8", docs, at)
    sizes = np.frombuffer(data, "<u4", docs, at + 8 * docs)
    state = np.frombuffer(data, "<u8", lanes, at + 12 * docs)
    coded = np.frombuffer(data, "<u4", words, at + 12 * docs + 8 * lanes)
    ids = table.decode(n, state, coded)
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of the ids differs")
    return keys, sizes, ids


def id_type(tokenizer_path: str, end_id: int) -> str:
    """The smallest type for all ids, for tables on the way to the files."""
    return "<u2" if max(tokenizer(tokenizer_path).vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"


def tokenized(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, *, kind: str = "<u4", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, ids binary): little-endian ids of type ``kind`` with the end id; null text:
    end id only."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                ids, sizes = encoder.encode(texts[a:b])
                ids = np.insert(ids.astype(kind), np.cumsum(sizes), end_id)
                ends = np.cumsum(sizes + 1)
                parts = [ids[x:y].tobytes() for x, y in zip((ends - sizes - 1).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(parts, pa.binary())], ["doc_id", "ids"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids binary")


def _counts(kind: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                own = np.bincount(np.frombuffer(ids.as_py(), kind))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return count


NO_DOC = np.iinfo(np.int64).min  # stands for a null document id in files


def write_corpus(tokens: DataFrame, folder: str, *, kind: str = "<u4", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Write ``tokens`` (doc_id, ids of type ``kind``) as a corpus in ``folder``; gives the manifest.

    manifest(file_no, block_no, path, offset, n_bytes, n_docs, n_tokens, start): ``start`` is
    the number of ids before the block in the whole corpus.  Documents are in ascending
    order of id; null ids come first.
    """
    spark = tokens.sparkSession
    # at most one row per symbol of the vocabulary reaches the driver
    counted = tokens.select("ids").mapInArrow(_counts(kind), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = counted.orderBy("id").toPandas()
    symbols, numbers = counts["id"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    with create(f"{folder}/frequencies.bin") as out:
        raw = symbols.astype("<u4").tobytes() + numbers.astype("<u8").tobytes()
        out.write(struct.pack("<4sII", b"RNST", len(symbols), zlib.crc32(raw)) + raw)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_table(folder)
        path = attempt_name(folder, ".rans")
        rows: list[tuple] = []
        offset = held = 0
        keys: list[int] = []
        parts: list[np.ndarray] = []
        out = None

        def flush():
            nonlocal offset, held, keys, parts
            sizes = np.array([len(p) for p in parts], np.int64)
            data = write_block(table, np.array(keys, np.int64), sizes, np.concatenate(parts))
            out.write(data)
            rows.append((number, len(rows), path, offset, len(data), len(keys), int(sizes.sum())))
            offset, held, keys, parts = offset + len(data), 0, [], []

        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                out = out or create(path)
                own = np.frombuffer(ids.as_py(), kind)
                keys.append(NO_DOC if key is None else key)
                parts.append(own)
                held += len(own)
                if held >= block_tokens:
                    flush()
        if keys:
            flush()
        if out:
            out.close()
        names = ["file_no", "block_no", "path", "offset", "n_bytes", "n_docs", "n_tokens"]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = stored(
        tokens.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "ids").mapInArrow(
            write, "file_no int, block_no int, path string, offset long, n_bytes long, n_docs long, n_tokens long"
        )
    )
    # one row per file
    totals = blocks.groupBy("file_no").agg(F.sum("n_tokens").alias("n"))
    before = totals.withColumn(
        "before", F.sum("n").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    ).drop("n")
    within = F.sum("n_tokens").over(
        Window.partitionBy("file_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("n_tokens")
    return blocks.withColumn("within", within).join(before, "file_no").withColumn("start", F.col("before") + F.col("within")).drop("before", "within")


def load_table(folder: str) -> FrequencyTable:
    with open_input(f"{folder}/frequencies.bin") as source:
        data = source.read()
    mark, n, crc = struct.unpack_from("<4sII", data)
    if mark != b"RNST" or zlib.crc32(data[12:]) != crc:
        raise ValueError("damaged frequency table")
    return FrequencyTable(np.frombuffer(data, "<u4", n, 12), np.frombuffer(data, "<u8", n, 12 + 4 * n))


def read_corpus(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary, ids_crc32) of every document, block by block."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = load_table(folder)
        for batch in batches:
            for block in batch.itertuples():
                with open_input(block.path) as source:
                    source.seek(block.offset)
                    keys, sizes, ids = read_block(table, source.read(block.n_bytes))
                sizes = sizes.astype(np.int64)
                ends = np.cumsum(sizes)
                raw = ids.astype("<u4")
                parts = [raw[a:b].tobytes() for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                yield pd.DataFrame({
                    "doc_id": pd.array(keys, "Int64").copy() if (keys != NO_DOC).all() else pd.Series(keys, dtype="Int64").mask(keys == NO_DOC),
                    "start": block.start + ends - sizes, "n_tokens": sizes, "ids": parts,
                    "ids_crc32": [zlib.crc32(p) for p in parts],
                })

    spread = manifest.repartition(max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.select("path", "offset", "n_bytes", "start").mapInPandas(
        read, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"
    )


def round_trip(docs: DataFrame, tokenizer_path: str, *, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Encode documents into files and read them back; columns of ``read_corpus``."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    kind = id_type(tokenizer_path, end_id)
    tokens = stored(tokenized(docs, tokenizer_path, end_id, kind=kind))
    return read_corpus(stored(write_corpus(tokens, folder, kind=kind)), folder)
