"""Removal of long repeated byte strings with a column-wise multi-string BWT.

Every string of ``LENGTH`` bytes that also starts in a document with a smaller id is removed.
Documents are cut into short strings: neighbouring windows which share their minimizer (the
smallest hashed 24-gram) form one string, and equal windows always share it.  So the strings
of a minimizer can be handled apart from all others.  For a block of them the collection's
Burrows-Wheeler transform and common prefixes are built column by column: each round inserts
one symbol of every string, from the last to the first, and updates both arrays in one
sequential pass.  Runs of common prefixes of ``LENGTH`` are the classes of equal windows.

Minimizers which occur in one document only cannot repeat; a first pass finds the others and
keeps them as a bit table.  What the table lets through by chance is harmless.  Neighbouring
strings overlap, so their bytes are several times the text.  A second pass sends hashes and
places only: they settle every minimizer with a single string, whose windows all have the
string's smallest document.  A third pass sends bytes, of one occurrence of each string whose
minimizer has several: a bit table asks for them, or, where they are too many for it, their
documents meet the requests, so that what is sent grows with the text and no faster.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.tokens import slices
from codeloom.session import stored

LENGTH = 50
GRAM = 24
TABLE_BITS = 22, 29  # 512 KB to 64 MB, by what a table is to hold; a fuller one sifts less
MANY_BITS = 24  # of the very frequent ones': 2 MB
BLOCK = 1 << 11  # strings of a block, small for the processor's caches; a minimizer's are in one
CROWD = 1 << 15  # strings of a minimizer that are too many for a block; their windows are dealt out singly
SLICE = 1 << 18  # bytes of text handled at once; longer texts are taken in overlapping pieces
MANY = 2048  # batches in which a minimizer is so frequent that its windows are dealt out singly
TIE_BITS = 24  # grams which agree above these bits are taken from the left
CUT_BITS = 24  # of a minimizer's hash, not looked at when minimizers are told apart
FLUSH = 1 << 24  # bytes of text whose strings are sent together
HELD = 1 << 19  # ranges of bytes that are sent together
ASKED = 1 << 27  # strings that a bit table asks for; the documents of more are sent
RESTS = 1 << 16  # places that are sent in a pack
PART_BITS = 12  # parts of the hash range at most; more would make the packs of a flush too small
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 19, 1 << int(n).bit_length())
    if size not in _tables:
        both = []
        for base in (_BASE, _BACK):
            steps = np.full(size, np.uint64(base))
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _tables.clear()
        _tables[size] = (both[0], both[1])
    return _tables[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _packed(keys: np.ndarray) -> bytes:
    """Sorted numbers as compressed differences, their bytes side by side."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def _pack(columns: list[np.ndarray], data: bytes = b"") -> bytes:
    """Numbers of eight bytes, their bytes side by side, and what follows them, compressed."""
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns]
    return zstandard.compress(b"".join([*planes, data]), 3)


def _unpack(pack: bytes, n: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(pack), np.uint8)
    columns = [np.ascontiguousarray(raw[8 * n * k : 8 * n * (k + 1)].reshape(8, n).T).view(np.int64).ravel() for k in range(width)]
    return columns, raw[8 * n * width :]


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences that ``np.cumsum`` undoes, modulo 2^64."""
    return np.diff(values.view(np.uint64), prepend=np.uint64(0))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the runs of equal numbers."""
    edges = np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))
    return list(zip(edges.tolist(), [*edges[1:].tolist(), len(values)]))


def _gathered(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of many ranges in a row."""
    ends = np.cumsum(sizes)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - sizes), sizes)]


class Strings:
    """The strings of some texts: ``key`` (minimizer), ``doc`` (number of the text), ``at``
    (place in the joined bytes), ``n`` (windows), and ``sums`` for hashes of byte ranges."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        low, high = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(texts.buffers()[2], np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
        self.bounds = offsets - low
        size = len(self.data)
        up, self.down = _powers(size + 1)
        self.sums = np.zeros(size + 1, np.uint64)
        np.cumsum(up[:size] * (self.data.astype(np.uint64) + np.uint64(1)), out=self.sums[1:])
        self.key, self.doc, self.at, self.n = np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
        if size < LENGTH:
            return
        grams = _mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: size - GRAM + 1])
        bits = np.uint64(max(TIE_BITS, int(size).bit_length()))
        smallest = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= LENGTH - GRAM + 1:
            smallest = np.minimum(smallest[:-width], smallest[width:])
            width *= 2
        rest = LENGTH - GRAM + 1 - width
        if rest:
            smallest = np.minimum(smallest[: len(smallest) - rest], smallest[rest:])
        place = (smallest & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.bounds))[: len(place)]
        whole = self.bounds[doc + 1] - np.arange(len(place)) >= LENGTH
        first = np.ones(len(place), bool)
        first[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        starts = np.flatnonzero(first & whole)
        # a run ends where the next begins or where the document leaves no whole window
        group = np.cumsum(first) - 1
        self.n = np.bincount(group[whole], minlength=group[-1] + 1)[group[starts]]
        # hashed again: smallest hashes crowd at the low end of the range
        self.at, self.doc, self.key = starts, doc[starts], _mixed(grams[place[starts]])

    def take(self, keep: np.ndarray) -> None:
        self.key, self.doc, self.at, self.n = (v[keep] for v in (self.key, self.doc, self.at, self.n))

    def ids(self) -> np.ndarray:
        return _string_ids(self.sums, self.down, self.at, self.n)

    def single(self, frequent: np.ndarray) -> None:
        """Windows of the marked strings become strings of their own, keyed by content."""
        if not frequent.any():
            return
        n = np.where(frequent, self.n, 1)
        own = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        alone = frequent[own]
        self.at = self.at[own] + np.where(alone, step, 0)
        self.n = np.where(alone, 1, self.n[own])
        self.doc = self.doc[own]
        self.key = np.where(alone, _mixed((self.sums[self.at + LENGTH] - self.sums[self.at]) * self.down[self.at]), self.key[own])


def _string_ids(sums: np.ndarray, down: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    return _mixed((sums[at + n + LENGTH - 1] - sums[at]) * down[at] ^ (n.astype(np.uint64) << np.uint64(50)))


def _pieces(texts: pa.Array) -> Iterator[tuple[pa.Array, int, int]]:
    """(texts, number of the first, bytes before them in it): runs of texts of about
    ``SLICE`` bytes, or a piece of a longer one.  No window is in two pieces.  A text over
    4 * ``SLICE`` is cut by itself, whatever stands beside it."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = 0
    for own in [*np.flatnonzero(sizes > 4 * SLICE).tolist(), len(texts)]:
        for a, b in slices(texts[begin:own], SLICE):
            yield texts[begin + a : begin + b], begin + a, 0
        if own < len(texts):
            data = texts[own].as_py()
            for at in range(0, int(sizes[own]) - LENGTH + 1, SLICE):
                yield pa.array([data[at : at + SLICE + LENGTH - 1]], pa.binary()), own, at
        begin = own + 1


def _width(bits: int) -> int:
    least, most = TABLE_BITS
    return min(most, max(least, bits.bit_length()))


def _bits(keys: np.ndarray, parts_bits: int, table_bits: int) -> bytes:
    """A part of the table, with the keys of that part."""
    own = 1 << (table_bits - parts_bits)
    bits = np.zeros(own, np.uint8)
    for slot in _slot(keys, parts_bits, table_bits):
        bits[(slot & np.uint64(own - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _slot(keys: np.ndarray, parts_bits: int, table_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the table for each key, both in the key's part of the table."""
    own = np.uint64(table_bits - parts_bits)
    keys = keys >> np.uint64(CUT_BITS) << np.uint64(CUT_BITS)
    part = keys >> np.uint64(64 - parts_bits) << own
    low = (np.uint64(1) << own) - np.uint64(1)
    return part | ((keys >> np.uint64(CUT_BITS)) & low), part | ((keys * _MIX >> np.uint64(30)) & low)


def _has(table: np.ndarray, keys: np.ndarray, parts_bits: int) -> np.ndarray:
    found = np.ones(len(keys), bool)
    for slot in _slot(keys, parts_bits, len(table).bit_length() + 2):
        found &= (table[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0
    return found


def repeated_minimizers(rows: DataFrame, parts_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit tables of the minimizers found in two documents or more, and of the very frequent.

    A task sends each minimizer of a batch once (twice if two of the batch's documents have
    it), packed by parts of the hash range.  The driver gets the tables, of bounded size.
    """
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    widths = _width(size // 8), MANY_BITS

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(held):
            key = np.sort(np.concatenate(held))
            part = (key >> np.uint64(64 - parts_bits)).astype(np.int64)
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            key >>= np.uint64(CUT_BITS)
            pieces = [_packed(key[a:b]) for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(key)])]
            return pa.RecordBatch.from_arrays([pa.array(part[edges], pa.int32()), pa.array(pieces, pa.binary())], ["part", "keys"])

        held, size = [], 0
        for batch in batches:
            keys = []
            for texts, _, _ in _pieces(batch.column(0)):
                own = Strings(texts)
                size += len(own.data)
                order = np.lexsort((own.doc, own.key))
                key, doc = own.key[order], own.doc[order]
                fresh = np.ones(len(key), bool)
                fresh[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                keys.append(key[fresh])
            key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
            held.append(key[np.concatenate([[True] * min(2, len(key)), key[2:] != key[:-2]])])  # at most two of each
            if size >= FLUSH:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        key = np.sort(np.concatenate([_unpacked(k) for k in group["keys"]])) << np.uint64(CUT_BITS)
        twice = np.flatnonzero(key[1:] == key[:-1])
        many = np.flatnonzero(key[MANY:] == key[: len(key) - MANY]) if len(key) > MANY else np.zeros(0, np.int64)
        out = [_bits(key[at], parts_bits, width) for at, width in zip((twice, many), widths)]
        return pd.DataFrame({"part": group["part"].iloc[:1], "twice": out[:1], "many": out[1:]})

    sent = rows.select("text").mapInArrow(emit, "part int, keys binary")
    found = stored(sent.groupBy("part").applyInPandas(merge, "part int, twice binary, many binary"))
    tables = [np.zeros(1 << (width - 3), np.uint8) for width in widths]
    for r in found.toLocalIterator():
        for table, bits in zip(tables, (r["twice"], r["many"])):
            table[r["part"] * len(bits) : (r["part"] + 1) * len(bits)] = np.frombuffer(bits, np.uint8)
    return tables[0], tables[1]


def column_wise(data: np.ndarray, sizes: np.ndarray, cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, suffix length, common prefix with the suffix before) in suffix order.

    ``data`` are the bytes of all strings in a row.  Strings end in different end marks
    which sort before all bytes.  Round j inserts the suffix of length j of every string that
    has one: its place is the rank of its first symbol in the transform before the suffix of
    length j - 1, counted over the whole collection.  A new suffix changes two common
    prefixes (up to ``cap``), its own and its follower's: each is one more than the smallest
    of the old ones between two consecutive occurrences of the symbol in the transform.
    """
    n = len(sizes)
    ends = np.cumsum(sizes)
    # byte values which UTF-8 uses leave room for the end mark in eight bits
    values, codes = np.unique(data, return_inverse=True)
    if len(values) > 255:
        raise ValueError("more than 255 different bytes")
    symbols = np.concatenate([codes.astype(np.uint8) + np.uint8(1), np.zeros(1, np.uint8)])
    # round 0: the empty suffixes in string order
    transform = symbols[np.where(sizes > 0, ends - 1, len(data))]
    suffix = np.arange(n, dtype=np.int64) << 32
    common = np.zeros(n, np.uint8)
    active = np.flatnonzero(sizes > 0)
    place = active  # of each active string's newest suffix
    for j in range(1, int(sizes.max(initial=0)) + 1):
        order = np.argsort(transform, kind="stable")
        done = int(np.searchsorted(transform[order], 1))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[place]  # place among all symbols of the transform
        new = n + at - done
        # the neighbours in the transform's order: for a suffix and for its follower
        symbol = transform[place]
        left = order[np.maximum(at - 1, 0)]
        right = order[np.minimum(at + 1, len(order) - 1)]
        has_left = (at > done) & (transform[left] == symbol)
        has_right = (at + 1 < len(order)) & (transform[right] == symbol)
        low = np.concatenate([left[has_left], place[has_right]]) + 1
        high = np.concatenate([place[has_left], right[has_right]])
        least = np.minimum(_range_min(common, low, high).astype(np.int16) + 1, cap).astype(np.uint8)
        size = len(order) + len(active)
        fresh = np.zeros(size, bool)
        fresh[new] = True
        old = np.flatnonzero(~fresh)
        rest = sizes[active] > j
        moved, deep, prefix = np.empty(size, np.uint8), np.empty(size, np.int64), np.empty(size, np.uint8)
        moved[old], deep[old], prefix[old] = transform, suffix, common
        moved[new] = np.where(rest, symbols[np.where(rest, ends[active] - j - 1, len(data))], 0)
        deep[new] = active << 32 | j
        prefix[new] = 0
        split = int(has_left.sum())
        prefix[new[has_right] + 1] = least[split:]
        prefix[new[has_left]] = least[:split]
        transform, suffix, common = moved, deep, prefix
        active, place = active[rest], new[rest]
    return suffix >> 32, suffix & 0xFFFFFFFF, common


def _range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest of values[low..high], both included, for many ranges: from a table of minima
    over stretches of doubling length."""
    out = np.empty(len(low), np.uint8)
    span = high - low + 1
    level = np.frexp(span.astype(np.float64))[1].astype(np.int8) - 1
    by = np.argsort(level, kind="stable")
    top = int(level.max(initial=0)) + 1
    edges = np.searchsorted(level[by], np.arange(top + 1))
    row = values
    for k in range(top):
        if k:
            row = np.minimum(row[: -(1 << (k - 1))], row[1 << (k - 1) :])
        own = by[edges[k] : edges[k + 1]]
        if len(own):
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << k) + 1])
    return out


def class_minima(data: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every window of every string, in order: the smallest ``first`` of all strings
    with an equal window."""
    string, length, common = column_wise(data, sizes)
    full = length >= LENGTH
    string, length, common = string[full], length[full], common[full]
    heads = np.flatnonzero(common < LENGTH)
    group = np.cumsum(common < LENGTH) - 1
    least = np.minimum.reduceat(first[string], heads)[group] if len(heads) else np.zeros(0, np.int64)
    windows = sizes - LENGTH + 1
    base = np.cumsum(windows) - windows
    out = np.empty(int(windows.sum()), np.int64)
    out[base[string] + sizes[string] - length] = least
    return out


def _range_ids(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The hashes of byte ranges of ``n`` windows, given in order of place.

    Taken in runs of about ``SLICE`` bytes, so the tables stay small whatever the input."""
    ids = np.empty(len(at), np.uint64)
    for a, b in _runs(at // SLICE):
        begin, end = int(at[a]), int((at[a:b] + n[a:b]).max()) + LENGTH - 1
        own = data[begin:end]
        up, down = _powers(len(own) + 1)
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(up[: len(own)] * (own.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        ids[a:b] = _string_ids(sums, down, at[a:b] - begin, n[a:b])
    return ids


def string_minima(key: np.ndarray, data: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For every window of every string, in order: the smallest ``first`` of the strings with
    an equal window.  The strings lie in order of ``key``, and no window is under two keys.

    Windows at the ends of a string whose hash is found once are equal to no other; what is
    between goes to the transform, equal strings of a key once."""
    n = sizes - LENGTH + 1
    base, at = np.cumsum(n) - n, np.cumsum(sizes) - sizes
    out = np.repeat(first, n)
    ids = _range_ids(data, np.repeat(at - base, n) + np.arange(len(out)), np.ones(len(out), np.int64))
    order = np.argsort(ids)
    once = np.ones(len(ids), bool)
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    once[order[again]] = once[order[again + 1]] = False
    place = np.flatnonzero(~once)
    if not len(place):
        return out
    owner = np.repeat(np.arange(len(n)), n)[place]
    heads = [a for a, _ in _runs(owner)]
    tails = [*(h - 1 for h in heads[1:]), len(owner) - 1]
    own, begin = owner[heads], place[heads]
    windows = place[tails] - begin + 1
    at = at[own] + begin - base[own]
    ids, low, key = _range_ids(data, at, windows), first[own], key[own]
    order = np.lexsort((low, ids, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (key[order][1:] != key[order][:-1])
    pick = order[fresh]
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    least = np.empty(int(windows[pick].sum()), np.int64)
    offset = np.cumsum(windows[pick]) - windows[pick]
    size = windows[pick] + LENGTH - 1

    def settle(a: int, b: int) -> None:
        k = pick[a:b]
        minima = class_minima(_gathered(data, at[k], size[a:b]), size[a:b], low[k])
        least[offset[a] : offset[a] + len(minima)] = minima

    def settle_singly(a: int, b: int) -> None:
        k = np.sort(pick[a:b])  # in order of place
        step = np.arange(int(windows[k].sum())) - np.repeat(np.cumsum(windows[k]) - windows[k], windows[k])
        place = np.repeat(at[k], windows[k]) + step
        ids = _range_ids(data, place, np.ones(len(place), np.int64))
        order = np.argsort(ids)
        sizes = np.full(len(place), LENGTH)
        minima = np.empty(len(place), np.int64)
        minima[order] = string_minima(ids[order], _gathered(data, place[order], sizes), sizes, np.repeat(low[k], windows[k])[order])
        least[np.repeat(offset[kind[k]], windows[k]) + step] = minima

    start = 0
    for a, b in _runs(key[pick]):
        if b - a > CROWD:
            if start < a:
                settle(start, a)
            settle_singly(a, b)
            start = b
        elif b - start >= BLOCK or b == len(pick):
            settle(start, b)
            start = b
    if start < len(pick):
        settle(start, len(pick))
    step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    out[np.repeat(begin, windows) + step] = least[np.repeat(offset[kind], windows) + step]
    return out


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The rows of one part after the other; the part is the first column."""
    part, held = None, []
    for batch in batches:
        for own, *row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns))):
            if own != part and held:
                yield part, held
                held = []
            part = own
            held.append(tuple(row))
    if held:
        yield part, held


def _doc_part(doc: np.ndarray, version: np.ndarray, bits: int) -> np.ndarray:
    both = doc.view(np.uint64) * _MIX ^ _mixed(version.view(np.uint64))
    return (_mixed(both) >> np.uint64(64 - bits)).astype(np.int64)


def _sent_spans(held: list[tuple], bits: int) -> list[tuple[int, int, bytes]]:
    """(part of the documents, number, pack) of byte ranges (document, version, start, stop)."""
    doc, version, start, stop = (np.concatenate(v) for v in zip(*held))
    part = _doc_part(doc, version, bits)
    order = np.lexsort((start, version, doc, part))
    doc, version, start, size, part = doc[order], version[order], start[order], (stop - start)[order], part[order]
    return [
        (int(part[a]), b - a, _pack([_steps(doc[a:b]), _steps(version[a:b]), start[a:b], size[a:b]]))
        for a, b in _runs(part)
    ]


def _pack_wanted(doc, version, at, n, key, ids) -> bytes:
    """Strings whose bytes are asked for: document, version, place, windows, minimizer, hash."""
    return _pack([_steps(doc), _steps(version), at, n, key >> np.uint64(CUT_BITS), ids])


def _wanted(rows: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """The strings of many packs of ``_pack_wanted``, in order of document and place."""
    columns = []
    for n, pack in rows:
        (doc, version, at, windows, key, ids), _ = _unpack(pack, n, 6)
        doc, version = (np.cumsum(v.view(np.uint64), dtype=np.uint64).view(np.int64) for v in (doc, version))
        columns.append((doc, version, at, windows, key.view(np.uint64) << np.uint64(CUT_BITS), ids.view(np.uint64)))
    columns = [np.concatenate(v) for v in zip(*columns)]
    order = np.lexsort((columns[2], columns[1], columns[0]))
    return [v[order] for v in columns]


def _merged(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    """The ranges of each document in order, those that touch or overlap as one."""
    columns = [_unpack(pack, n, 4)[0] for n, pack in rows]
    doc, version = (np.concatenate([np.cumsum(c[k].view(np.uint64), dtype=np.uint64).view(np.int64) for c in columns]) for k in (0, 1))
    start, size = (np.concatenate([c[k] for c in columns]) for k in (2, 3))
    order = np.lexsort((start, version, doc))
    doc, version, start, stop = doc[order], version[order], start[order], (start + size)[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])
    row = np.cumsum(new) - 1
    # shifted by row, the largest stop so far never reaches into the next row
    shift = row * (int(stop.max(initial=0)) + 1)
    reach = np.maximum.accumulate(stop + shift)
    fresh = new.copy()
    fresh[1:] |= (start + shift)[1:] > reach[:-1]
    heads, owners = np.flatnonzero(fresh), np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(row)]]) - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[heads], minlength=len(owners)))])
    ranges = pa.StructArray.from_arrays([pa.array(start[heads]), pa.array((reach - shift)[tails])], ["start", "stop"])
    spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ranges)
    return pa.RecordBatch.from_arrays([pa.array(doc[owners]), pa.array(version[owners]), spans], ["doc_id", "version", "spans"])


def _wanted_key(key: np.ndarray, ids: np.ndarray, doc: np.ndarray, bits: int) -> np.ndarray:
    """A hash of string and document that lies in the minimizer's part of the table."""
    own = _mixed(ids ^ _mixed(doc.view(np.uint64) * _MIX))
    return (key >> np.uint64(64 - bits) << np.uint64(64 - bits)) | (own >> np.uint64(bits))


DOC_BITS = 22  # bit table of documents: 512 KB


def _doc_bit(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(1 << DOC_BITS))


def _touched(docs: DataFrame) -> np.ndarray:
    """Bit table of the document ids in ``docs``: at most 2^DOC_BITS / 64 rows."""
    words = docs.select(_doc_bit("doc_id").alias("bit")).selectExpr("shiftright(bit, 6) AS word", "shiftleft(1L, cast(bit & 63 AS int)) AS bits")
    found = words.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (DOC_BITS - 6), np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def _is_set(table: np.ndarray, bits: pd.Series) -> np.ndarray:
    bits = bits.to_numpy().astype(np.uint64)
    return (table[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) > 0


def removed_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, version, spans): byte ranges to remove, for documents with any; ``docs`` has
    doc_id, version and text."""
    spark = docs.sparkSession
    tasks = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts_bits = min(PART_BITS, (tasks - 1).bit_length())
    fine_bits = min(PART_BITS, parts_bits + 1)
    docs = docs.select("doc_id", "version", "text")
    shared = spark.sparkContext.broadcast(repeated_minimizers(docs, parts_bits))  # of bounded size

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Strings, np.ndarray, np.ndarray, int]]:
        """The strings of repeated minimizers, with their documents, versions and the bytes
        before the piece; keys are cut to what ties look at."""
        table, frequent = shared.value
        for batch in batches:
            ids, versions = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
            for texts, a, before in _pieces(batch.column(2)):
                own = Strings(texts)
                own.take(_has(table, own.key, parts_bits))
                own.single(_has(frequent, own.key, parts_bits))
                own.key = own.key >> np.uint64(CUT_BITS) << np.uint64(CUT_BITS)
                yield own, ids[own.doc + a], versions[own.doc + a], before

    def flushed(held: list[tuple], pack) -> Iterator[pa.RecordBatch]:
        """Packs by parts of the minimizers' range, strings in order of minimizer and hash."""
        columns = [np.concatenate(v) for v in zip(*held)]
        order = np.lexsort((columns[2], columns[1], columns[0]))
        rows = [(int(p), n, raw) for p, n, raw in pack(*(c[order] for c in columns))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "pack"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hash, document and place of every string."""

        def pack(key, ids, doc, version, at, n):
            for a, b in _runs(key >> np.uint64(64 - fine_bits)):
                k = slice(a, b)
                raw = _pack([_steps(key[k] >> np.uint64(CUT_BITS)), _steps(ids[k]), doc[k] - doc[k].min(), version[k], at[k], n[k]], doc[k].min().tobytes())
                yield key[a] >> np.uint64(64 - fine_bits), b - a, raw

        held, size = [], 0
        for own, doc, version, before in candidates(batches):
            size += len(own.data)
            if len(own.at):
                held.append((own.key, own.ids(), doc, version, own.at - own.bounds[own.doc] + before, own.n.astype(np.int64)))
            if size >= FLUSH and held:
                yield from flushed(held, pack)
                held, size = [], 0
        if held:
            yield from flushed(held, pack)

    def opened(n: int, pack: bytes) -> tuple[np.ndarray, ...]:
        (key, ids, doc, version, at, windows), least = _unpack(pack, n, 6)
        key, ids = (np.cumsum(v.view(np.uint64), dtype=np.uint64) for v in (key, ids))
        return key << np.uint64(CUT_BITS), ids, doc + least.view(np.int64)[0], version, at, windows

    def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of minimizers with one string; places of the others that may be removed, and
        one occurrence of each of their strings, whose bytes are wanted.  A part's packs stay
        packed and are opened one by one."""

        def row(kind, rows):
            part, n, pack = zip(*rows)
            columns = [pa.array(pack, pa.binary()) if k == kind else pa.nulls(len(pack), pa.binary()) for k in ("spans", "rest", "wanted")]
            return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(n, pa.int64()), *columns], ["part", "n", "spans", "rest", "wanted"])

        def open_row(part, places):
            string, ids, doc, version, at = (np.concatenate(v) for v in zip(*places))
            order = np.lexsort((at, version, doc, string))
            return row("rest", [(part, len(order), _pack([_steps(ids[order]), _steps(doc[order]), version[order], at[order]]))])

        held, size = [], 0
        for part, packs in _by_part(batches):
            heads = []
            for n, pack in packs:
                key, ids, doc, *_ = opened(n, pack)
                begin = [a for a, _ in _runs(ids)]  # equal strings lie in order of document
                end = [*begin[1:], n]
                heads.append((key[begin], ids[begin], doc[begin], doc[np.array(end) - 1]))
            key, ids, low, high = (np.concatenate(v) for v in zip(*heads))
            order = np.argsort(ids, kind="stable")
            key, ids, low, high = key[order], ids[order], low[order], high[order]
            edges = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            key, ids, low, high = key[edges], ids[edges], np.minimum.reduceat(low, edges), np.maximum.reduceat(high, edges)
            # by minimizer: how many strings, smallest and largest document
            _, group, count = np.unique(key, return_inverse=True, return_counts=True)
            several = (count > 1)[group]
            by = np.argsort(group, kind="stable")
            first = np.cumsum(count) - count
            bottom, top = np.minimum.reduceat(low[by], first)[group], np.maximum.reduceat(high[by], first)[group]
            rest = several & (bottom < top)
            idle = ~rest  # strings whose bytes are asked for, or need not be
            places, many, asked = [], 0, []
            for n, pack in packs:
                key_, ids_, doc, version, at, windows = opened(n, pack)
                string = np.searchsorted(ids, ids_)
                later = doc > bottom[string]
                gone = np.flatnonzero(later & ~several[string])
                if len(gone):
                    held.append((doc[gone], version[gone], at[gone], at[gone] + windows[gone] + LENGTH - 1))
                    size += len(gone)
                first = np.flatnonzero(~idle[string] & (doc == low[string]))
                if len(first):
                    name, at_ = np.unique(string[first], return_index=True)
                    idle[name], first = True, first[at_]
                    asked.append((doc[first], version[first], at[first], windows[first], key_[first], ids_[first]))
                open_ = np.flatnonzero(later & several[string])
                for k in (open_[a : a + RESTS] for a in range(0, len(open_), RESTS)):
                    places.append((string[k], ids_[k], doc[k], version[k], at[k]))
                    many += len(k)
                    if many >= RESTS:
                        yield open_row(part, places)
                        places, many = [], 0
            if places:
                yield open_row(part, places)
            if asked:
                columns = [np.concatenate(v) for v in zip(*asked)]
                order = np.lexsort((columns[2], columns[1], columns[0]))
                yield row("wanted", [(part, len(order), _pack_wanted(*(c[order] for c in columns)))])
            if size >= HELD:
                yield row("spans", _sent_spans(held, parts_bits))
                held, size = [], 0
        if held:
            yield row("spans", _sent_spans(held, parts_bits))

    sent = docs.mapInArrow(places, "part int, n long, pack binary").repartition(tasks, "part").sortWithinPartitions("part")
    known = stored(sent.mapInArrow(settled, "part int, n long, spans binary, rest binary, wanted binary"))

    # strings whose minimizer has several: the bytes of one occurrence are asked for
    requests = known.where("wanted IS NOT NULL").select("part", "n", F.col("wanted").alias("pack"))
    count = requests.agg(F.sum("n")).first()[0] or 0

    def pack_strings(data):
        def pack(key, ids, doc, at, sizes):
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])
            key, ids, doc, at, sizes = (v[fresh] for v in (key, ids, doc, at, sizes))
            whole = np.concatenate(data)
            for a, b in _runs(key >> np.uint64(64 - fine_bits)):
                k = slice(a, b)
                raw = _pack([_steps(key[k] >> np.uint64(CUT_BITS)), ids[k], _steps(doc[k]), sizes[k]], _gathered(whole, at[k], sizes[k]).tobytes())
                yield key[a] >> np.uint64(64 - fine_bits), b - a, raw

        return pack

    def by_table() -> DataFrame:
        """The bytes of the strings that a bit table asks for, each once in a flush."""
        width = _width(8 * count)

        def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, rows in _by_part(batches):  # a part is one pack
                doc, _, _, _, key, ids = _wanted(rows)
                bits = _bits(_wanted_key(key, ids, doc, fine_bits), fine_bits, width)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([bits], pa.binary())], ["part", "bits"])

        table = np.zeros(1 << (width - 3), np.uint8)
        for r in requests.mapInArrow(marked, "part int, bits binary").toLocalIterator():
            table[r["part"] * len(r["bits"]) : (r["part"] + 1) * len(r["bits"])] |= np.frombuffer(r["bits"], np.uint8)
        asked = spark.sparkContext.broadcast(table)  # of bounded size

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, data, size, base = [], [], 0, 0
            for own, doc, _, _ in candidates(batches):
                size += len(own.data)
                ids = own.ids()
                pick = np.flatnonzero(_has(asked.value, _wanted_key(own.key, ids, doc, fine_bits), fine_bits))
                if len(pick):
                    sizes = own.n[pick].astype(np.int64) + LENGTH - 1
                    data.append(_gathered(own.data, own.at[pick], sizes))
                    held.append((own.key[pick], ids[pick], doc[pick], base + np.cumsum(sizes) - sizes, sizes))
                    base += len(data[-1])
                if size >= FLUSH and held:
                    yield from flushed(held, pack_strings(data))
                    held, data, size, base = [], [], 0, 0
            if held:
                yield from flushed(held, pack_strings(data))

        return docs.mapInArrow(strings, "part int, n long, pack binary")

    def by_document() -> DataFrame:
        """The bytes of the strings asked for, from documents that meet their requests."""

        def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in _by_part(batches):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(_wanted(rows)[0]))], ["doc_id"])

        def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def packs(held):
                columns = [np.concatenate(v) for v in zip(*held)]
                part = _doc_part(columns[0], columns[1], parts_bits)
                order = np.lexsort((columns[2], columns[1], columns[0], part))
                columns, part = [c[order] for c in columns], part[order]
                rows = [(int(part[a]), b - a, _pack_wanted(*(c[a:b] for c in columns))) for a, b in _runs(part)]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "pack"])

            held, size = [], 0
            for _, rows in _by_part(batches):
                held.append(_wanted(rows))
                size += len(held[-1][0])
                if size >= HELD:
                    yield packs(held)
                    held, size = [], 0
            if held:
                yield packs(held)

        holding = spark.sparkContext.broadcast(_touched(requests.mapInArrow(holders, "doc_id long")))  # fixed size

        @F.pandas_udf("int")
        def part_if_holding(bit: pd.Series, doc: pd.Series, version: pd.Series) -> pd.Series:
            part = _doc_part(*(np.ascontiguousarray(v, np.int64) for v in (doc, version)), parts_bits)
            return pd.Series(np.where(_is_set(holding.value, bit), part, -1).astype(np.int32))

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, data, base = [], [], 0
            for _, rows in _by_part(batches):
                asked = [(n, pack) for n, pack, *_ in rows if pack is not None]
                if not asked:
                    continue
                doc, version, at, n, key, ids = _wanted(asked)
                heads = [a for a, _ in _runs(np.cumsum(np.concatenate([[0], (np.diff(doc) != 0) | (np.diff(version) != 0)])))]
                begin = dict(zip(zip(doc[heads].tolist(), version[heads].tolist()), zip(heads, [*heads[1:], len(doc)])))
                for *_, own_doc, own_version, text in rows:
                    a, b = begin.pop((own_doc, own_version), (0, 0)) if text is not None else (0, 0)
                    if a == b:
                        continue
                    text = np.frombuffer(text, np.uint8)
                    sizes = n[a:b] + LENGTH - 1
                    if (at[a:b] + sizes).max() > len(text) or (_range_ids(text, at[a:b], n[a:b]) != ids[a:b]).any():
                        raise ValueError("strings are missing: the documents changed between two passes")
                    data.append(_gathered(text, at[a:b], sizes))
                    held.append((key[a:b], ids[a:b], doc[a:b], base + np.cumsum(sizes) - sizes, sizes))
                    base += len(data[-1])
                    if base >= FLUSH:
                        yield from flushed(held, pack_strings(data))
                        held, data, base = [], [], 0
                if begin:
                    raise ValueError("strings are missing: the documents changed between two passes")
            if held:
                yield from flushed(held, pack_strings(data))

        texts = docs.select(part_if_holding(_doc_bit("doc_id"), "doc_id", "version").alias("part"), "doc_id", "version", "text")
        texts = texts.where("part >= 0").selectExpr("part", "cast(NULL AS long) AS n", "cast(NULL AS binary) AS pack", "doc_id", "version", "text")
        asked = requests.mapInArrow(dealt, "part int, n long, pack binary").selectExpr(
            "part", "n", "pack", "cast(NULL AS long) AS doc_id", "cast(NULL AS long) AS version", "cast(NULL AS binary) AS text"
        )
        met = asked.union(texts).repartition(tasks, "part").sortWithinPartitions("part")
        return met.mapInArrow(strings, "part int, n long, pack binary")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of the places whose minimizer has several strings."""

        def out(held):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*_sent_spans(held, parts_bits)), (pa.int32(), pa.int64(), pa.binary()))], ["part", "n", "pack"]
            )

        held, size = [], 0
        for _, rows in _by_part(batches):
            texts = [_unpack(pack, n, 4) for n, pack, rest in rows if pack is not None]
            if not texts:
                if any(rest is not None for *_, rest in rows):
                    raise ValueError("strings are missing: the documents changed between two passes")
                continue
            key, ids, low, sizes = (np.concatenate(v) for v in zip(*([
                np.cumsum(c[0].view(np.uint64), dtype=np.uint64), c[1].view(np.uint64),
                np.cumsum(c[2].view(np.uint64), dtype=np.uint64).view(np.int64), c[3],
            ] for c, _ in texts)))
            data = np.concatenate([d for _, d in texts])
            at = np.cumsum(sizes) - sizes
            order = np.lexsort((low, ids, key))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (key[order][1:] != key[order][:-1])
            pick = order[fresh]  # with the smallest document
            key, ids, low, sizes = key[pick], ids[pick], low[pick], sizes[pick]
            least = string_minima(key, _gathered(data, at[pick], sizes), sizes, low)
            windows = sizes - LENGTH + 1
            base = np.cumsum(windows) - windows
            by = np.argsort(ids, kind="stable")
            for n, rest in ((n, rest) for n, _, rest in rows if rest is not None):
                (own, doc, version, start), _ = _unpack(rest, n, 4)
                own, doc = (np.cumsum(v.view(np.uint64), dtype=np.uint64) for v in (own, doc))
                doc = doc.view(np.int64)
                string = by[np.minimum(np.searchsorted(ids[by], own), len(by) - 1)]
                if (ids[string] != own).any():
                    raise ValueError("strings are missing: the documents changed between two passes")
                many = windows[string]
                row = np.repeat(np.arange(n), many)
                step = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                gone = least[base[string][row] + step] < doc[row]
                same = row[1:] == row[:-1]
                begin, end = gone.copy(), gone.copy()
                begin[1:] &= ~(gone[:-1] & same)
                end[:-1] &= ~(gone[1:] & same)
                b, e = np.flatnonzero(begin), np.flatnonzero(end)
                if len(b):
                    held.append((doc[row[b]], version[row[b]], start[row[b]] + step[b], start[row[e]] + step[e] + LENGTH))
                    size += len(b)
            if size >= HELD:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    given = (by_table() if count <= ASKED else by_document()).selectExpr("part", "n", "pack", "cast(NULL AS binary) AS rest")
    open_ = known.where("rest IS NOT NULL").selectExpr("part", "n", "cast(NULL AS binary) AS pack", "rest")
    met = given.union(open_).repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(blocks, "part int, n long, pack binary")
    found = met.union(known.where("spans IS NOT NULL").selectExpr("part", "n", "spans AS pack")).repartition(tasks, "part").sortWithinPartitions("part")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_part(batches):
            yield _merged(rows)

    return found.mapInArrow(merged, "doc_id long, version long, spans array<struct<start: long, stop: long>>")


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows in an Arrow batch while the jobs inside run; texts are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def without_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary) per row of ``docs``.

    A null text is empty.  A null id counts as larger than all others, and rows of one id do
    not count as documents of their own.  The order of rows does not matter.
    """
    last = np.iinfo(np.int64).max
    rows = docs.select(
        F.coalesce(F.col(doc_id).cast("long"), F.lit(last)).alias("doc_id"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    # rows of one id are told apart by their text; where ids are unique that costs nothing
    unique = rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    rows = rows.withColumn("version", F.lit(0).cast("long") if unique else F.xxhash64("text"))
    with _small_batches(docs.sparkSession):
        spans = stored(removed_spans(rows))
    shared = docs.sparkSession.sparkContext.broadcast(_touched(spans))  # fixed size

    @F.pandas_udf("boolean")
    def touched(bit: pd.Series) -> pd.Series:
        return pd.Series(_is_set(shared.value, bit))

    # only documents with ranges, and a few others by chance, are moved or reach Python whole
    marked = rows.withColumn("touched", touched(_doc_bit("doc_id")))
    joined = marked.where("touched").join(spans, ["doc_id", "version"], "left").select("doc_id", "text", "spans")
    whole = marked.where("NOT touched").selectExpr(
        "doc_id", "cast(octet_length(text) AS long) AS n_bytes", "0L AS n_removed", "0L AS n_spans", "text AS kept"
    )

    # what lies between the ranges, joined as hexadecimal digits: linear in the text
    n_bytes = F.octet_length("text").cast("long")
    ends = F.concat(F.transform("spans", lambda s: s["start"]), F.array(n_bytes))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["stop"]))
    rest = F.transform(
        F.arrays_zip(begins.alias("a"), ends.alias("b")),
        lambda s: F.hex(F.substring("text", s["a"].cast("int") + 1, (s["b"] - s["a"]).cast("int"))),
    )
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    cut = joined.select(
        "doc_id", n_bytes.alias("n_bytes"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("spans").isNull(), 0).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.unhex(F.array_join(rest, ""))).alias("kept"),
    )
    out = cut.union(whole)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != last, F.col("doc_id")))
