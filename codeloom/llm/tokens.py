"""Token ids of whole texts, by way of a cache over words.

The word-level vocabulary drops white space, never merges across it, and never merges a
letter with a mark such as a comma.  So a text's ids are the ids of its segments in a row,
where segments are the runs between ASCII white space, cut where a letter meets such a mark.
Texts repeat their segments; a worker runs the merges once for each distinct one.  Cutting,
hashing and lookup are numpy operations over many texts at once.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

MARKS = b".,!?;:*#$%&"
LONGEST = 64  # bytes of a segment which is kept in the cache
SPACE, LETTER, MARK, LEAD, OTHER = range(5)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)
_LATIN = re.compile(rb"(?:[a-zA-Z]|\xc3[\xa0-\xb6\xb8-\xbf])+")


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, np.uint64(base))
    steps[0] = 1
    return np.multiply.accumulate(steps)


class WordTokenizer:
    """Encode texts with a tokenizers file.

    ``limit`` bounds the cached segments of one Python worker; a full cache is emptied.
    Segments are looked up by a 64-bit hash and their length.
    """

    def __init__(self, path: str, limit: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit = limit
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        reserved = set(b"".join(self.special))
        self.kind = np.full(256, OTHER, np.uint8)
        self.kind[list(b" \t\n\r\x0b\x0c")] = SPACE
        self.kind[list(range(65, 91)) + list(range(97, 123))] = LETTER
        self.kind[[b for b in MARKS if b not in reserved]] = MARK
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.vocabulary_size = max(vocabulary.values()) + 1
        self.last = np.zeros(self.vocabulary_size, bool)
        if suffix:
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.joins = bool(suffix)
        self.up, self.down = _powers(_BASE, 1 << 19), _powers(_BACK, 1 << 19)
        self._clear()

    def _clear(self) -> None:
        self.count = self.used = 0
        self.keys = np.zeros(1 << 14, np.uint64)
        self.starts = np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.slots = np.full(1 << 16, -1, np.int32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The cached entry of each hash, -1 for none."""
        mask = len(self.slots) - 1
        slot = ((hashes ^ (hashes >> np.uint64(29))) & np.uint64(mask)).astype(np.int64)
        found = self.slots[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != hashes))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & mask
            found[open_] = self.slots[slot[open_]]
            open_ = open_[(found[open_] >= 0) & (self.keys[found[open_]] != hashes[open_])]
        return found

    def _place(self, first: int, last: int) -> None:
        if 3 * last > len(self.slots):
            self.slots = np.full(4 * len(self.slots), -1, np.int32)
            first = 0
        mask = len(self.slots) - 1
        entry = np.arange(first, last)
        own = self.keys[first:last]
        slot = ((own ^ (own >> np.uint64(29))) & np.uint64(mask)).astype(np.int64)
        while len(entry):
            free = np.flatnonzero(self.slots[slot] < 0)
            chosen, at = np.unique(slot[free], return_index=True)
            self.slots[chosen] = entry[free[at]]
            rest = np.ones(len(entry), bool)
            rest[free[at]] = False
            entry, slot = entry[rest], (slot[rest] + 1) & mask

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The merges themselves.  Words of letters are joined, which saves calls; the end
        mark of their last token parts them again."""
        done: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if self.joins and _LATIN.fullmatch(w)]
        lines = [" ".join(words[i].decode() for i in plain[a : a + 64]) for a in range(0, len(plain), 64)]
        at = 0
        for encoded in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False):
            ids, start = encoded.ids, 0
            for stop in (np.flatnonzero(self.last[ids]) + 1).tolist():
                done[plain[at]] = ids[start:stop]
                at, start = at + 1, stop
        if at != len(plain):
            raise ValueError("the vocabulary does not mark the ends of words")
        rest = [i for i, ids in enumerate(done) if ids is None]
        for i, encoded in zip(rest, self.tokenizer.encode_batch_fast([words[i].decode() for i in rest], add_special_tokens=False)):
            done[i] = encoded.ids
        return done

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        encoded = self._encode_words(words)
        n, sizes = len(words), np.array([len(e) for e in encoded], np.int64)
        total = int(sizes.sum())

        def room(a: np.ndarray, need: int) -> np.ndarray:
            return a if need <= len(a) else np.concatenate([a, np.zeros(max(need - len(a), len(a)), a.dtype)])

        first = self.count
        self.keys, self.starts, self.sizes = (room(a, first + n) for a in (self.keys, self.starts, self.sizes))
        self.pool = room(self.pool, self.used + total)
        self.keys[first : first + n] = hashes
        self.sizes[first : first + n] = sizes
        self.starts[first : first + n] = self.used + np.cumsum(sizes) - sizes
        self.pool[self.used : self.used + total] = [i for e in encoded for i in e]
        self.count, self.used = first + n, self.used + total
        self._place(first, self.count)

    def _segments(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, stops) of all segments; texts do not run into each other."""
        kind = self.kind[data]
        letter, mark = kind == LETTER, kind == MARK
        # Latin letters of two bytes: which byte ends one, which byte begins one
        second = np.zeros(len(data), bool)
        second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0xA0) & (data[1:] <= 0xBF) & (data[1:] != 0xB7)
        begins = letter.copy()
        begins[:-1] |= second[1:]
        ends = letter | second
        filled = kind != SPACE
        cut = np.empty(len(data) + 1, bool)
        cut[0] = cut[-1] = True
        cut[1:-1] = (ends[:-1] & mark[1:]) | (mark[:-1] & begins[1:]) | (filled[:-1] != filled[1:])
        cut[bounds] = True
        edges = np.flatnonzero(cut)
        starts, stops = edges[:-1], edges[1:]
        real = filled[starts]
        return starts[real], stops[real]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has.  A null text has none."""
        if self.count > self.limit:
            self._clear()
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
        low, high = int(offsets[0]), int(offsets[-1])
        if low == high:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8, high - low, low)
        bounds = offsets - low
        starts, stops = self._segments(data, bounds)
        small = data.tobytes().lower()
        if not any(s.lower() in small for s in self.special):
            data = self.fold[data]
        if len(data) >= len(self.up):
            up, down = _powers(_BASE, len(data) + 1), _powers(_BACK, len(data) + 1)
        else:
            up, down = self.up, self.down
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(up[: len(data)] * (data.astype(np.uint64) + np.uint64(1)), out=sums[1:])
        hashes = (sums[stops] - sums[starts]) * down[starts]
        hashes ^= (stops - starts).astype(np.uint64) << np.uint64(57)
        hashes *= np.uint64(_BASE)
        entry = self._find(hashes)
        long = stops - starts > LONGEST
        entry[long] = -1
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            fresh = new[~long[new]]
            own, at = np.unique(hashes[fresh], return_index=True)
            if len(own):
                at = fresh[at]
                self._learn(own, [raw[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())])
                entry[fresh] = self._find(hashes[fresh])
        sizes = np.where(entry >= 0, self.sizes[entry], 0)
        extra = {}
        for i in np.flatnonzero(long).tolist():
            extra[i] = self._encode_words([raw[starts[i] : stops[i]]])[0]
            sizes[i] = len(extra[i])
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        begin = np.where(entry >= 0, self.starts[entry], 0)
        where = np.arange(total) + np.repeat(begin - (ends - sizes), sizes)
        if extra:
            where = np.minimum(where, len(self.pool) - 1)
        ids = self.pool[where]
        for i, own_ids in extra.items():
            ids[ends[i] - sizes[i] : ends[i]] = own_ids
        each = np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]
        return ids, np.diff(each)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this Python worker; its cache serves all tasks of the worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def slices(texts: pa.Array, size: int = 1 << 18):
    """(start, stop) of runs of texts with about ``size`` bytes each, at least one text."""
    held = np.array(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    groups = (np.cumsum(held) - held) // size
    edges = np.flatnonzero(np.diff(groups)) + 1
    stops = [*edges.tolist(), len(texts)] if len(texts) else []
    return list(zip([0, *stops[:-1]], stops))
