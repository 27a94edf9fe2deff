"""Array helpers that run inside tasks: Arrow text to byte arrays, words, hashes and ragged gathers.

All functions work on whole slices of documents at once. A slice is a few MB of text (one document, however long, is
never cut), so the memory of a task is bounded by the slice size or its longest document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = 32
#: white space of the word rule ``[^\x20\x09-\x0D]+``, which is also what ``bytes.split()`` splits on
BLANK_BYTES = (9, 10, 11, 12, 13, 32)
#: odd multipliers of the rolling hashes (bytes into words, words into windows) and of the final mix
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95
MIX_A = 0xBF58476D1CE4E5B9
MIX_B = 0x94D049BB133111EB

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that nearby values land far apart."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX_A)
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX_B)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n (the base is odd)."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size <= 1 << 24:  # tables of one very long document are not kept
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64))
IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANK_BYTES)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset: column.offset + len(column) + 1] if off else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data and len(column) else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw


def cuts(offsets: np.ndarray, limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def by_key(table: pa.Table) -> pa.Table:
    """Rows by key, then text; nulls first."""
    if table.num_rows < 2:
        return table
    return table.take(pc.sort_indices(table, sort_keys=[("key", "ascending"), ("text", "ascending")], null_placement="at_start"))


class Words:
    """Words of consecutive documents as positions in one byte buffer; document d has words first[d]:first[d + 1]."""

    def __init__(self, offsets: np.ndarray, raw: np.ndarray, lower: bool = False, kinds: np.ndarray = IS_WORD):
        """``kinds``: 0 for bytes between words; a word also ends where two different kinds from 1 to 3 meet."""
        n_docs = len(offsets) - 1
        self.buf = np.full(len(raw) + n_docs, SPACE, np.uint8)
        keep = np.ones(len(self.buf), bool)
        ends = offsets[1:] + np.arange(n_docs)
        keep[ends] = False
        self.buf[keep] = LOWER[raw] if lower else raw
        kind = np.zeros(len(self.buf) + 1, np.int8)
        kind[1:] = kinds[self.buf]
        a, b = kind[:-1], kind[1:]
        if kinds.dtype == bool:
            cut = a != b
        else:
            cut = (a != b) & ((a == 0) | (b == 0) | ((a < 4) & (b < 4)))
        self.start = np.flatnonzero(cut & (b > 0))  # the buffer ends in a separator, so every word ends inside it
        self.end = np.flatnonzero(cut & (a > 0))
        self.doc_end = ends
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)])
        self.n_words = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of every word: rolling hash of its bytes, mixed with its length."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        up, down = powers(BYTE_BASE, len(self.buf))
        total = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum(BYTE_CODES[self.buf] * up, out=total[1:])
        rolled = (total[self.end] - total[self.start]) * down[self.start]
        return mix(rolled + (self.end - self.start).astype(np.uint64))

    def join(self, keep: np.ndarray) -> pa.Array:
        """Per document its kept words joined by one space."""
        s, e = self.start[keep], self.end[keep]
        doc = np.repeat(np.arange(len(self.n_words)), self.n_words)[keep]
        size = e - s + 1
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        size = size - last
        at, where = ragged(s, size)
        out = self.buf[at]
        out[(where[1:] - 1)[~last]] = SPACE
        per_doc = np.bincount(doc, size, len(self.n_words)).astype(np.int64)
        return text_array(np.concatenate([[0], np.cumsum(per_doc)]), out)


def window_hashes(word_hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): rolling hash of every ``width`` consecutive words of one document, by its first word."""
    n = len(word_hashes)
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers(WORD_BASE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hashes * up, out=total[1:])
    last = np.repeat(first[1:], np.diff(first))  # end of the document of each word
    at = np.flatnonzero(np.arange(n) + width <= last)
    return at, mix((total[at + width] - total[at]) * down[at])


def ragged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(indices, offsets) that gather starts[i]:starts[i] + sizes[i] for all i, one after another."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    index = np.arange(offsets[-1], dtype=np.int64)
    index += np.repeat(np.asarray(starts, np.int64) - offsets[:-1], sizes)
    return index, offsets


def text_array(offsets: np.ndarray, raw: np.ndarray) -> pa.Array:
    """Arrow strings out of valid UTF-8 bytes."""
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw)))


def binary_array(offsets: np.ndarray, raw: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


class HashCache:
    """Ids of pieces by the pieces' 64-bit hashes: open addressing in arrays, emptied when half full."""

    def __init__(self, bits: int = 21):
        self.bits = bits
        self.clear()

    def clear(self) -> None:
        size = 1 << self.bits
        self.keys, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.n, self.used = 0, 0
        self.start, self.size = np.zeros(size // 2 + 1, np.int64), np.zeros(size // 2 + 1, np.int32)
        self.flat = np.zeros(1 << 16, np.int32)

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        out = np.full(len(h), -1, np.int32)
        at, left = self._place(h), None
        while True:
            have = self.keys[at]
            hit = have == h
            if left is None:
                out[hit] = self.entry[at[hit]]
                left = np.flatnonzero(~hit & (have != 0))
            else:
                out[left[hit]] = self.entry[at[hit]]
                left = left[~hit & (have != 0)]
            if not len(left):
                return out
            at = at[~hit & (have != 0)] + 1 & (1 << self.bits) - 1
            h = h[~hit & (have != 0)]

    def has_room(self, n: int) -> bool:
        return self.n + n <= 1 << (self.bits - 1)

    def add(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New, distinct hashes with their ids, one run after another."""
        n, total = len(h), len(ids)
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used) + (1 << 16), np.int32)])
        self.flat[self.used: self.used + total] = ids
        self.start[self.n: self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.size[self.n: self.n + n] = sizes
        entry, at = np.arange(self.n, self.n + n, dtype=np.int32), self._place(h)
        while len(h):
            free = np.flatnonzero(self.keys[at] == 0)
            self.keys[at[free]] = h[free]
            won = free[self.keys[at[free]] == h[free]]
            self.entry[at[won]] = entry[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            h, at, entry = h[lost], at[lost] + 1 & (1 << self.bits) - 1, entry[lost]
        self.n += n
        self.used += total

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the entries, one after another."""
        at, offsets = ragged(self.start[entries], self.size[entries])
        return self.flat[at], offsets


def cached_ids(cache: HashCache, h: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of pieces by hash; ``encode`` takes positions of new pieces and returns their lists of ids."""
    h = np.where(h == 0, np.uint64(1), h)
    found = cache.lookup(h)
    missing = np.flatnonzero(found < 0)
    if len(missing):
        new, first, which = np.unique(h[missing], return_index=True, return_inverse=True)
        if not cache.has_room(len(new)):
            cache.clear()
            if not cache.has_room(len(new)):
                cache.bits = max(cache.bits, int(2 * len(h)).bit_length() + 1)  # one very long text
                cache.clear()
            new, first, which = np.unique(h, return_index=True, return_inverse=True)
            missing = np.arange(len(h))
        lists = encode(missing[first])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        base = cache.n
        cache.add(new, np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum())), sizes)
        found[missing] = base + which
    return cache.gather(found)
