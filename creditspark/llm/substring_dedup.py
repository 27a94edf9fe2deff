"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words, counted in Spark.

1. Documents are dealt into ranges of their key (about ``chars_per_range`` characters each), so ranges are in document
   order. Each range hashes all its windows, sorts the hashes (ties: key, then position) and sends each hash once, for its
   first window in the range, packed and cut by their top bits, to hash buckets. Later windows of a hash in the same
   range are repeats whatever other ranges hold, so they are marked there.
2. A bucket merges the sorted runs of all ranges in range order; every hash that an earlier range has too is marked. Only
   one bit per hash and range goes back.
3. Each range meets its bits again (the shuffled documents are reused), merges marked windows into maximal intervals
   and removes the words below them.

However many windows are equal, a hash has at most one entry per range in its bucket, as packed numbers (6 to 8 bytes), never rows.
Hashes have 64 bits: n windows collide with a probability of about n**2 / 2**65 (1e-3 for 2e8 windows).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import prepare, range_bounds, range_index

WINDOW = 20


def _sorted_windows(words: A.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of all windows by hash, then position."""
    at, h = A.window_hashes(words.hashes(), words.first, width)
    order = np.argsort(h, kind="stable")
    return at[order], h[order]


def _first_of_hash(sorted_hashes: np.ndarray) -> np.ndarray:
    """Whether each is the first of its equals."""
    first = np.ones(len(sorted_hashes), bool)
    first[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    return first


def pack(sorted_hashes: np.ndarray) -> bytes:
    """Gaps between sorted hashes, little endian, in as many bytes as the widest gap needs (first byte: that number)."""
    gaps = np.diff(sorted_hashes, prepend=np.uint64(0))
    width = max(1, (int(gaps[1:].max()).bit_length() + 7) // 8) if len(gaps) > 1 else 1
    body = gaps[1:].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + gaps[:1].astype("<u8").tobytes() + body.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    gaps = np.zeros((len(body) + 1, 8), np.uint8)
    gaps[0] = np.frombuffer(blob, np.uint8, 8, 1)
    gaps[1:, :width] = body
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


def _emit(width: int, bits: int):
    def emit(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, h = _sorted_windows(A.Words(*A.utf8(A.by_key(table)["text"])), width)
        h = h[_first_of_hash(h)]
        bounds = np.searchsorted(h, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, int)
        lo, hi = np.concatenate([[0], bounds]), np.concatenate([bounds, [len(h)]])
        full = np.flatnonzero(hi > lo)
        return pa.table({"bucket": pa.array(full, pa.int32()), "chunk": pa.array(np.full(len(full), chunk), pa.int32()),
                         "blob": pa.array([pack(h[lo[b]: hi[b]]) for b in full], pa.binary())})
    return emit


def _mark(table: pa.Table) -> pa.Table:
    """Bits of all entries of a bucket but the first of each hash, per range; a range has each hash once."""
    table = table.sort_by("chunk")
    runs = [unpack(b.as_py()) for b in table["blob"]]
    h = np.concatenate(runs)
    order = np.argsort(h, kind="stable")  # ranges stand in document order, so ties stay in it
    again = np.zeros(len(h), bool)
    again[order[1:]] = h[order[1:]] == h[order[:-1]]
    cut = np.cumsum([0, *map(len, runs)])
    rows = [(c, table["bucket"][0].as_py(), np.packbits(again[cut[i]: cut[i + 1]]).tobytes())
            for i, c in enumerate(table["chunk"].to_pylist()) if again[cut[i]: cut[i + 1]].any()]
    c, b, m = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(c, pa.int32()), "bucket": pa.array(b, pa.int32()), "marks": pa.array(m, pa.binary())})


def _remove(width: int, bits: int):
    def remove(table: pa.Table, marks: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        table = A.by_key(table)
        words = A.Words(*A.utf8(table["text"]))
        n = len(words.start)
        covered = np.zeros(n + 1, np.int32)
        at, h = _sorted_windows(words, width)
        first = _first_of_hash(h)
        again = at[~first]
        covered[again] += 1
        covered[again + width] -= 1
        if marks.num_rows:
            at, h = at[first], h[first]
            for bucket, blob in zip(marks["bucket"].to_pylist(), marks["marks"].to_pylist(), strict=True):
                lo = int(np.searchsorted(h, np.uint64(bucket) << np.uint64(64 - bits))) if bits else 0
                flags = np.unpackbits(np.frombuffer(blob, np.uint8))
                hit = at[lo: lo + len(flags)][np.flatnonzero(flags[: len(at) - lo])]
                covered[hit] += 1
                covered[hit + width] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        before = np.concatenate([[0], np.cumsum(gone)])
        n_removed = before[words.first[1:]] - before[words.first[:-1]]
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        # an interval may touch the next document's: cut it at document starts
        starts = np.union1d(np.flatnonzero(edge == 1), words.first[:-1][words.n_words > 0][gone[words.first[:-1][words.n_words > 0]]] if n else [])
        starts = starts.astype(np.int64)
        doc = np.searchsorted(words.first, starts, "right") - 1
        stops = np.flatnonzero(edge == -1)
        ends = np.minimum(stops[np.searchsorted(stops, starts, "right")], words.first[doc + 1]) if len(starts) else starts
        per_doc = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=table.num_rows))])
        spans = pa.StructArray.from_arrays([pa.array(starts - words.first[doc], pa.int32()), pa.array(ends - words.first[doc], pa.int32())], ["start", "end"])
        return pa.table({"key": table["key"].cast(pa.int64()), "n_words": pa.array(words.n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
                         "removed": A.list_array(per_doc, spans), "kept_text": words.join(~gone)})
    return remove


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WINDOW, chars_per_range: int = 4_000_000) -> DataFrame:
    """Removes every word below a window of ``width`` words that also starts earlier (smaller key; same document: earlier start).

    Returns per row: key, n_words, n_removed, removed (array of [start, end) word positions, maximal), kept_text (kept
    words joined by one space). Other columns of ``docs`` are not read, so their names cannot clash.

    Null or blank text: no words, kept_text ''. A document shorter than the window keeps everything. A null key counts as
    the smallest, rows with equal keys are ordered by text; of fully equal rows one comes first. Empty table: no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bounds = range_bounds(rows, "key", "text", chars_per_range)
    bits = max(0, math.ceil(math.log2(len(bounds) + 1)))
    rows = rows.select(range_index(F.col("key"), bounds).cast("int").alias("chunk"), "key", "text")
    ranged = rows.groupBy("chunk")
    sent = ranged.applyInArrow(_emit(width, bits), "bucket int, chunk int, blob binary")
    marks = sent.groupBy("bucket").applyInArrow(_mark, "chunk int, bucket int, marks binary")
    out = ranged.cogroup(marks.groupBy("chunk")).applyInArrow(
        _remove(width, bits), "key long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")
    return out.withColumnRenamed("key", key)
