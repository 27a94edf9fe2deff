"""Vector codes: integer product quantisation over Hilbert-sorted flat blocks.

1. Vectors become integers and are cut into parts; every part of every vector is sorted along a Hilbert curve of its own cells
   and written in flat blocks of ``block_rows`` neighbours with the block's box (least and greatest components) and sums.
2. A round reads the blocks. The distances from the box to each codebook entry, least and greatest, leave the entries that can be
   nearest to any point of the block: its shortlist. With one entry left the block's sums go there as a whole; otherwise a small exact
   kernel takes each point's nearest entry of the shortlist, the lowest index of equals. Tasks add up counts and sums per entry.
3. New entries are the floors of the means; after the last round the blocks give every part's code and squared distance.

The codebooks (``entries`` x width integers) are all that the driver and the broadcasts hold, whatever the number of vectors. Equal
vectors are told apart by a row number in the sort, so a third of all rows with one vector fills many partitions, as many small boxes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import prepare, work_path

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS = 256
ROWS_PER_PARTITION = 100_000
KEY_BITS = 63
_LONG = 1 << 63


@dataclass(frozen=True)
class Codebooks:
    """Per part its entries, each a list of integers."""

    books: list[list[list[int]]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for book in self.books for entry in book for x in entry).encode()).hexdigest()

    def decode(self, code: str) -> list[int]:
        """The entries that a code names, one after another."""
        return [x for book, i in zip(self.books, range(0, len(code), 2), strict=True) for x in book[int(code[i: i + 2], 16)]]


def part_edges(width: int, parts: int) -> list[int]:
    return [width * i // parts for i in range(parts + 1)]


# --- Hilbert order

def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of cells (n x d integers below 2 ** bits), d * bits of at most 63 bits."""
    n, d = cells.shape
    if not d:
        return np.zeros(n, np.int64)
    axes = np.ascontiguousarray(cells.T.astype(np.int64))
    for level in range(bits - 1, 0, -1):
        half, low = 1 << level, (1 << level) - 1
        for i in range(d):
            upper = (axes[i] & half) != 0
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & low)
            axes[0] ^= np.where(upper, low, swap)
            axes[i] ^= swap
    for i in range(1, d):
        axes[i] ^= axes[i - 1]
    flip = np.zeros(n, np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(axes[-1] & (1 << level), (1 << level) - 1, 0)
    axes ^= flip
    key = np.zeros(n, np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (axes[i] >> level & 1)
    return key


def _cells(points: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    span = np.maximum(high.astype(float) - low, 0) + 1
    return np.clip((points.astype(float) - low) * ((1 << bits) / span), 0, (1 << bits) - 1).astype(np.int64)


# --- exact kernels

def _exact(*arrays: np.ndarray) -> type:
    """float64, int64 or Python's integers: the first in which sums of squared differences of these numbers are exact."""
    top = 2 * max((int(abs(e)) for a in arrays if a.size for e in (a.max(), a.min())), default=0)
    most = max(1, arrays[0].shape[-1]) * top * top
    return np.float64 if most < 1 << 53 else np.int64 if most < _LONG else object


def squared_distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances, points x entries."""
    kind = _exact(points, book)
    p, b = points.astype(kind), book.astype(kind)
    if kind is np.float64:  # every term is an integer below 2 ** 53
        return (p * p).sum(1)[:, None] - 2 * (p @ b.T) + (b * b).sum(1)[None, :]
    return np.stack([((p - e) ** 2).sum(1) for e in b], 1)


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that can be nearest to a point of the box: those no farther from it than some entry is from its farthest point."""
    kind = _exact(np.stack([low, high]), book)
    low, high, book = low.astype(kind), high.astype(kind), book.astype(kind)
    out = np.maximum(np.maximum(low - book, book - high), 0)
    far = np.maximum(abs(book - low), abs(high - book))
    return np.flatnonzero((out * out).sum(1) <= (far * far).sum(1).min())


# --- blocks

def _pack(points: np.ndarray) -> bytes:
    small = not points.size or max(abs(int(points.max())), abs(int(points.min()))) < 1 << 31
    return points.astype("<i4" if small else "<i8").tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    kind = "<i4" if len(data) == 4 * n * width else "<i8"
    return np.frombuffer(data, kind).reshape(n, width).astype(np.int64)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _cut(width: int, edges: list[int], books: list[np.ndarray]):
    """part, curve, rid, point: one row per part of a vector."""
    schema = pa.schema([("part", pa.int32()), ("curve", pa.int64()), ("rid", pa.int64()), ("point", pa.binary())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _vectors(batch.column(1), width)
            for part, (lo, hi) in enumerate(zip(edges, edges[1:])):
                points = rows[:, lo:hi]
                axes = points[:, :KEY_BITS]
                bits = max(1, min(16, KEY_BITS // max(1, axes.shape[1])))
                book = books[part][:, :KEY_BITS]
                keys = hilbert_keys(_cells(axes, book.min(0), book.max(0), bits), bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(points), part, np.int32)), pa.array(keys), batch.column(0),
                                                  pa.array([_pack(p) for p in points], pa.binary())], schema=schema)
    return cut


_BLOCK = "part int, n int, rids binary, low binary, high binary, sums binary, points binary"


def _blocks(edges: list[int], block_rows: int):
    """Sorted rows in blocks of one part each, with box and sums (None where 64 bits may not hold them)."""
    schema = pa.schema([("part", pa.int32()), ("n", pa.int32())] + [(c, pa.binary()) for c in ("rids", "low", "high", "sums", "points")])

    def block(part: int, rids: list[int], data: list[bytes]) -> dict:
        width = edges[part + 1] - edges[part]
        points = np.concatenate([_unpack(d, 1, width) for d in data])
        safe = not points.size or max(abs(int(points.max())), abs(int(points.min()))) < _LONG // len(points)
        low, high = points.min(0), points.max(0)
        return {"part": part, "n": len(rids), "rids": np.array(rids, "<i8").tobytes(), "low": low.astype("<i8").tobytes(), "high": high.astype("<i8").tobytes(),
                "sums": points.sum(0).astype("<i8").tobytes() if safe else None, "points": _pack(points)}

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rids, data = None, [], []
        for batch in batches:
            out = []
            for p, rid, point in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if rids and (p != part or len(rids) == block_rows):
                    out.append(block(part, rids, data))
                    rids, data = [], []
                part = p
                rids.append(rid)
                data.append(point)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if rids:
            yield pa.RecordBatch.from_pylist([block(part, rids, data)], schema)
    return blocks


def _read(batches: Iterable[pa.RecordBatch], edges: list[int]) -> Iterator[tuple]:
    """(part, n, rids, low, high, sums, points) of each block; the points only when called."""
    for batch in batches:
        for row in batch.to_pylist():
            width = edges[row["part"] + 1] - edges[row["part"]]
            low, high = np.frombuffer(row["low"], "<i8"), np.frombuffer(row["high"], "<i8")
            sums = np.frombuffer(row["sums"], "<i8") if row["sums"] is not None else None
            yield row["part"], row["n"], row["rids"], low, high, sums, lambda d=row["points"], n=row["n"], w=width: _unpack(d, n, w)


def _nearest(points: np.ndarray, short: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = squared_distances(points, book[short])
    at = d.argmin(1)  # the first of equals, and the shortlist ascends
    return short[at], d[np.arange(len(at)), at]


def _sum_entries(edges: list[int], books):
    """part, entry, n, sums (decimal) of what this task's blocks give each entry."""
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string()))])

    def sum_entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}

        def add(part: int, entry: int, n: int, sums: np.ndarray) -> None:
            have = total.setdefault((part, entry), [0, 0])
            have[0] += n
            have[1] = have[1] + sums.astype(object)  # Python's integers

        for part, n, _, low, high, sums, points in _read(batches, edges):
            book = books.value[part]
            short = shortlist(low, high, book)
            if len(short) == 1 and sums is not None:
                add(part, int(short[0]), n, sums)
                continue
            rows = points()
            at, _ = _nearest(rows, short, book)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
            part_sums = np.add.reduceat(rows[order].astype(np.int64 if sums is not None else object), first, axis=0)
            for entry, size, s in zip(at[order][first], np.diff(np.append(first, len(at))), part_sums, strict=True):
                add(part, int(entry), int(size), s)
        rows = [{"part": p, "entry": e, "n": n, "sums": [str(x) for x in s]} for (p, e), (n, s) in total.items()]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    return sum_entries


def _encode(edges: list[int], books):
    """rid, part, code, error of every point; an error beyond 64 bits is null."""
    schema = pa.schema([("rid", pa.int64()), ("part", pa.int32()), ("code", pa.int32()), ("error", pa.int64())])

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, n, rids, low, high, _, points in _read(batches, edges):
            at, d = _nearest(points(), shortlist(low, high, books.value[part]), books.value[part])
            error = pa.array([int(x) if x < _LONG else None for x in d], pa.int64()) if d.dtype == object else pa.array(d.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rids, "<i8")), pa.array(np.full(n, part, np.int32)), pa.array(at.astype(np.int32)), error], schema=schema)
    return encode


# --- the operator

def kept_vectors(vectors: DataFrame, key: str, vector: str, label: str | None, scale: int) -> DataFrame:
    """rid, key, label, v (integers) of the rows whose vector has only finite components."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(key).alias("key"), (F.col(label) if label else F.lit(None).cast("int")).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("v").isNotNull() & finite).select(
        F.monotonically_increasing_id().alias("rid"), "key", "label", F.transform("v", lambda x: F.floor(x * float(scale)).cast("long")).alias("v"))


def compress_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Codebooks]:
    """(key, label, code, error) of every kept row, and the codebooks.

    Rows whose vector is null or holds null, NaN or infinite components are dropped, and so are those of another width than the row
    with the smallest key has (equal keys: the smallest vector). Null keys come last; repeated keys are rows of their own. Parts
    differ by one component where the width is no multiple of ``parts``. Fewer rows than ``entries`` make shorter codebooks; no rows, empty
    ones. Components saturate at 64 bits; an error beyond 64 bits is null. ``entries`` is at most 256: a code has two hex digits a part.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    spark = vectors.sparkSession
    prepare(spark)
    path = work_path(spark, "vectors-kept")
    kept_vectors(vectors, key, vector, label, scale).write.parquet(path)
    kept = spark.read.parquet(path)
    first = kept.select("key", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(1).collect()
    width = len(first[0].v) if first else 0
    kept = kept.where(F.size("v") == width)
    edges = part_edges(width, parts)
    start = [r.v for r in kept.select("key", "v").orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()]  # at most ``entries`` rows
    books = [np.array([v[lo:hi] for v in start], np.int64).reshape(len(start), hi - lo) for lo, hi in zip(edges, edges[1:])]
    coded = spark.createDataFrame([], "rid long, part int, code int, error long")
    if start:
        rows = kept.select("rid", "v").mapInArrow(_cut(width, edges, books), "part int, curve long, rid long, point binary")
        n = max(1, math.ceil(kept.count() * parts / ROWS_PER_PARTITION))
        flat = rows.repartitionByRange(n, "part", "curve", "rid").sortWithinPartitions("part", "curve", "rid")
        path = work_path(spark, "vectors-blocks")
        flat.mapInArrow(_blocks(edges, block_rows), _BLOCK).write.parquet(path)
        blocks = spark.read.parquet(path)
        for _ in range(rounds):
            books = _next_books(blocks, edges, books)
        coded = blocks.mapInArrow(_encode(edges, spark.sparkContext.broadcast(books)), "rid long, part int, code int, error long")
    codes = F.concat(*(F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == i, F.col("code"))))), 2, "0") for i in range(parts)))
    rows = coded.groupBy("rid").agg(codes.alias("code"), F.when(F.count("error") == parts, F.try_sum("error")).alias("error"))
    out = kept.select("rid", "key", "label").join(rows, "rid")
    return out.select(F.col("key").alias(key), *([F.col("label").alias(label)] if label else []), "code", "error"), Codebooks([b.tolist() for b in books])


def _next_books(blocks: DataFrame, edges: list[int], books: list[np.ndarray]) -> list[np.ndarray]:
    """The floors of the means of what is nearest to each entry; an entry that has nothing stays."""
    widest = max(b - a for a, b in zip(edges, edges[1:]))
    sent = blocks.sparkSession.sparkContext.broadcast(books)
    sums = blocks.mapInArrow(_sum_entries(edges, sent), "part int, entry int, n long, sums array<string>")
    wide = T.DecimalType(38, 0)
    total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i)).cast(wide)) for i in range(widest))).alias("sums"))
    out = [b.copy() for b in books]
    for r in total.collect():  # parts x entries rows
        out[r.part][r.entry] = [int(x) // r.n for x in r.sums[: edges[r.part + 1] - edges[r.part]]]
    sent.unpersist()
    return out


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """Adds label_error: the error summed over rows of equal label, null labels together (null where 64 bits do not hold it)."""
    path = work_path(coded.sparkSession, "vectors-coded")
    coded.write.parquet(path)
    coded = coded.sparkSession.read.parquet(path)
    sums = coded.groupBy(F.col(label).alias("of")).agg(F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error")).alias("label_error"))
    return coded.join(sums, F.col(label).eqNullSafe(F.col("of"))).drop("of")
