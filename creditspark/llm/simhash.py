"""SimHash fingerprints: weighted term hashes vote on signed bits; permuted block tables find fingerprints within a radius.

A term is a word with its successor (the last word with an end mark); its weight is the length of both, at most 16 bytes,
times 1 + ln(how often the text has it), so that a repeated line does not outvote the rest.
Each bit of a term's 128-bit hash votes plus or minus that weight; a fingerprint bit is 1 where the votes are positive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import prepare, range_bounds, range_index

BITS = 128
_END = np.uint64(0x5851F42D4C957F2D)


def fingerprints_of(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """(documents, 16) bytes; a document without words has zeros."""
    words = A.Words(offsets, raw)
    h, n_docs = words.hashes(), len(offsets) - 1
    out = np.zeros((n_docs, BITS // 8), np.uint8)
    if not len(h):
        return out
    nxt = np.append(h[1:], _END)
    size = words.end - words.start
    after = np.append(size[1:], 0)
    last = words.first[1:][words.n_words > 0] - 1
    nxt[last], after[last] = _END, 0
    weight = np.minimum(size + after, 16).astype(np.float64)
    term = A.mix(h * np.uint64(3) + A.mix(nxt))
    for d in np.flatnonzero(words.n_words):
        own = slice(words.first[d], words.first[d + 1])
        once, at, times = np.unique(term[own], return_index=True, return_counts=True)
        heavy = weight[own][at] * (1 + np.log(times))
        halves = np.stack([once, A.mix(once + _END)], 1).astype("<u8").view(np.uint8).reshape(-1, 16)
        ones = np.zeros(BITS)
        for lo in range(0, len(once), 10_000):  # a long text a part at a time
            ones += heavy[lo: lo + 10_000] @ np.unpackbits(halves[lo: lo + 10_000], axis=1).astype(np.float64)
        out[d] = np.packbits(2 * ones > heavy.sum())  # plus minus minus
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine that the share of equal bits estimates, from 0 (unrelated) to 1 (equal fingerprints)."""
    far = np.unpackbits(a ^ b, axis=1).sum(1)
    return np.maximum(np.cos(np.pi * far / BITS), 0.0)


def _hex(f: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes().hex() for x in f], pa.string())


def fingerprints(docs: DataFrame, text: str = "text", limit: int = 1_000_000) -> DataFrame:
    """``doc`` (struct of the columns of ``docs``, so names cannot clash) and ``fingerprint`` (32 hex digits) of each row's whole text.

    Null, empty or blank text: zeros. Equal texts have equal fingerprints. Narrow: rows stay where they are.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = A.utf8(batch.column(1))
            for lo, hi in A.cuts(offsets, limit):
                f = fingerprints_of(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _hex(f)], ["doc", "fingerprint"])

    return rows.mapInArrow(run, f"doc {rows.schema['doc'].dataType.simpleString()}, fingerprint string")


def block_keys(fingerprint: Column, radius: int, lead: int = 1) -> Column:
    """Keys of the permuted tables: ``radius + lead`` blocks, of which any two fingerprints within the radius share ``lead``.

    Each choice of ``lead`` blocks is one table, as if its blocks were permuted to the front; the key is the table and their digits.
    """
    digits = BITS // 4
    n = radius + lead
    if n > digits:
        raise ValueError(f"a radius of {radius} bits needs {n} blocks; there are {digits}")
    edges = [digits * i // n for i in range(n + 1)]
    return F.array(*(F.concat(F.lit(f"{t}:"), *(F.substring(fingerprint, edges[b] + 1, edges[b + 1] - edges[b]) for b in table))
                     for t, table in enumerate(combinations(range(n), lead))))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints of 32 hex digits."""
    def part(x: Column, i: int) -> Column:
        return F.conv(F.substring(x, i + 1, 8), 16, 10).cast("long")
    return sum((F.bit_count(part(a, i).bitwiseXOR(part(b, i))) for i in range(0, BITS // 4, 8)), F.lit(0))


def search(queries: DataFrame, stored: DataFrame, radius: int = 3, lead: int = 1, fingerprint: str = "fingerprint") -> DataFrame:
    """All (query, found, distance) of distinct fingerprints with distance up to ``radius``, for the fingerprints of ``queries``.

    Rows with equal fingerprints are one class: join on the fingerprint for members. Both sides are reduced to distinct
    fingerprints before the block join, so a third of all rows being copies adds one row.
    """
    q = queries.select(F.col(fingerprint).alias("query")).distinct()
    s = stored.select(F.col(fingerprint).alias("found")).distinct()
    q = q.withColumn("key", F.explode(block_keys(F.col("query"), radius, lead)))
    s = s.withColumn("key", F.explode(block_keys(F.col("found"), radius, lead)))
    pairs = q.join(s, "key").withColumn("distance", distance(F.col("query"), F.col("found"))).where(F.col("distance") <= radius)
    return pairs.select("query", "found", "distance").distinct()


def with_near_counts(rows: DataFrame, is_query: Column, radius: int = 3, fingerprint: str = "fingerprint") -> DataFrame:
    """Adds n_near: for the rows of ``is_query`` how many other rows have a fingerprint within ``radius`` bits, null for the rest.

    ``rows`` is read several times: a written table. Rows with one fingerprint are one class of known size, so copies are
    counted and not paired; rows that are no queries take no part in the last join.
    """
    asked, rest = rows.where(F.coalesce(is_query, F.lit(False))), rows.where(~F.coalesce(is_query, F.lit(False)))
    classes = rows.groupBy(F.col(fingerprint).alias("found")).agg(F.count(F.lit(1)).alias("n"))
    near = search(asked, classes.withColumnRenamed("found", fingerprint), radius, 1, fingerprint).join(classes, "found")
    counts = near.groupBy(F.col("query").alias(fingerprint)).agg((F.sum("n") - 1).alias("n_near"))
    return asked.join(counts, fingerprint).select(*rows.columns, "n_near").unionByName(rest.withColumn("n_near", F.lit(None).cast("long")))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dest, key, text, own), sorted by dest and falling key: each own row with the row after it."""
    waiting: list[tuple[int, int | None, str, bool]] = []
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        keys, texts, edited, nexts = zip(*done, strict=True)
        # the next text mostly is the next row's own
        known = [i + 1 if i + 1 < len(texts) and nexts[i] is texts[i + 1] else -1 for i in range(len(texts))]
        more = [t for t, k in zip(nexts, known, strict=True) if k < 0]
        own, changed, extra = (fingerprints_of(*A.utf8(pa.array(col, pa.large_string()))) for col in (texts, edited, more))
        following = own[known]
        following[np.array(known) < 0] = extra
        fps = own, changed, following
        out = pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
             _hex(fps[0]), _hex(fps[1]), pa.array(likeness(fps[0], fps[1])), pa.array(likeness(fps[0], fps[2]))],
            ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        done.clear()
        return out

    size = 0

    def pair(row: tuple, nxt: tuple | None) -> int:
        if not row[3]:
            return 0
        text, other = row[2], nxt[2] if nxt else row[2]
        n = len(text) // 3
        edited = text[: len(text) - n] + other[:n]
        done.append((row[1], text, edited, other))
        return len(text) + len(edited) + len(other)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            row = (row[0], row[1], row[2] or "", row[3])
            if waiting:
                last = waiting.pop()
                size += pair(last, row if row[0] == last[0] else None)
                if size > 1_500_000:
                    yield flush()
                    size = 0
            waiting.append(row)
    if waiting:
        size += pair(waiting.pop(), None)
    if done:
        yield flush()


def neighbour_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", chars_per_range: int = 4_000_000) -> DataFrame:
    """Fingerprints of each text, of its edited form (the last third replaced by the next document's beginning, in falling key
    order, the first following the last) and how like they and the next document's are.

    Texts are shuffled once, by ranges of the key; the first row of each range is also sent to the range before it in falling order, and the first
    row of all to the last range. Null text: empty. Equal keys: ordered by falling text. A null key counts as the smallest.
    A single row is its own next document. Empty table: no rows.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = range_bounds(rows, "key", "text", chars_per_range)
    rows = rows.withColumn("range", range_index(F.col("key"), bounds).cast("int"))
    # one row per range: its largest key, whose row the next higher range with rows needs; the top range's goes to the lowest
    tops = sorted(rows.groupBy("range").agg(F.max("key").alias("top")).collect())
    also = {top: tops[(i + 1) % len(tops)]["range"] for i, (_, top) in enumerate(tops)}
    if len(also) == 1 and tops[0]["range"] == next(iter(also.values())):
        targets = F.array(F.struct(F.col("range").alias("dest"), F.lit(0).alias("copy")), F.struct(F.col("range").alias("dest"), F.lit(1).alias("copy")))
        lead = F.when(F.col("key").eqNullSafe(F.lit(tops[0]["top"])), targets).otherwise(F.array(targets[0])) if tops else F.array(targets[0])
    else:
        places = [t["range"] for t in tops]
        target = F.get(F.lit([also[t["top"]] for t in tops]), (F.array_position(F.lit(places), F.col("range")) - 1).cast("int"))
        top = F.get(F.lit([t["top"] for t in tops]), (F.array_position(F.lit(places), F.col("range")) - 1).cast("int"))
        own = F.struct(F.col("range").alias("dest"), F.lit(0).alias("copy"))
        lead = F.when(F.col("key").eqNullSafe(top), F.array(own, F.struct(target.cast("int").alias("dest"), F.lit(1).alias("copy")))).otherwise(F.array(own))
    dealt = rows.select(F.explode(lead).alias("to"), "key", "text").select("to.dest", "to.copy", "key", "text")
    # copies come after all own rows of their range
    near = dealt.repartition(F.col("dest")).sortWithinPartitions("dest", "copy", F.col("key").desc_nulls_last(), F.col("text").desc())
    out = near.select("dest", "key", "text", (F.col("copy") == 0).alias("own")).mapInArrow(
        _neighbours, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("key", key)
