"""Phrase collocations by dynamic itemset counting.

1. Texts are cut into pieces and words once; slices of documents are written as numbered words. The files are dealt over ``shards`` shards.
2. Shards are scanned in turn, over and over. A scan counts all lengths at once: the words on the first visit, and a longer
   phrase from the scan on in which both its subphrases (without its last word, without its first) have reached the threshold. Every
   phrase is counted for one full cycle from its activation; one that is then below the threshold is forgotten. The cycles end
   when no phrase has reached the threshold for a whole cycle.
3. A phrase that reaches the threshold remembers one group of slices that it was counted in. A last scan spells each phrase out
   there and nowhere else, and joins give their scores.

Phrases are named by 64-bit hashes (n of them collide with a probability of about n**2 / 2**65). Tasks add up their
occurrences before the shuffle, so a frequent phrase is one number a task; counters are merged in buckets by hash, whose
number grows with the input. What reached the threshold goes to the next scan as a bitmap of fixed size (``bits``), one bit
a hash: a phrase that shares the bit of an active one is counted too early, which costs time and changes no count, and a
full bitmap would mean that all phrases are counted. A bitmap of (phrase, group) pairs does the same for the spelling. A position whose phrase was active at the shard's last visit has been
counted, so two bitmaps, the last visit's and the present one, tell what is new.
"""

from __future__ import annotations

import hashlib
import math
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .frames import batch_rows, prepare, remove_path, work_path
from .substring_dedup import pack, unpack

SHARDS = 4
#: log2 of the most bits of the bitmap of active phrases (2 ** 27 bits are 16 MB); a text of fewer characters has a bit each
BITS = 27
CHARS_PER_BUCKET = 4_000_000
#: distinct phrases that a task holds before it adds them up, bytes of a slice
HELD, SLICE = 500_000, 150_000
#: texts and slices of a Parquet or Arrow batch, bytes of a Parquet row group: tasks buffer that much
TEXTS, BATCH, ROW_GROUP = 64, 8, 16 << 20
#: salts of the first rounds of a ranking
SALTS = (256, 16)
NO_LANG = "und"

BREAKS = np.zeros(256, bool)
BREAKS[[ord(c) for c in ".,;:!?"]] = True
BREAKS[0x0A:0x0E] = True
KINDS = ~BREAKS
KINDS[[0x20, 0x09]] = False

#: slices of a group, the unit in which a task adds up and in which a phrase's home is kept
GROUP = 64

_COUNTS = "bucket int, len int, since int, home long, names binary, counts binary"
_STATE = "bucket int, len int, since int, names binary, counts binary, homes binary, flags binary, crossed long"


# --- words and phrases of a slice

def _lang_codes(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, index of each row's, their hashes)."""
    coded = column.dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = [int.from_bytes(hashlib.blake2b(n.encode(), digest_size=8).digest(), "little") for n in names]
    return names, np.asarray(coded.indices, np.int64), np.array(hashes, np.uint64)


def _joined(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of ``size`` bytes or little more, so that small batches make whole slices."""
    held, total = [], 0
    for batch in batches:
        held.append(batch)
        total += batch.nbytes
        if total >= size:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, total = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[A.Words, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(words, their hashes with the language mixed in, whether the next word stands in the same piece, language index per word, languages)."""
    offsets, raw = A.utf8(batch.column(0))
    names, code, hashes = _lang_codes(batch.column(1))
    for lo, hi in A.cuts(offsets, SLICE):
        words = A.Words(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]], lower=True, kinds=KINDS)
        lang = np.repeat(code[lo:hi], words.n_words)
        ends = BREAKS[words.buf]
        ends[words.doc_end] = True
        piece = np.cumsum(ends)[words.start]
        joined = np.zeros(len(piece), bool)
        joined[:-1] = piece[1:] == piece[:-1]
        yield words, A.mix(words.hashes() ^ hashes[lang]) if len(lang) else words.hashes(), joined, lang, names


def _phrase_names(h: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    total = np.zeros(len(at), np.uint64)
    for j in range(length):
        total = total * np.uint64(A.WORD_BASE) + h[at + j]
    return A.mix(total + np.uint64(length)) if length > 1 else total


class Bitmap:
    """Set of hashes by their top bits, out of its compressed form; bits of hashes that were never added may be set too."""

    def __init__(self, data: bytes, bits: int):
        self.data, self.shift = np.frombuffer(zlib.decompress(data), np.uint8), np.uint64(64 - bits)

    def holds(self, names: np.ndarray) -> np.ndarray:
        at = (names >> self.shift).astype(np.int64)
        return (self.data[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


#: the bitmaps that this worker used last, by name
_OPEN: dict[str, Bitmap] = {}


@dataclass(frozen=True)
class Sent:
    """A broadcast bitmap; a worker decompresses it once for all its tasks."""

    name: str
    bits: int
    data: Broadcast

    def open(self) -> Bitmap:
        found = _OPEN.pop(self.name, None) or Bitmap(self.data.value, self.bits)
        _OPEN[self.name] = found
        while len(_OPEN) > 2:
            del _OPEN[next(iter(_OPEN))]
        return found


def _paired(names: np.ndarray, homes: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Hashes of (name, home) that keep the name's bucket."""
    low = np.uint64((1 << (64 - bucket_bits)) - 1)
    return (names & ~low) | (A.mix(names ^ A.mix(homes.astype(np.uint64))) & low)


class Tally:
    """Occurrences by phrase length, added up whenever there are many."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, length: int, names: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            names, counts = np.unique(names, return_counts=True)
        if len(names):
            self.parts.setdefault(length, []).append((names, counts))
            self.held += len(names)

    def flush(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for length, parts in sorted(self.parts.items()):
            names, which = np.unique(np.concatenate([n for n, _ in parts]), return_inverse=True)
            # sums of a task's counts, far below 2 ** 53
            yield length, names, np.bincount(which, np.concatenate([c for _, c in parts]), len(names)).astype(np.int64)
        self.parts, self.held = {}, 0


def _by_bucket(names: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted names."""
    edges = np.searchsorted(names, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(64 - bucket_bits)) if bucket_bits else np.zeros(0, np.int64)
    edges = np.concatenate([[0], edges, [len(names)]])
    for bucket in np.flatnonzero(edges[1:] > edges[:-1]):
        yield int(bucket), int(edges[bucket]), int(edges[bucket + 1])


def _pack_counts(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<i8")


# --- tasks

_SHARD = pa.schema([("shard", pa.int32()), ("home", pa.int64()), ("names", pa.binary()), ("codes", pa.binary()), ("words", pa.binary()), ("sizes", pa.binary()),
                    ("lang", pa.binary()), ("totals", pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))])
_SHARD_SQL = "shard int, home long, names binary, codes binary, words binary, sizes binary, lang binary, totals array<struct<lang:string,n:long>>"


def _encode(shards: int):
    """Slices as numbered words: codes (number, and whether the next word is in the same piece) and, per number, hash, spelling and language."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, turn = TaskContext.get().partitionId(), 0
        for batch in _joined(batches, 10 * SLICE):
            for words, h, joined, lang, langs in _slices(batch):
                if not len(h):
                    continue
                names, first, code = np.unique(h, return_index=True, return_inverse=True)
                size = words.end[first] - words.start[first]
                count = np.bincount(lang, minlength=len(langs))
                yield pa.RecordBatch.from_pylist([{
                    "shard": task % shards, "home": task << 24 | turn // GROUP, "names": names.tobytes(),
                    "codes": ((code.astype(np.uint32) << np.uint32(1)) | joined).astype("<u4").tobytes(), "words": words.buf[A.ragged(words.start[first], size)[0]].tobytes(),
                    "sizes": size.astype("<u4").tobytes(), "lang": lang[first].astype("<u2").tobytes(), "totals": [{"lang": name, "n": int(n)} for name, n in zip(langs, count, strict=True)]}], _SHARD)
                turn += 1
    return encode


def _scan(step: int, longest: int, bucket_bits: int, now: Sent, before: Sent | None):
    """Counts what is active by bitmap ``now`` and was not by ``before`` (the bitmap of the shard's last visit, None if there was none)."""
    schema = pa.schema([("bucket", pa.int32()), ("len", pa.int32()), ("since", pa.int32()), ("home", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())])

    def send(tally: Tally, home: int | None) -> Iterator[pa.RecordBatch]:
        rows = [{"bucket": b, "len": length, "since": step, "home": home, "names": pack(names[lo:hi]), "counts": _pack_counts(counts[lo:hi])}
                for length, names, counts in tally.flush() for b, lo, hi in _by_bucket(names, bucket_bits)]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, home = Tally(), None
        for batch in batches:
            active, earlier = now.open(), before.open() if before else None
            for at_home, names, codes in zip(batch.column(0).to_pylist(), *((x.as_buffer() for x in batch.column(i)) for i in (1, 2)), strict=True):
                if at_home != home or tally.held >= HELD:
                    yield from send(tally, home)
                    home = at_home
                names, codes = np.frombuffer(names, np.uint64), np.frombuffer(codes, "<u4")
                word, joined = codes >> 1, (codes[:-1] & 1).astype(bool)
                h = names[word]
                has = active.holds(names)[word]
                had = earlier.holds(names)[word] if earlier else np.zeros(len(h), bool)
                if earlier is None:
                    tally.add(1, names, np.bincount(word, minlength=len(names)))
                for length in range(2, longest + 1):
                    at = np.flatnonzero(joined & has[:-1] & has[1:])
                    done = had[at] & had[at + 1]
                    if len(at) == 0:
                        break
                    phrase = _phrase_names(h, at, length)
                    tally.add(length, phrase[~done])
                    has, had = np.zeros(len(h), bool), np.zeros(len(h), bool)
                    has[at] = active.holds(phrase)
                    if earlier:
                        had[at] = done & earlier.holds(phrase)
        yield from send(tally, home)
    return scan


def _merge(step: int, shards: int, threshold: int, longest: int, bucket_bits: int, bits: int):
    """Adds up a bucket's counters; of those whose cycle is over, the ones below the threshold go."""

    def homes_of(row: int, size: int, table: pa.Table) -> np.ndarray:
        """Of a task's counts its group; of counters that reached the threshold theirs; -1 of the others."""
        if (home := table["home"][row].as_py()) is not None:
            return np.full(size, home, np.int64)
        kept = table["homes"][row].as_py()
        return _unpack_counts(kept) if kept is not None else np.full(size, -1, np.int64)

    def merge(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        length, since = table["len"].to_numpy(), table["since"].to_numpy()
        marks = np.zeros(1 << (bits - bucket_bits), bool)
        crossed, rows = 0, []
        for k in range(1, longest + 1):
            held = np.flatnonzero(length == k)
            if not len(held):
                continue
            runs = [unpack(table["names"][int(i)].as_py()) for i in held]
            names, counts = np.concatenate(runs), np.concatenate([_unpack_counts(table["counts"][int(i)].as_py()) for i in held])
            begun = np.repeat(since[held], [len(r) for r in runs])
            homes = np.concatenate([homes_of(int(i), len(r), table) for i, r in zip(held, runs, strict=True)])
            order = np.argsort(names, kind="stable")
            names, counts, begun, homes = names[order], counts[order], begun[order], homes[order]
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            total, old = np.add.reduceat(counts, first), np.add.reduceat(np.where(begun < step, counts, 0), first)
            names, begun, homes = names[first], np.minimum.reduceat(begun, first), np.maximum.reduceat(homes, first)
            reached = total >= threshold
            if k < longest:
                crossed += int((reached & (old < threshold)).sum())
            marks[(names[reached] >> np.uint64(64 - bits)).astype(np.int64) & (len(marks) - 1)] = True
            for s in np.unique(begun):
                for mine in ((begun == s) & reached, (begun == s) & ~reached):
                    done = s + shards - 1 <= step
                    if mine.any() and (reached[mine][0] or not done):
                        rows.append((bucket, k, int(s), pack(names[mine]), _pack_counts(total[mine]), _pack_counts(homes[mine]) if reached[mine][0] else None, None, None))
        rows.append((bucket, 0, step, None, None, None, zlib.compress(np.packbits(marks).tobytes(), 1), crossed))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["bucket", "len", "since", "names", "counts", "homes", "flags", "crossed"])
    return merge


def _pair_bits(bucket_bits: int, bits: int):
    """The bits of (phrase, home) of a bucket's finished phrases."""

    def pair_bits(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << (bits - bucket_bits), bool)
        for names, homes in zip(table["names"].to_pylist(), table["homes"].to_pylist(), strict=True):
            pairs = _paired(unpack(names), _unpack_counts(homes), bucket_bits)
            marks[(pairs >> np.uint64(64 - bits)).astype(np.int64) & (len(marks) - 1)] = True
        return pa.table({"bucket": table["bucket"][:1], "flags": pa.array([zlib.compress(np.packbits(marks).tobytes(), 1)], pa.binary())})
    return pair_bits


def _finished(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("name", pa.int64()), ("a", pa.int64())])
    for batch in batches:
        for names, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(unpack(names).view(np.int64)), pa.array(_unpack_counts(counts))], schema=schema)


def _spell(longest: int, bucket_bits: int, marks: Sent, pairs: Sent):
    """name, lang, len and words of the phrases of bitmap ``marks`` in the slices of their homes."""
    schema = pa.schema([("name", pa.int64()), ("lang", pa.string()), ("len", pa.int32()), ("phrase", pa.string())])

    def spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, at_home = marks.open(), pairs.open()
            for row in batch.to_pylist():
                names, codes = np.frombuffer(row["names"], np.uint64), np.frombuffer(row["codes"], "<u4")
                size = np.frombuffer(row["sizes"], "<u4").astype(np.int64)
                start = np.cumsum(size) - size
                text = np.append(np.frombuffer(row["words"], np.uint8), np.uint8(A.SPACE))
                langs = pa.array([t["lang"] for t in row["totals"]], pa.string())
                lang = np.frombuffer(row["lang"], "<u2").astype(np.int64)
                word, joined = (codes >> 1).astype(np.int64), (codes[:-1] & 1).astype(bool)
                h, has = names[word], np.zeros(0, bool)
                for length in range(1, longest + 1):
                    at = np.arange(len(h)) if length == 1 else np.flatnonzero(joined & has[:-1] & has[1:])
                    phrase = _phrase_names(h, at, length)
                    mine = kept.holds(phrase)
                    has = np.zeros(len(h), bool)
                    has[at[mine]] = True
                    phrase, first = np.unique(phrase[mine], return_index=True)
                    here = at_home.holds(_paired(phrase, np.full(len(phrase), row["home"], np.int64), bucket_bits))
                    phrase, first = phrase[here], at[mine][first[here]]
                    if not len(phrase):
                        if not has.any():
                            break
                        continue
                    each = word[(first[:, None] + np.arange(length)).ravel()]
                    # every word and the byte after it, which becomes the blank; the last word without
                    more = np.ones(len(each), np.int64)
                    more[length - 1:: length] = 0
                    index, offsets = A.ragged(start[each], size[each] + more)
                    out = text[index]
                    out[offsets[1:][more == 1] - 1] = A.SPACE
                    yield pa.RecordBatch.from_arrays([pa.array(phrase.view(np.int64)), langs.take(pa.array(lang[word[first]])), pa.array(np.full(len(phrase), length, np.int32)),
                                                      A.text_array(offsets[:: length], out)], schema=schema)
    return spell


# --- the operator

def _write(rows: DataFrame, path: str) -> None:
    """Rows of some 100 KB as Parquet: row groups and pages are measured after every few rows instead of the first 100, so that they
    are no larger than they should be, and no dictionary of such values is tried."""
    options = {"parquet.block.size": ROW_GROUP, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": BATCH, "parquet.enable.dictionary": "false"}
    rows.write.options(**options).parquet(path)


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", threshold: int = 30, longest: int = 4, shards: int = SHARDS,
                     bits: int = BITS, chars_per_bucket: int = CHARS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, len, a) of all phrases of 1 to ``longest`` words with a >= ``threshold``, and (lang, n): all words of each language.

    Null text counts as empty, a null language as 'und'. Repeated rows count each. An empty table gives no rows; other columns
    are not read. One very long text is one slice.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"))
    coded = work_path(spark, "dic-shards")
    with batch_rows(spark, TEXTS):
        # a file has one shard, so its statistics spare the scans of the others; a folder per shard would sort the slices in memory
        _write(rows.mapInArrow(_encode(shards), _SHARD_SQL), coded)
        chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    coded = spark.read.schema(_SHARD_SQL).parquet(coded)
    bits = min(bits, max(16, int(chars).bit_length()))
    bucket_bits = min(max(0, math.ceil(math.log2(max(1, chars / chars_per_bucket)))), bits - 3)

    run = uuid.uuid4().hex

    def bitmap(name: str, flags: DataFrame | None) -> Sent:
        """One bitmap out of its buckets' parts; the driver holds no more than that."""
        marks = bytearray(1 << (bits - 3))
        size = len(marks) >> bucket_bits
        for r in flags.select("bucket", "flags").toLocalIterator() if flags else ():
            marks[r.bucket * size: (r.bucket + 1) * size] = zlib.decompress(r.flags)
        return Sent(f"{run}-{name}", bits, spark.sparkContext.broadcast(zlib.compress(bytes(marks), 1)))

    versions = [bitmap("none", None)]
    with batch_rows(spark, BATCH):
        state, old, step, last_change = None, None, 0, -1
        while step <= last_change + shards:
            before = versions[step - shards] if step >= shards else None
            slices = coded.where(F.col("shard") == step % shards).select("home", "names", "codes")
            sent = slices.mapInArrow(_scan(step, longest, bucket_bits, versions[step], before), _COUNTS)
            have = spark.read.parquet(state).where("len > 0").drop("flags", "crossed") if state else spark.createDataFrame([], "bucket int, homes binary")
            sent = sent.unionByName(have, allowMissingColumns=True)
            path = work_path(spark, f"dic-counters-{step}")
            _write(sent.groupBy("bucket").applyInArrow(_merge(step, shards, threshold, longest, bucket_bits, bits), _STATE), path)
            flags = spark.read.parquet(path).where("len = 0")
            if flags.where("crossed > 0").count():
                last_change = step
            if step >= shards:
                versions[step - shards].data.destroy()  # the counters that it made are written
            versions.append(bitmap(str(step), flags))
            if old:
                remove_path(spark, old)
            state, old, step = path, state, step + 1
        finished = spark.read.parquet(state).where("homes is not null")
        pairs = bitmap("pairs", finished.select("bucket", "names", "homes").groupBy("bucket").applyInArrow(_pair_bits(bucket_bits, bits), "bucket int, flags binary"))
        counters = finished.select("names", "counts").mapInArrow(_finished, "name long, a long")
        slices = coded.select("home", "names", "codes", "words", "sizes", "lang", "totals")
        spelt = slices.mapInArrow(_spell(longest, bucket_bits, versions[-1], pairs), "name long, lang string, len int, phrase string").distinct()
        path = work_path(spark, "dic-phrases")
        spelt.join(counters, "name").select("lang", "phrase", "len", "a").write.parquet(path)
    totals = coded.select(F.explode("totals").alias("t")).groupBy("t.lang").agg(F.sum("t.n").alias("n")).where("n > 0")
    return spark.read.parquet(path), totals


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def score_phrases(phrases: DataFrame, totals: DataFrame, scale: int = 2_000_000, held_percent: int = 80) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases of two and more words, without those held by a longer one.

    Each cut of a phrase in two parts scores floor(scale * a / (l + r)); the lowest counts, of equal ones the first. A phrase goes if a longer one around it
    has at least ``held_percent`` of its occurrences. Products are decimals of 38 digits.
    """
    words = F.split("phrase", " ")
    some = phrases.where("len >= 2").select("lang", "phrase", "len", "a", words.alias("w"))
    counts = phrases.select("lang", "phrase", "a")
    part = lambda lo, size: F.array_join(F.slice("w", lo, size), " ")
    cuts = some.select("lang", "phrase", "a", "len", "w", F.explode(F.sequence(F.lit(1), F.col("len") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("len") - F.col("cut")).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
    cuts = cuts.withColumn("top", F.lit(scale).cast("decimal(38,0)") * _wide("a")).withColumn("base", _wide("l") + _wide("r"))
    least = cuts.select("lang", "phrase", "a", F.struct(F.expr("top div base").alias("score"), "cut", "l", "r").alias("s")) \
        .groupBy("lang", "phrase", "a").agg(F.min("s").alias("s"))
    # the parts of two and more words of every longer phrase
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("len") - 1), lambda size: F.transform(
        F.sequence(F.lit(1), F.col("len") - size + 1), lambda lo: F.array_join(F.slice("w", lo, size), " "))))
    around = some.where("len >= 3").select("lang", "a", F.explode(inner).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    kept = least.join(around, ["lang", "phrase"], "left").where(
        F.col("around").isNull() | (F.lit(100).cast("decimal(38,0)") * _wide("around") < F.lit(held_percent).cast("decimal(38,0)") * _wide("a")))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "s.l", "s.r", "n", "s.score")


def top_phrases(scored: DataFrame, first: int) -> DataFrame:
    """The first rows of each language by score, a (descending) and phrase, with their rank. Rounds over fewer and fewer salts keep
    ``first`` rows each, so that no task sorts a whole language."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    out = scored
    for salts in SALTS:
        w = Window.partitionBy("lang", "salt").orderBy(*order)
        out = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= first)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= first)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", first: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases. For nulls, repeats and empty tables see ``frequent_phrases``."""
    return top_phrases(score_phrases(*frequent_phrases(docs, text, lang, **options)), first)
