"""Token ids on disk as directly addressable codes (DAC): random access to any id without decoding a block.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every id, level 1 the next chunk of those ids
that have one, and so on. Each level has a continuation bitmap (1: the id goes on in the next level) and a rank directory
(ones before every 512th bit), so id i is found by one byte, one bit and one rank a level.

File format: Parquet files in which a row is one shard of consecutive documents in ascending key order:
``shard``, ``keys`` (of its documents), ``ends`` (ids of the shard up to and with each document), ``n_ids`` and ``levels``, an
array of (chunks, more, ranks) as binary: bytes, bits (lowest first) and little-endian uint32. Spark's writer commits
the files, so a lost executor leaves nothing half written.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import arrays as A
from .frames import prepare, range_bounds, range_index

RANK_BITS = 512
LEVELS = "array<struct<chunks:binary,more:binary,ranks:binary>>"


def dac_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of a run of ids (unsigned 32-bit); at least one level."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]) if len(ones) else ones
        levels.append({"chunks": rest.astype(np.uint8).tobytes(), "more": np.packbits(more, bitorder="little").tobytes(), "ranks": ranks.astype("<u4").tobytes()})
        rest = rest[more] >> 8
        if not len(rest):
            return levels


class DacReader:
    """Random access to the ids of one shard."""

    def __init__(self, levels: list[dict[str, bytes]]):
        self.levels = [(np.frombuffer(x["chunks"], np.uint8), np.frombuffer(x["more"], np.uint8), np.frombuffer(x["ranks"], "<u4")) for x in levels]

    @staticmethod
    def _rank(more: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // RANK_BITS
        if block >= len(ranks):
            block = len(ranks) - 1
        if block < 0:
            return 0
        first = block * RANK_BITS
        bits = np.unpackbits(more[first // 8: (i + 7) // 8], bitorder="little")[: i - first]
        return int(ranks[block]) + int(bits.sum())

    def __getitem__(self, i: int) -> int:
        """Id at position i."""
        value = shift = 0
        for chunks, more, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not more[i >> 3] >> (i & 7) & 1:
                return value
            i, shift = self._rank(more, ranks, i), shift + 8
        raise ValueError("the last level cannot go on")

    def slice(self, first: int, last: int) -> np.ndarray:
        """Ids first:last: one contiguous run a level."""
        return self._slice(0, first, last)

    def _slice(self, level: int, first: int, last: int) -> np.ndarray:
        chunks, more, ranks = self.levels[level]
        out = chunks[first:last].astype(np.uint32)
        bits = np.unpackbits(more[first // 8: (last + 7) // 8], bitorder="little")[first % 8:][: last - first].astype(bool)
        n = int(bits.sum())
        if n:
            below = self._rank(more, ranks, first)
            out[bits] |= self._slice(level + 1, below, below + n) << 8
        return out


#: kinds of bytes: blanks, ASCII letters, digits, signs, and what stays with its neighbours (apostrophe, control, not ASCII)
_KINDS = np.full(256, 4, np.int8)
_KINDS[list(A.BLANK_BYTES)] = 0
_KINDS[33:127] = 3
_KINDS[48:58] = 2
_KINDS[65:91] = _KINDS[97:123] = 1
_KINDS[39] = 4
_WHOLE = np.where(_KINDS > 0, np.int8(4), np.int8(0))


class CachedTokenizer:
    """The tokenizers library with a cache of pieces.

    The vocabulary lower-cases, drops white space and never merges across ASCII white space, nor between ASCII letters, digits
    and signs (but the apostrophe), so a text's ids are those of such pieces, one after another. Slices with what may be a
    special token are cut at white space alone and keep their case.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        self.library = Tokenizer.from_file(path)
        self.cache = A.HashCache()
        names = self.library.get_vocab()
        #: ids that end a word
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True

    def encode(self, offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of the texts in them)."""
        marks = np.flatnonzero(raw[:-1] == 60)
        special = bool(len(marks)) and bool((raw[marks + 1] == 124).any())
        words = A.Words(offsets, raw, lower=not special, kinds=_WHOLE if special else _KINDS)
        if not len(words.start):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        whole = words.buf.tobytes()

        def encode(at: np.ndarray) -> list[list[int]]:
            pieces = [whole[a:b].decode() for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
            return self.encode_pieces(pieces)

        ids, upto = A.cached_ids(self.cache, words.hashes(), encode)
        return ids, upto[words.first]


    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Ids of each piece. Letters alone are one word with one word end, so many such pieces go as one text with blanks."""
        out: list[list[int]] = [[]] * len(pieces)
        words = [i for i, p in enumerate(pieces) if p.isalpha()]
        others = [i for i, p in enumerate(pieces) if not p.isalpha()]
        groups = [words[i: i + 100] for i in range(0, len(words), 100)]
        for group, e in zip(groups, self.library.encode_batch_fast([" ".join([pieces[i] for i in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = e.ids
            ends = (np.flatnonzero(self.ends_word[ids]) + 1).tolist()
            if len(ends) == len(group):
                for i, a, b in zip(group, [0, *ends], ends, strict=False):
                    out[i] = ids[a:b]
            else:  # a letter whose normal form is no letter
                others += group
        for i, e in zip(others, self.library.encode_batch_fast([pieces[i] for i in others], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out


@lru_cache(2)
def tokenizer(path: str) -> CachedTokenizer:
    return CachedTokenizer(path)


def _build(path: str, end_id: int):
    def build(table: pa.Table) -> pa.Table:
        t = tokenizer(path)
        shard = table["chunk"][0].as_py()
        table = A.by_key(table)
        offsets, raw = A.utf8(table["text"])
        parts, ends, done = [], [], 0
        for lo, hi in A.cuts(offsets):
            ids, at = t.encode(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]])
            parts.append(np.insert(ids, at[1:], end_id))
            ends.append(done + at[1:] + np.arange(1, hi - lo + 1))
            done = int(ends[-1][-1])
        levels = dac_levels(np.concatenate(parts))
        kind = pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("ranks", pa.binary())]))
        return pa.table({"shard": pa.array([shard], pa.int32()), "keys": pa.array([table["key"].to_pylist()], pa.list_(pa.int64())),
                         "ends": pa.array([np.concatenate(ends)], pa.list_(pa.int64())), "n_ids": pa.array([done], pa.int64()), "levels": pa.array([levels], kind)})
    return build


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = 1, chars_per_shard: int = 4_000_000) -> None:
    """Encodes every text, appends ``end_id`` and writes the ids to ``path`` in ascending key order (equal keys: by text).

    Null or empty text: the end id alone. A null key counts as the smallest. Empty table: an empty file set. Ids go from 0
    to 2**32 - 1. A shard holds about ``chars_per_shard`` characters of whole documents; one longer document is one shard.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bounds = range_bounds(rows, "key", "text", chars_per_shard)
    rows = rows.select(range_index(F.col("key"), bounds).cast("int").alias("chunk"), "key", "text")
    shards = rows.groupBy("chunk").applyInArrow(_build(tokenizer_path, end_id), f"shard int, keys array<long>, ends array<long>, n_ids long, levels {LEVELS}")
    shards.write.mode("overwrite").option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pydict()
            reader = DacReader(row["levels"][0])
            ends = row["ends"][0]
            for lo in range(0, len(ends), 500):  # a bounded number of documents at a time
                some = ends[lo: lo + 500]
                first = ends[lo - 1] if lo else 0
                ids = reader.slice(first, some[-1])
                at = np.array([first, *some]) - first
                yield pa.RecordBatch.from_arrays([pa.array(row["keys"][0][lo: lo + 500], pa.int64()), pa.array(row["base"][0] + at[:-1] + first, pa.int64()), pa.array(np.diff(at), pa.int64()),
                                                  A.binary_array(at * 4, ids.astype("<u4").view(np.uint8))], ["key", "start", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """Per document, from the files: key, start (ids of all documents before it), n_tokens (with the end id) and ids (little-endian uint32)."""
    prepare(spark)
    shards = spark.read.parquet(path)
    sizes = dict(shards.select("shard", "n_ids").collect())  # one row per shard of some million characters
    last = max(sizes, default=-1)
    base, total = [], 0
    for s in range(last + 1):
        base.append(total)
        total += sizes.get(s, 0)
    rows = shards.select("keys", "ends", "levels", F.get(F.lit([*base, total]).cast("array<long>"), F.col("shard")).alias("base"))
    return rows.mapInArrow(_documents, "key long, start long, n_tokens long, ids binary").withColumnRenamed("key", key)


def read_range(spark: SparkSession, path: str, first: int, last: int) -> np.ndarray:
    """Ids first:last of the whole store: only the shards that hold them are read, and of those only the wanted run is decoded."""
    sizes = sorted(spark.read.parquet(path).select("shard", "n_ids").collect())
    out, done = [], 0
    for shard, n in sizes:
        lo, hi = max(first, done), min(last, done + n)
        if lo < hi:
            row = spark.read.parquet(path).where(F.col("shard") == shard).select("levels").first()
            out.append(DacReader([x.asDict() for x in row.levels]).slice(lo - done, hi - done))
        done += n
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
