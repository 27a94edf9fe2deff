"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items are cut into pieces of at most ``block_words`` words (pieces of one item overlap by one window less one word, so no
window is lost) and dealt over blocks of about that size, which are written. A block's words are broadcast and each worker builds their
automaton once. Documents stream through it word by word: the longest match that ends at a word is tracked along suffix
links, and wherever it reaches a whole window the window's words are hit. Documents never move: there is no shuffle. More
blocks are further passes over the same rows; after every ``PASSES`` of them the rows are written with their marks, so neither
the plan nor the driver, which holds one block at a time, grows with the benchmark.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import prepare, work_path

WINDOW = 10
#: blocks in one narrow plan, and automata that a worker keeps
PASSES = 4
#: bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z; everything else becomes a space
NORMAL = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class SuffixAutomaton:
    """Generalised suffix automaton of (item, words) sequences; ``width`` words make a window, shorter items are one."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.width = width
        self.vocab: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: fewest words that can be hit at all
        self.least = min([width, *(len(codes) for _, codes in coded)], default=width)
        self._windows(coded)

    def _extend(self, last: int, c: int) -> int:
        step, link, size = self.step, self.link, self.size
        if c in step[last]:
            q = step[last][c]
            return q if size[q] == size[last] + 1 else self._clone(last, c, q)
        new = len(size)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        step, link, size = self.step, self.link, self.size
        copy = len(size)
        step.append(dict(step[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = copy
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = copy
            p = link[p]
        return copy

    def _windows(self, coded: list[tuple[str, list[int]]]) -> None:
        """What a match tells: the state of its last ``width`` words with the items that hold them, and short items."""
        n, k = len(self.size), self.width
        self.window = [-1] * n  # state whose longest-to-shortest suffixes include the one of width words
        for v in sorted(range(n), key=self.size.__getitem__):
            if self.size[v] >= k:
                up = self.link[v]
                self.window[v] = self.window[up] if self.size[up] >= k else v
        holders: dict[int, set[str]] = {}
        own: dict[int, set[str]] = {}
        for name, codes in coded:
            v = 0
            for c in codes:
                v = self.step[v][c]
                if self.window[v] >= 0:
                    holders.setdefault(self.window[v], set()).add(name)
            if len(codes) < k:
                own.setdefault(v, set()).add(name)
        self.holders = {v: frozenset(s) for v, s in holders.items()}
        #: per state, the whole short items among its suffixes: (words, items)
        self.short: list[tuple] = [()] * n
        if own:
            for v in sorted(range(1, n), key=self.size.__getitem__):
                mine = ((self.size[v], frozenset(own[v])),) if v in own else ()
                self.short[v] = self.short[self.link[v]] + mine

    def scan(self, codes: np.ndarray) -> tuple[list[tuple[int, int]], set[str], int]:
        """(hit spans of words, merged; items found; longest match) of one document's word codes (-1: not in any item)."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0
        known = np.concatenate([[0], (codes >= 0).view(np.int8), [0]])
        edge = np.diff(known)
        step, link, size, window, short, k = self.step, self.link, self.size, self.window, self.short, self.width
        for lo, hi in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            if hi - lo < self.least:
                continue
            v = n = 0
            for at, c in enumerate(codes[lo:hi].tolist(), lo + 1):
                while v and c not in step[v]:
                    v = link[v]
                    n = size[v]
                if c not in step[v]:
                    continue
                v = step[v][c]
                n += 1
                if n > longest:
                    longest = n
                first = at
                for words, names in short[v]:
                    if words <= n:
                        first = min(first, at - words)
                        items |= names
                if n >= k:
                    first = min(first, at - k)
                    items |= self.holders[window[v]]
                if first < at:
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, at))
        return spans, items, longest


def _pieces(width: int, block_words: int):
    """item, part, n, words (normal, one blank between two) of items in pieces."""
    schema = pa.schema([("item", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("words", pa.binary())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = normal_words(text)
                step = max(1, block_words - (width - 1))
                for part, at in enumerate(range(0, max(1, len(words) - (width - 1) if len(words) > block_words else 1), step)):
                    piece = words[at: at + block_words]
                    if piece:
                        rows.append({"item": item, "part": part, "n": len(piece), "words": b" ".join(piece)})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
    return pieces


def item_blocks(items: DataFrame, item: str, text: str, width: int, block_words: int) -> tuple[DataFrame, int]:
    """(item, part, n, words, block), written, and the number of blocks: pieces dealt by hash over blocks of about ``block_words`` words."""
    rows = items.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    path = work_path(items.sparkSession, "benchmark-pieces")
    rows.mapInArrow(_pieces(width, block_words), "item string, part int, n long, words binary").write.parquet(path)
    pieces = items.sparkSession.read.parquet(path)
    n = max(1, math.ceil((pieces.agg(F.sum("n")).first()[0] or 0) / block_words))
    return pieces.withColumn("block", F.pmod(F.xxhash64("item", "part"), F.lit(n)).cast("int")), n


def _without(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at: words[a][0]])
        at = words[b - 1][1]
    out.append(text[at:])
    return b"".join(out).decode()


_MARKS = "struct<n_words:long,spans:array<struct<start:int,end:int>>,items:array<string>,longest:int>"


#: the automata that this worker built last, by name
_BUILT: dict[str, SuffixAutomaton] = {}


def _automaton(name: str, block: Broadcast, width: int) -> SuffixAutomaton:
    """The automaton of a broadcast block; a worker builds it once for all its tasks."""
    found = _BUILT.pop(name, None) or SuffixAutomaton([(item, words.split()) for item, words in block.value], width)
    _BUILT[name] = found
    while len(_BUILT) > PASSES:
        del _BUILT[next(iter(_BUILT))]
    return found


def _scan(name: str, block: Broadcast, width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            automaton = _automaton(name, block, width)
            get = automaton.vocab.get
            texts, found = batch.column(batch.schema.get_field_index("text")), batch.column(batch.schema.get_field_index("marks")).to_pylist()
            for i, old in enumerate(found):
                words = (texts[i].as_py() or "").encode().translate(NORMAL).split()
                codes = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                spans, items, longest = automaton.scan(codes)
                if old is not None and old["spans"]:
                    spans = _merge([(s["start"], s["end"]) for s in old["spans"]] + spans)
                found[i] = {"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans],
                            "items": sorted(items | set(old["items"])) if old is not None else sorted(items),
                            "longest": max(longest, old["longest"]) if old is not None else longest}
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string())), ("longest", pa.int32())])
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "marks"), pa.array(found, kind)],
                                             [*(n for n in batch.schema.names if n != "marks"), "marks"])
    return scan


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                       width: int = WINDOW, block_words: int = 100_000) -> DataFrame:
    """Marks the words of each document below any occurrence of an item's window.

    A window is ``width`` consecutive words of an item; a shorter item with any words is one window. Returns
    ``doc`` (struct of all columns of ``docs``, so no name can clash), ``text`` and ``marks``: n_words, spans (array of
    [start, end) word positions, merged), items (sorted ids of items found, as strings), longest (longest match in words).

    Null text has no words; items with null text are ignored, a null item id reads 'null'. Repeated items or rows give the
    same marks once each. Without items (or rows) nothing is marked. One very long text is scanned whole.
    """
    return _passes(docs, items, text, item, item_text, width, block_words)


def _passes(docs: DataFrame, items: DataFrame, text: str, item: str, item_text: str, width: int, block_words: int, finish=None) -> DataFrame:
    """The marked rows; with ``finish`` (batches of doc, text, marks to batches of doc, text) what it makes of them, in the last pass's own workers."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.select(F.struct("*").alias("doc")).schema["doc"].dataType.simpleString()
    out = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"), F.lit(None).cast(_MARKS).alias("marks"))
    blocks, n = item_blocks(items, item, item_text, width, block_words)
    run = uuid.uuid4().hex
    for i in range(n):
        if i and i % PASSES == 0:
            path = work_path(spark, f"benchmark-marks-{i}")
            out.write.parquet(path)
            out = spark.read.schema(out.schema).parquet(path)
        words = sorted((r.item, bytes(r.words)) for r in blocks.where(F.col("block") == i).select("item", "words").collect())  # one block
        scan = _scan(f"{run}-{i}", spark.sparkContext.broadcast(words), width)
        if finish and i == n - 1:
            return out.mapInArrow(lambda batches, scan=scan: finish(scan(batches)), f"doc {kind}, text string")
        out = out.mapInArrow(scan, f"doc {kind}, text string, marks {_MARKS}")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WINDOW,
                  max_span: int = 0, max_coverage: float = 0.5, block_words: int = 100_000) -> DataFrame:
    """The documents without contaminated passages, with the columns of ``docs``.

    Spans of more than ``max_span`` words are cut out of the text; a document whose hit words are more than
    ``max_coverage`` of its words goes as a whole. Clean documents keep their exact text (null stays null).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, marks, keep = batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for i, m in enumerate(marks):
                spans = [(s["start"], s["end"]) for s in m["spans"]]
                keep.append(sum(b - a for a, b in spans) <= max_coverage * m["n_words"])
                if keep[-1] and (long := [(a, b) for a, b in spans if b - a > max_span]):
                    texts[i] = _without(texts[i].encode(), long)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc", "text"]).filter(pa.array(keep, pa.bool_()))

    kept = _passes(docs, items, text, item, item_text, width, block_words, cut)
    return kept.select(*(F.col("text").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns))
