"""Byte-level BPE: encoding and decoding with offsets.

Pre-tokenisation uses no regex. Every code point becomes a symbol of a small alphabet (letter, number, other, white space,
with one code point of look-ahead for white space runs and contractions). A symbol is a transition function on eight
states; functions compose associatively, and all compositions that occur are numbered once (a few hundred), so a scan over
a slice of documents is a table look-up per code point: blocks of code points advance together, then the blocks' totals
are composed and applied. Where a transition starts a token is a boundary.

The slices between boundaries are looked up in a cache of merged slices; only a slice that is not in it is merged pair by
pair (lowest rank first). Token ids and the byte offset at which each token ends come out per document, so any range of
tokens can be decoded by itself.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import prepare

# symbols: letter, number, other, apostrophe before a one- and a two-letter contraction, white space that more white space
# or the end follows, the last of its run if a blank and if not, end of document
LETTER, NUMBER, OTHER, ONE, TWO, BLANKS, BLANK, BREAK, END = range(9)
# states: between tokens, in a letter, number or other token, after a single blank that joins the next token, in white space,
# one and two letters before the end of a contraction
IDLE, IN_LETTER, IN_NUMBER, IN_OTHER, IN_BLANK, IN_SPACE, LEFT_ONE, LEFT_TWO = range(8)
#: letters after an apostrophe: fixed values of the public pattern
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
#: code points with the White_Space property: fixed values
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


@lru_cache(1)
def code_point_classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANKS for every code point.

    Python's table is older and the ``regex`` module's newer than the tokenizer library's: where these two differ (code
    points assigned since), the library itself is asked, by whether it keeps the code point in one piece with a letter or digit.
    """
    kinds = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        top = unicodedata.category(chr(c))[0]
        if top == "L":
            kinds[c] = LETTER
        elif top == "N":
            kinds[c] = NUMBER
    kinds[list(WHITE)] = BLANKS
    newer = kinds.copy()
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\x00" for c in range(0x110000))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, every):
            newer[m.start(): m.end()] = kind
    asked = [c for c in np.flatnonzero(newer != kinds).tolist() if not 0xD800 <= c < 0xE000]
    ranks = {bytes([b]): b for b in range(256)}
    for c in asked:
        for lead in "a1":
            ranks[(lead + chr(c)).encode()] = len(ranks)
    library = tiktoken.Encoding("classes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for c in asked:
        kinds[c] = next((k for lead, k in (("a", LETTER), ("1", NUMBER)) if len(library.encode_ordinary(lead + chr(c))) == 1), OTHER)
    return kinds


@lru_cache(1)
def transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(compose, apply, boundary): product of two numbered functions, state after a function, whether a symbol starts a token.

    Functions 0 to 8 are the symbols; the rest are their compositions.
    """
    goes = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)

    def rule(symbol: int, to: int, joins: tuple[int, ...]) -> None:
        goes[symbol] = to
        starts[symbol, list(joins)] = False

    rule(LETTER, IN_LETTER, (IN_LETTER, IN_BLANK, LEFT_ONE, LEFT_TWO))
    goes[LETTER, LEFT_TWO], goes[LETTER, LEFT_ONE] = LEFT_ONE, IDLE
    rule(NUMBER, IN_NUMBER, (IN_NUMBER, IN_BLANK))
    rule(OTHER, IN_OTHER, (IN_OTHER, IN_BLANK))
    for symbol, to in ((ONE, LEFT_ONE), (TWO, LEFT_TWO)):
        rule(symbol, to, (IN_OTHER, IN_BLANK))
        goes[symbol, [IN_OTHER, IN_BLANK]] = IN_OTHER
    rule(BLANKS, IN_SPACE, (IN_SPACE,))
    rule(BLANK, IN_BLANK, ())
    rule(BREAK, IDLE, ())
    rule(END, IDLE, ())
    functions = [tuple(f) for f in goes]
    number = {}
    for i, f in enumerate(functions):
        number.setdefault(f, i)
    done = 0
    while done < len(functions):  # close under composition with one more symbol
        f = functions[done]
        done += 1
        for s in range(9):
            g = tuple(int(goes[s][x]) for x in f)
            if g not in number:
                number[g] = len(functions)
                functions.append(g)
    compose = np.array([[number[tuple(int(g) for g in (functions[s][x] for x in f))] for s in range(9)] for f in functions], np.uint16)
    return compose, np.array(functions, np.uint8), starts


def scan_states(symbols: np.ndarray, block: int = 256) -> np.ndarray:
    """State before every symbol, by a two-level associative scan that starts IDLE."""
    compose, apply, _ = transitions()
    n = len(symbols)
    rows = -(-n // block)
    grid = np.full(rows * block, END, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(rows, block).T)  # one contiguous row per step
    ahead = np.empty((block, rows), np.uint16)  # function of all symbols of the block so far
    flat, total = compose.reshape(-1), None
    for j in range(block):
        total = grid[j].astype(np.uint16) if total is None else flat[total.astype(np.int32) * 9 + grid[j]]
        ahead[j] = total
    begin = np.empty(rows, np.uint8)
    state = IDLE
    for r, f in enumerate(total.tolist()):
        begin[r] = state
        state = int(apply[f, state])
    before = np.empty((block, rows), np.uint8)
    before[0] = begin
    before[1:] = apply.reshape(-1)[ahead[:-1].astype(np.int32) * 8 + begin]
    return before.T.reshape(-1)[:n]


def boundaries(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Positions at which tokens start; ``ends`` are the positions of document separators (which count as starts)."""
    symbols = code_point_classes()[points]
    symbols[ends] = END
    nxt = np.append(symbols[1:], END)
    white = symbols == BLANKS
    last = white & (nxt != BLANKS) & (nxt != END)
    symbols[last] = np.where(points[last] == 32, BLANK, BREAK)
    quote = np.flatnonzero((points == 39) & (symbols == OTHER))
    if len(quote):
        follow = [np.append(points, (0, 0))[quote + i] for i in (1, 2)]
        inside = [np.append(symbols, (END, END))[quote + i] == LETTER for i in (1, 2)]
        for tail in CONTRACTIONS:
            fits = (follow[0] == ord(tail[0])) & inside[0]
            if len(tail) == 2:
                fits &= (follow[1] == ord(tail[1])) & inside[1]
            symbols[quote[fits]] = len(tail) + ONE - 1
    before = scan_states(symbols)
    return np.flatnonzero(transitions()[2].reshape(-1)[symbols.astype(np.int32) * 8 + before])


class Vocabulary:
    """Ranks of a byte-level BPE; merges of slices are cached by the slices' 64-bit hashes, a million at most."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, i in ranks.items():
            self.token[i] = token
        self.sizes = np.array([len(t) for t in self.token], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(self.token), np.uint8)
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for token, i in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        self.cache = A.HashCache()

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one slice: the whole slice if it is a token, else merges of the lowest rank first, leftmost on ties."""
        if raw in self.ranks:
            return (self.ranks[raw],)
        ids, pairs = [self.byte_id[b] for b in raw], self.pairs
        if len(ids) > 256:
            return self._merge_long(ids)
        found = [pairs.get(p, 1 << 30) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == 1 << 30:
                break
            i = found.index(best)
            ids[i: i + 2] = [best]
            del found[i]
            if i < len(found):
                found[i] = pairs.get((best, ids[i + 1]), 1 << 30)
            if i:
                found[i - 1] = pairs.get((ids[i - 1], best), 1 << 30)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        """The same with a heap and a linked list, for slices of any length."""
        import heapq

        pairs, n = self.pairs, len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := pairs.get((ids[p], ids[q]))) is not None:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        out, i = [], 0
        while i >= 0:
            out.append(ids[i])
            i = after[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, byte offset at which each token ends in its document, offsets of documents in ids)."""
        whole = "\n".join(texts) + "\n"
        points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        cuts = boundaries(points, ends)
        # the same places in the UTF-8 bytes
        raw = np.frombuffer(whole.encode(), np.uint8)
        if len(raw) > len(points):
            width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
            at = np.concatenate([[0], np.cumsum(width)])[cuts]
        else:
            at = cuts
        place = np.searchsorted(cuts, ends)  # separators are boundaries themselves
        inside = np.ones(len(cuts), bool)
        inside[place] = False
        start, end = at[inside], np.append(at[1:], len(raw))[inside]
        up, down = A.powers(A.BYTE_BASE, len(raw))
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(A.BYTE_CODES[raw] * up, out=total[1:])
        slices = A.mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
        body = raw.tobytes()
        ids, upto = A.cached_ids(self.cache, slices, lambda new: [self.merge(body[a:b]) for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
        offsets = np.concatenate([[0], upto[place - np.arange(len(place))]])
        byte_ends = np.cumsum(self.sizes[ids])
        base = np.concatenate([[0], byte_ends])[offsets[:-1]]
        return ids, (byte_ends - np.repeat(base, np.diff(offsets))).astype(np.int32), offsets

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of a run of ids; their token sizes are the offsets at which they are placed."""
        at, _ = A.ragged(self.starts[ids], self.sizes[ids])
        return self.bytes[at]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _encode(path: str, limit: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = batch.column(1)
            offsets, _ = A.utf8(texts)
            for lo, hi in A.cuts(offsets, limit):
                ids, ends, at = v.encode([t or "" for t in texts.slice(lo, hi - lo).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), A.list_array(at, pa.array(ids)), A.list_array(at, pa.array(ends))],
                                                 ["doc", "ids", "ends"])
    return encode


def bpe_encode(docs: DataFrame, path: str, text: str = "text", slice_bytes: int = 1_000_000) -> DataFrame:
    """Adds ``doc`` (struct of the columns of ``docs`` but the text), ``ids`` (array of token ids) and ``ends`` (byte offset
    at which each token ends in the UTF-8 text).

    ``path``: rank file (base64 token and rank a line) that every worker can read. Special tokens do not exist. Null or
    empty text: no ids. Rows, repeated ones too, are independent; one very long text is one slice. Names cannot clash,
    as the other columns stay inside ``doc``.
    """
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_encode(path, slice_bytes), f"doc {kind}, ids array<int>, ends array<int>")


#: rows that are decoded at once
DECODED_ROWS = 500


def _decoded(ids: pa.Array, v: Vocabulary) -> pa.Array:
    """The bytes of each list of ids (null: empty)."""
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(v.sizes[flat])])
    return A.binary_array(upto[np.concatenate([[0], np.cumsum(n)])], v.decode(flat))


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", slice_bytes: int = 1_000_000) -> DataFrame:
    """``doc``, ``ids`` and ``ends`` of :func:`bpe_encode` and ``decoded`` (the bytes of the ids) of :func:`bpe_decode`, by one Python worker
    a task: the two after each other have two, with the vocabulary in both, and send the ids to the JVM and back."""
    prepare(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest).alias("doc"), F.col(text).alias("text"))
    kind = rows.schema["doc"].dataType.simpleString()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in _encode(path, slice_bytes)(batches):
            for lo in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(lo, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _decoded(part.column(1), v)], ["doc", "ids", "ends", "decoded"])

    return rows.mapInArrow(both, f"doc {kind}, ids array<int>, ends array<int>, decoded binary")


def bpe_decode(tokens: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds ``to``: the bytes of the ids (null ids: empty). The other columns stay; one named ``to`` is replaced."""
    prepare(tokens.sparkSession)
    rest = [c for c in tokens.columns if c != to]
    rows = tokens.select(F.struct(*rest).alias("doc"), F.col(ids).alias("ids"))
    kind = rows.schema["doc"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(lo, DECODED_ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), _decoded(part.column(1), v)], ["doc", "decoded"])

    return rows.mapInArrow(decode, f"doc {kind}, decoded binary").select("doc.*", F.col("decoded").alias(to))


def decode_range(ids: np.ndarray, ends: np.ndarray, first: int, last: int, v: Vocabulary) -> tuple[int, bytes]:
    """(byte offset in the document, bytes) of tokens first:last, without decoding the others."""
    return (int(ends[first - 1]) if first else 0), v.decode(np.asarray(ids[first:last])).tobytes()
