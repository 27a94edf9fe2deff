"""Regex matches with offsets, and texts cut at offsets, in DataFrame functions only and in linear time.

A fold that lengthens an array or a string copies it at every step, and a substring walks the text from its start; both are
quadratic in a text with many matches. Here running values are made in blocks of blocks, and texts are cut into chunks once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCHES = "array<struct<start:int,end:int,m:string>>"
#: elements of a block of ``running``; with LEVELS levels of blocks, BLOCK ** LEVELS elements make a block of the last level
BLOCK, LEVELS = 64, 3
#: code points of a chunk
CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold(values: Column, first: Column, combine: Callable[[Column, Column], Column]) -> Column:
    begin = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(combine(acc["at"], x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(values, begin, step, lambda acc: acc["out"])


def running(values: Column, combine: Callable[[Column, Column], Column] = lambda a, b: a + b, levels: int = LEVELS) -> Column:
    """Per element what ``combine`` (associative, 0 neutral) makes of the elements before it; array of int."""
    zero = F.lit(0)
    if levels == 0:
        return _fold(values, zero, combine)
    total = lambda b: F.aggregate(b, zero, lambda a, x: combine(a, x).cast("int"))
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, F.lit(BLOCK)))
    # of an empty array the last block number is -1; the sequence then counts down from 0, and both blocks are empty
    blocks_of = lambda v: F.when(F.size(v) == 0, F.array().cast("array<array<int>>")).otherwise(blocks(v))
    return let(values, lambda v: let(blocks_of(v), lambda b: let(
        running(F.transform(b, total), combine, levels - 1),
        lambda before: F.flatten(F.transform(b, lambda one, i: _fold(one, F.get(before, i), combine))))))


def matches(text: Column, pattern: str | Column, might: Column, measure: Callable[[Column], Column] = F.length) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as array of (start, end, m); only looked for where ``might`` holds.

    The pieces between the matches and the matches themselves alternate, so their lengths add up to the offsets (code points,
    or what else ``measure`` counts in a piece). Callers write repeated groups as possessive ones: Java then loops instead of
    recursing, however long the text.
    """
    regex = F.lit(pattern) if isinstance(pattern, str) else pattern
    found = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("m"))
    size = lambda x: F.coalesce(measure(x), F.lit(0)).cast("int")
    sized = F.transform(found, lambda x: F.struct(size(x["gap"]).alias("gap"), size(x["m"]).alias("n"), x["m"].alias("m")))

    def placed(rows: Column) -> Column:
        return let(running(F.transform(rows, lambda x: x["gap"] + x["n"])), lambda before: F.transform(rows, lambda x, i: F.struct(
            (F.get(before, i) + x["gap"]).alias("start"), (F.get(before, i) + x["gap"] + x["n"]).alias("end"), x["m"].alias("m"))))

    return F.when(might, F.filter(let(sized, placed), lambda s: s["m"].isNotNull()).cast(MATCHES)).otherwise(F.array().cast(MATCHES))


def tagged(kind: str, spans: Column) -> Column:
    """(start, kind, end) structs, which sort by start, then kind."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def in_order(spans: Column, kinds: list[str]) -> Column:
    """Spans (start, kind, end) by start, then kind as listed."""
    rank = F.create_map(*(x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))))
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(keyed)


def listing(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def chunks(text: Column) -> Column:
    """The text in pieces of CHUNK code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(pieces: Column, lo: Column, hi: Column) -> Column:
    """Code points lo to hi (exclusive) of the text in ``pieces``; '' if there are none."""
    first, last = F.floor(lo / CHUNK).cast("int"), F.floor(hi / CHUNK).cast("int")
    at = lambda i: F.coalesce(F.get(pieces, i), F.lit(""))
    between = F.concat(F.substring(at(first), lo % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                       F.substring(at(last), F.lit(1), hi % CHUNK))
    return F.when(hi <= lo, F.lit("")).when(first == last, F.substring(at(first), lo % CHUNK + 1, hi - lo)).otherwise(between)


def rewrite(text: Column, spans: Column, put: Callable[[Column, Column, Column], Column]) -> Column:
    """The text with every span (start, end, ...; in order of the starts) replaced by ``put(span, covered, pieces)``, where ``covered`` is how
    far the spans before it reach; what no span covers stays."""
    reach = lambda s: running(F.transform(s, lambda x: x["end"]), F.greatest)
    whole = lambda s: F.aggregate(s, F.lit(0), lambda a, x: F.greatest(a, x["end"]).cast("int"))

    def joined(s: Column, pieces: Column, before: Column) -> Column:
        parts = F.transform(s, lambda x, i: F.concat(cut(pieces, F.get(before, i), F.greatest(F.get(before, i), x["start"])), put(x, F.get(before, i), pieces)))
        return F.concat(F.array_join(parts, ""), let(whole(s), lambda end: cut(pieces, end, F.greatest(end, F.length(text)))))

    return let(spans, lambda s: let(chunks(text), lambda pieces: let(reach(s), lambda before: joined(s, pieces, before))))


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with every span (start, end, kind; in order, overlaps joined to what came first) replaced by [KIND]."""
    return rewrite(text, spans, lambda s, covered, _: F.when(s["start"] >= covered, F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(F.lit("")))
