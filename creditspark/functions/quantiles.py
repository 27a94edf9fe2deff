"""Exact quantiles and order statistics with bounded memory.

``F.percentile`` is exact but keeps a map of every distinct value of the
column in one final task, which fails for a continuous column at scale. Here
exact order statistics are found by bracketing:

1. one aggregate computes counts and ``percentile_approx`` brackets around
   each wanted rank (the sketch's rank error is at most n / accuracy);
2. one aggregate checks each bracket really holds its rank (widening it when
   the sketch missed) and counts the rows inside and on its ends; a rank on an end is solved, and a
   bracket still too wide loses its ends and is narrowed with another sketch restricted to its interior;
3. one grouped pass returns the (value, count) pairs inside the brackets,
   at most ``max_collect`` per bracket, and the driver walks them.

Quantiles use linear interpolation between order statistics, the default of
pandas, numpy, DuckDB ``quantile_cont`` and Spark ``percentile``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPEN = None  # unbounded bracket side


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    pos = p * (n - 1)
    lo = int(math.floor(pos))
    hi = min(lo + 1, n - 1)
    return lo, hi, pos - lo


def _solve(data: DataFrame, counts: list[int],
           init: dict[tuple[int, int], tuple[float | None, float | None] | None],
           accuracy: int, max_collect: int) -> dict[tuple[int, int], float]:
    """Order statistics of columns ``_q{i}`` of ``data``: {(i, rank): value}.

    ``init`` gives a starting bracket (from a sketch) per (column, rank), or
    None to start from the whole column. A bracket is an interval with closed or open ends.
    Each round counts, per bracket, the rows below, inside and on its two ends: a rank that falls on an
    end is solved, else the ends are cut off (open interior), so a hot value on an end never keeps a
    bracket wide. Every round solves, opens or narrows each bracket, so the rounds end by themselves.
    """
    eps = 2.0 / accuracy
    out: dict[tuple[int, int], float] = {}
    targets: dict[tuple[int, int], dict] = {}
    for (i, r), br in init.items():
        lo, hi = (_OPEN, _OPEN) if br in (None, "all") else br
        targets[(i, r)] = {"L": lo, "U": hi, "strict": False, "below": 0, "within": counts[i],
                           "ok": counts[i] <= max_collect or br == "all"}
        if targets[(i, r)]["ok"]:
            # whole column, grouped: small, or few distinct values
            targets[(i, r)].update(L=_OPEN, U=_OPEN)

    def in_bracket(i: int, t: dict):
        c = F.col(f"_q{i}")
        cond = c.isNotNull()
        if t["L"] is not _OPEN:
            cond = cond & ((c > F.lit(t["L"])) if t["strict"] else (c >= F.lit(t["L"])))
        if t["U"] is not _OPEN:
            cond = cond & ((c < F.lit(t["U"])) if t["strict"] else (c <= F.lit(t["U"])))
        return cond

    while pending := [key for key, t in targets.items() if not t["ok"]]:
        exprs = []
        for j, (i, r) in enumerate(pending):
            t = targets[(i, r)]
            c = F.col(f"_q{i}")
            zero = F.lit(0)
            below = zero if t["L"] is _OPEN else F.count_if((c <= F.lit(t["L"])) if t["strict"] else (c < F.lit(t["L"])))
            on_l = zero if t["L"] is _OPEN or t["strict"] else F.count_if(c == F.lit(t["L"]))
            on_u = zero if t["U"] is _OPEN or t["strict"] else F.count_if(c == F.lit(t["U"]))
            exprs += [below.cast("bigint").alias(f"b{j}"), F.count_if(in_bracket(i, t)).alias(f"w{j}"),
                      on_l.cast("bigint").alias(f"l{j}"), on_u.cast("bigint").alias(f"u{j}")]
        row = data.agg(*exprs).first()
        refine = []
        for j, (i, r) in enumerate(pending):
            t = targets[(i, r)]
            below, within, on_l, on_u = (row[f"{x}{j}"] for x in "bwlu")
            if below > r:
                t.update(L=_OPEN, strict=False)          # the sketch overshot: open the lower side
            elif below + within <= r:
                t.update(U=_OPEN, strict=False)          # the sketch undershot: open the upper side
            elif on_l and r < below + on_l:
                out[(i, r)] = t["L"]
            elif on_u and r >= below + within - on_u:
                out[(i, r)] = t["U"]
            else:
                t.update(below=below, within=within)
                if within <= max_collect:
                    t["ok"] = True
                    continue
                if not t["strict"] and t["L"] is not _OPEN and t["U"] is not _OPEN:
                    t.update(strict=True, below=below + on_l, within=within - on_l - on_u)
                    if t["within"] <= max_collect:
                        t["ok"] = True
                        continue
                refine.append((j, i, r))
        for key in out:
            targets.pop(key, None)
        if refine:
            sk = []
            for j, i, r in refine:
                t = targets[(i, r)]
                rel = (r - t["below"]) / max(1, t["within"] - 1)
                ps = [max(0.0, rel - eps), min(1.0, rel + eps)]
                sk.append(F.percentile_approx(F.when(in_bracket(i, t), F.col(f"_q{i}")), ps, accuracy)
                          .alias(f"s{j}"))
            srow = data.agg(*sk).first()
            for j, i, r in refine:
                t = targets[(i, r)]
                t["L"], t["U"] = srow[f"s{j}"]
                t["strict"] = False
    keys = list(targets)
    if not keys:
        return out
    # one grouped pass; targets sharing a bracket share its rows
    brackets: dict[tuple, int] = {}
    for (i, r) in keys:
        t = targets[(i, r)]
        brackets.setdefault((i, t["L"], t["U"], t["strict"]), len(brackets))
    tagged = F.explode(F.array(*[
        F.when(in_bracket(i, {"L": lo, "U": hi, "strict": st}), F.struct(F.lit(b).alias("t"), F.col(f"_q{i}").alias("v")))
        for (i, lo, hi, st), b in brackets.items()])).alias("e")
    rows = (data.select(tagged).where(F.col("e").isNotNull())
            .groupBy("e.t", "e.v").count().collect())
    per_bracket: dict[int, list[tuple[float, int]]] = {}
    for rw in rows:
        per_bracket.setdefault(rw["t"], []).append((rw["v"], rw["count"]))
    for vals in per_bracket.values():
        vals.sort()
    for (i, r) in keys:
        t = targets[(i, r)]
        acc = t["below"]
        for v, cnt in per_bracket.get(brackets[(i, t["L"], t["U"], t["strict"])], []):
            acc += cnt
            if acc > r:
                out[(i, r)] = v
                break
    return out


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] | dict, *,
                    accuracy: int = 10000, max_collect: int = 100000,
                    extra_aggs: Sequence | None = None, extra_out: dict | None = None
                    ) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}`` over non-NULL values (NULL if none).

    ``probs`` is one list for every column or ``{column: [probs]}``.
    ``extra_aggs`` are aggregate columns computed in the same first pass; their
    values are stored in ``extra_out`` (fuses e.g. mean/std/min/max with the
    quantile sketch). Columns with few distinct values (HyperLogLog estimate
    well below ``max_collect``) skip the brackets: their grouped values are
    collected directly.
    """
    cols = list(cols)
    per_col = {c: [float(p) for p in (probs[c] if isinstance(probs, dict) else probs)] for c in cols}
    data = df.select(*[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(cols)])
    eps = 2.0 / accuracy
    sk_probs = {c: sorted({min(1.0, max(0.0, p + s)) for p in per_col[c] for s in (-eps, eps)}) for c in cols}
    extra_aggs = list(extra_aggs or [])
    src = df.select(*[F.col(c).cast("double").alias(f"_q{i}") for i, c in enumerate(cols)], "*") \
        if extra_aggs else data
    first = src.agg(*[F.count(f"_q{i}").alias(f"n{i}") for i in range(len(cols))],
                    *[F.approx_count_distinct(f"_q{i}", 0.05).alias(f"d{i}") for i in range(len(cols))],
                    *[F.percentile_approx(f"_q{i}", sk_probs[c], accuracy).alias(f"a{i}")
                      for i, c in enumerate(cols)],
                    *[e.alias(f"x{j}") for j, e in enumerate(extra_aggs)]).first()
    if extra_out is not None:
        for j in range(len(extra_aggs)):
            extra_out[j] = first[f"x{j}"]
    counts = [first[f"n{i}"] for i in range(len(cols))]
    init: dict[tuple[int, int], tuple | None] = {}
    for i, c in enumerate(cols):
        if not counts[i]:
            continue
        few = first[f"d{i}"] is not None and first[f"d{i}"] * 2 <= max_collect
        sk = dict(zip(sk_probs[c], first[f"a{i}"])) if first[f"a{i}"] and not few else None
        for p in per_col[c]:
            lo, hi, _ = _ranks(counts[i], p)
            br = None if sk is None else (sk[max(0.0, p - eps)], sk[min(1.0, p + eps)])
            init.setdefault((i, lo), br)
            init.setdefault((i, hi), br)
    # with no bracket, a column's grouped values are collected whole: allowed
    # when it is small or has few distinct values
    big = [i for i, c in enumerate(cols) if counts[i] and counts[i] > max_collect]
    for (i, r), br in list(init.items()):
        if br is None and i in big:
            init[(i, r)] = "all"
    stats = _solve(data, counts, init, accuracy, max_collect)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        vals: list[float | None] = []
        for p in per_col[c]:
            if not counts[i]:
                vals.append(None)
                continue
            lo, hi, frac = _ranks(counts[i], p)
            a, b = stats[(i, lo)], stats[(i, hi)]
            vals.append(a + frac * (b - a))
        out[c] = vals
    return out


def order_statistic(df: DataFrame, col: str, rank: int, *, accuracy: int = 10000,
                    max_collect: int = 100000) -> float | None:
    """Value at 0-based ``rank`` of the non-NULL values of ``col`` (sorted ascending)."""
    data = df.select(F.col(col).cast("double").alias("_q0"))
    n = data.agg(F.count("_q0")).first()[0]
    if rank < 0 or rank >= n:
        return None
    br = None
    if n > max_collect:
        p = rank / max(1, n - 1)
        eps = 2.0 / accuracy
        ps = [max(0.0, p - eps), min(1.0, p + eps)]
        br = tuple(data.agg(F.percentile_approx("_q0", ps, accuracy)).first()[0])
    return _solve(data, [n], {(0, rank): br}, accuracy, max_collect)[(0, rank)]


def median(df: DataFrame, c: str) -> float | None:
    return exact_quantiles(df, [c], [0.5])[c][0]
