"""Small column-expression builders shared by the operators."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(num: str | Column, den: str | Column) -> Column:
    """Division that yields NULL for a zero denominator (plain ``/`` raises under ANSI)."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def right_closed_bins(c: str | Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Discretise with right-closed intervals (e0, e1], (e1, e2], ...

    Values outside every interval, and NULL, give NULL. ``math.inf`` as the
    last edge makes the last interval open-ended.
    """
    if len(edges) != len(labels) + 1:
        raise ValueError("need len(edges) == len(labels) + 1")
    x = col(c)
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = x > F.lit(lo)
        if not (isinstance(hi, float) and math.isinf(hi)):
            cond = cond & (x <= F.lit(hi))
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def right_closed_bins_sql(c: str, edges: Sequence[float], labels: Sequence[str]) -> str:
    parts = []
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        cond = f"{c} > {lo}"
        if not (isinstance(hi, float) and math.isinf(hi)):
            cond += f" AND {c} <= {hi}"
        parts.append(f"WHEN {cond} THEN '{label}'")
    return "CASE " + " ".join(parts) + " END"


def rnd(c: str | Column, digits: int = 6) -> Column:
    return F.round(col(c).cast("double"), digits)
