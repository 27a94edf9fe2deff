"""Integer-arithmetic hashing that gives the same numbers in Spark and in SQL.

Used wherever randomness must be reproducible after a task is re-run on
another executor and checkable by the SQL oracle: train/test split, SMOTE
base-row allocation, neighbour choice and interpolation weight. Every
intermediate stays below 2**63, so ANSI mode never sees an overflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647  # 2**31 - 1


def mix(x: Column, seed: int) -> Column:
    """Hash a non-negative BIGINT column to [0, MODULUS)."""
    a = F.pmod(x.cast("bigint") + F.lit(seed * 7919), F.lit(MODULUS))
    b = F.pmod(a * 48271 + 11, F.lit(MODULUS))
    c = F.pmod(b * b + 7, F.lit(MODULUS))
    return F.pmod(c * 69621 + 3, F.lit(MODULUS))


def mix2(x: Column, y: Column, seed: int) -> Column:
    """Hash of a pair of non-negative BIGINTs."""
    return mix(mix(x, seed) + y.cast("bigint"), seed + 1)


def unit(h: Column) -> Column:
    """Hash value to a double in [0, 1)."""
    return h.cast("double") / float(MODULUS)


def mix_sql(x: str, seed: int) -> str:
    """SQL text of :func:`mix` (operands are non-negative, so % equals pmod)."""
    m = MODULUS
    a = f"((CAST({x} AS BIGINT) + {seed * 7919}) % {m})"
    b = f"(({a} * 48271 + 11) % {m})"
    c = f"(({b} * {b} + 7) % {m})"
    return f"(({c} * 69621 + 3) % {m})"


def mix2_sql(x: str, y: str, seed: int) -> str:
    return mix_sql(f"({mix_sql(x, seed)} + CAST({y} AS BIGINT))", seed + 1)


def unit_sql(h: str) -> str:
    return f"(CAST({h} AS DOUBLE) / {float(MODULUS)})"
