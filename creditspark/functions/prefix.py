"""Ordered running sums without a single-partition window.

A global ``sum() over (order by x)`` moves every row to one task. Here rows
are cut into value ranges (bounds from ``percentile_approx``, so the bucket
of a row is a pure function of its value and survives task re-runs); each
range gets its own window, and the totals of the ranges before it are added
as literals (one small row per range is collected).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_parallelism, shared_path


def cumulative_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str], *,
                    ascending: bool = True, n_buckets: int | None = None,
                    prefix: str = "cum_", following: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<c>``: sum of ``c`` over all rows up to and including this one.

    ``order_col`` must be unique per row (group by it first). For each column c of ``following`` also ``next_<c>``, its value in the
    next row (null in the last one), and ``is_first``: a range's last row gets the first row of the next range that has rows.
    """
    p = max(1, n_buckets or default_parallelism(df.sparkSession))
    v = F.col(order_col)
    bounds: list = []
    if p > 1:
        probs = [k / p for k in range(1, p)]
        got = df.agg(F.percentile_approx(order_col, probs, 10000)).first()[0] or []
        bounds = sorted({b for b in got if b is not None})
    nb = len(bounds) + 1
    if bounds:
        asc_bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < v))
    else:
        asc_bucket = F.lit(0)
    bucket = asc_bucket if ascending else (F.lit(nb - 1) - asc_bucket)
    keyed = df.withColumn("_bucket", bucket)
    edge = F.min_by if ascending else F.max_by
    first = [edge(c, v).alias(f"_first_{c}") for c in following]
    totals = {r["_bucket"]: r for r in
              keyed.groupBy("_bucket").agg(*[F.sum(c).alias(c) for c in sum_cols], *first).collect()}
    offsets = {c: [] for c in sum_cols}
    running = {c: 0 for c in sum_cols}
    for b in range(nb):
        for c in sum_cols:
            offsets[c].append(running[c])
            if b in totals and totals[b][c] is not None:
                running[c] += totals[b][c]
    order = Window.partitionBy("_bucket").orderBy(v.asc() if ascending else v.desc())
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed
    for c in sum_cols:
        off = F.element_at(F.array(*[F.lit(x) for x in offsets[c]]), F.col("_bucket") + 1)
        out = out.withColumn(f"{prefix}{c}", F.sum(c).over(w) + off)
    for c in following:
        carried, ahead = [], None
        for b in reversed(range(nb)):
            carried.append(F.lit(ahead).cast(df.schema[c].dataType))
            ahead = totals[b][f"_first_{c}"] if b in totals else ahead
        out = out.withColumn(f"next_{c}", F.coalesce(F.lead(c).over(order), F.element_at(F.array(*carried[::-1]), F.col("_bucket") + 1)))
    if following:
        out = out.withColumn("is_first", (F.row_number().over(order) == 1) & (F.col("_bucket") == min(totals, default=0)))
    return out.drop("_bucket")


def positions(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """Add the 0-based position of every row in the order of ``order`` (unique per row).

    One global range sort; a row's number in its partition plus the sizes of the
    partitions before it (one small row each) is its position, so no task sees all rows. The sorted
    rows are written to the run folder once, which fixes the partitions.
    """
    spark = df.sparkSession
    path = shared_path(spark, "stages", "positions", unique=True)
    df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).write.parquet(path)
    at = spark.read.parquet(path)
    part = F.shiftright("_m", 33)
    start, total = [], 0
    for r in sorted(at.groupBy(part.alias("part")).count().collect()):
        start += [F.lit(r["part"]), F.lit(total).cast("bigint")]
        total += r["count"]
    if not start:
        return at.withColumn(out, F.col("_m")).drop("_m")
    return at.withColumn(out, F.create_map(*start)[part] + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m")
