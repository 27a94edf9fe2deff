"""Table profiling reports.

Every report is one or two aggregate passes over the table; statistics of all
columns are fused into the same ``agg`` so the table is scanned once per pass.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exact_quantiles
from .clean import in_repeated, materialize, row_digest

INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def preview(df: DataFrame, n: int = 5, order_by: Sequence[str] | str = ("loan_id",)) -> DataFrame:
    """P1 ``head(n)`` with the order made explicit (runs as a top-k, not a sort)."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*order).limit(n)


def shape(df: DataFrame) -> DataFrame:
    """P2 row and column counts."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_cols"))


def type_split(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """P3 numeric / categorical split of the columns, with the non-null values that each side holds."""
    groups = {"numeric": numeric_columns(df, exclude), "categorical": categorical_columns(df, exclude)}
    held = df.agg(*[sum((F.count(c) for c in cols), F.lit(0)).cast("bigint").alias(kind) for kind, cols in groups.items()])
    rows = [F.struct(F.lit(kind).alias("column_type"), F.lit(len(cols)).cast("bigint").alias("n_columns"),
                     F.lit(",".join(cols)).alias("column_names"), F.col(kind).alias("n_values")) for kind, cols in groups.items()]
    return held.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _long(df: DataFrame, exprs: dict[str, object], value_name: str) -> DataFrame:
    """One aggregate row with one value per column, turned to long form.

    The row count of the table rides along as ``n_total`` on every output row.
    """
    wide = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs.values())],
                  F.count(F.lit(1)).alias("n_total"))
    names = list(exprs)
    stack = ", ".join(f"{i}, '{n}', c{i}, n_total" for i, n in enumerate(names))
    return wide.selectExpr(
        f"stack({len(names)}, {stack}) AS (position, column_name, {value_name}, n_total)")


def info_report(df: DataFrame) -> DataFrame:
    """P4 ``info()``: position, name, type and non-null count per column."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = _long(df, {c: F.count(c) for c in df.columns}, "non_null")
    type_map = F.create_map(*[x for n, t in types.items() for x in (F.lit(n), F.lit(t))])
    return out.select(F.col("position").cast("int").alias("position"), "column_name",
                      type_map[F.col("column_name")].alias("dtype"), "non_null")


def null_report(df: DataFrame, nonzero_only: bool = False) -> DataFrame:
    """P5 missing count and percent of rows (4 dp) per column, count descending."""
    exprs = {c: F.count_if(F.col(c).isNull()) for c in df.columns}
    out = _long(df, exprs, "missing_values").select(
        "column_name", "missing_values",
        F.round(F.col("missing_values") * 100.0 / F.col("n_total"), 4).alias("missing_pct"))
    if nonzero_only:
        out = out.where("missing_values > 0")
    return out.orderBy(F.desc("missing_values"), "column_name")


#: values of a bitmap of ``bitmap_construct_agg``, its bytes, and the bytes that a value costs in a hash aggregate
BITMAP_VALUES, BITMAP_BYTES, VALUE_BYTES = 32768, 4096, 32


def dense_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Integer columns whose values lie so close that bitmaps over their range are smaller than their distinct values."""
    whole = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, INTEGER)]
    if not whole:
        return []
    row = df.agg(*(x.alias(f"{n}{i}") for i, c in enumerate(whole) for n, x in (
        ("lo", F.min(c).cast("long")), ("hi", F.max(c).cast("long")), ("n", F.approx_count_distinct(c))))).first()
    bitmaps = lambda i: (row[f"hi{i}"] - row[f"lo{i}"]) // BITMAP_VALUES + 2
    return [c for i, c in enumerate(whole) if row[f"n{i}"] and bitmaps(i) * BITMAP_BYTES <= max(row[f"n{i}"] * VALUE_BYTES, 16 * BITMAP_BYTES)]


def bitmap_distinct(df: DataFrame, col: str) -> DataFrame:
    """(column_name, unique_values): exact number of distinct non-null integers, by one bitmap per range of 32,768 values.

    Tasks set bits before the shuffle, which moves bitmaps and no values; a frequent value is one bit like any other.
    """
    v = F.col(col).cast("long")
    maps = df.where(F.col(col).isNotNull()).groupBy(F.bitmap_bucket_number(v).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("bits"))
    return maps.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("unique_values")).select(F.lit(col).alias("column_name"), "unique_values")


def distinct_report(df: DataFrame, exclude: Sequence[str] = (), approx: bool = False,
                    rsd: float = 0.01) -> DataFrame:
    """P6 distinct non-null values and percent of rows (4 dp), numeric and categorical.

    Integer columns with values close to each other are counted by bitmaps, each in a scan of that one column; the others
    share one aggregate. The columns are written once for it, and read one by one.
    ``approx`` switches to HyperLogLog++ (fixed memory per column) for very wide
    or very large tables.
    """
    cols = [c for c in df.columns if c not in exclude]
    num = set(numeric_columns(df))
    kind = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit("numeric" if c in num else "categorical"))])
    if approx:
        counts = _long(df, {c: F.approx_count_distinct(c, rsd) for c in cols}, "unique_values").select("column_name", "unique_values", "n_total")
    else:
        rows = materialize(df.select(*cols), "distinct_columns")
        dense = dense_columns(rows, cols)
        counts = _long(rows, {c: F.count_distinct(c) for c in cols if c not in dense}, "unique_values").select("column_name", "unique_values", "n_total") if set(cols) - set(dense) else None
        if dense:
            n_total = rows.count()
            parts = [bitmap_distinct(rows, c).withColumn("n_total", F.lit(n_total).cast("bigint")) for c in dense]
            counts = functools.reduce(DataFrame.unionByName, parts if counts is None else [counts, *parts])
    out = counts.select(
        "column_name", kind[F.col("column_name")].alias("column_type"), "unique_values",
        F.round(F.try_divide(F.col("unique_values") * 100.0, F.col("n_total")), 4).alias("unique_pct"))
    return out.orderBy("column_type", F.desc("unique_values"), "column_name")


def duplicate_count(df: DataFrame, cols: Sequence[str] | None = None,
                    digest: Callable[[Sequence[str]], list[Column]] = row_digest) -> DataFrame:
    """P7 rows minus distinct rows (NULLs compare equal, as pandas does). Only rows whose digest occurs twice are compared."""
    cols = list(cols or df.columns)
    marked = in_repeated(df.select(*cols), cols, digest)
    if marked is None:
        return df.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("duplicates"))
    return (marked.where("_rep").groupBy(*cols).count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("duplicates")))


def numeric_describe(df: DataFrame, cols: Sequence[str] | None = None, digits: int = 6) -> DataFrame:
    """P8 count, mean, sample std, min, exact 25/50/75 %, max per numeric column."""
    cols = list(cols or numeric_columns(df))
    aggs, names = [], []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count(c), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)]
        names += [f"n{i}", f"m{i}", f"s{i}", f"lo{i}", f"hi{i}"]
    got: dict[int, object] = {}
    # moments ride on the first quantile pass: two scans in total
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], extra_aggs=aggs, extra_out=got)
    row = {n: got[j] for j, n in enumerate(names)}
    r = lambda v: None if v is None else round(float(v), digits)
    data = [(c, int(row[f"n{i}"]), r(row[f"m{i}"]), r(row[f"s{i}"]), r(row[f"lo{i}"]),
             r(q[c][0]), r(q[c][1]), r(q[c][2]), r(row[f"hi{i}"])) for i, c in enumerate(cols)]
    schema = ("column_name string, count bigint, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")
    return df.sparkSession.createDataFrame(data, schema)


def _unpivot_strings(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols
    ])).alias("kv")).select("kv.column_name", "kv.value")


def categorical_describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P9 count, unique, top (ties: smallest value), freq per categorical column.

    All columns go through one grouped count keyed on (column, value): the
    partial aggregate collapses repeats before the shuffle, and the most
    frequent value is found with ``min(struct(-count, value))`` instead of a
    whole-column frequency map in one task.
    """
    cols = list(cols or categorical_columns(df))
    counts = (_unpivot_strings(df, cols).where(F.col("value").isNotNull())
              .groupBy("column_name", "value").count())
    best = F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v")))
    return (counts.groupBy("column_name")
            .agg(F.sum("count").cast("bigint").alias("count"), F.count("value").alias("unique"),
                 best.alias("b"))
            .select("column_name", "count", "unique", F.col("b.v").alias("top"),
                    (-F.col("b.nc")).cast("bigint").alias("freq")))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """P10 counts of one column, count descending (NULL dropped like pandas)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).count()
            .orderBy(F.desc("count"), col))


def column_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P11 maximum of each column (one row)."""
    return df.agg(*[F.max(c).alias(f"max_{c}") for c in cols])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """P11 distinct values of a column."""
    return df.select(col).distinct()


def row_audit(stages: dict[str, DataFrame], step: str) -> DataFrame:
    """P12 row and column counts before/after a cleaning step, one table."""
    parts = [d.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(step).alias("step"), F.lit(name).alias("stage"), "n_rows",
                     F.lit(len(d.columns)).alias("n_cols"))
             for name, d in stages.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def filter_audit(df: DataFrame, kept, step: str) -> DataFrame:
    """P12 for a row filter: rows before and after from one pass (``kept``: the filter's condition)."""
    one = df.agg(F.count(F.lit(1)).alias("before"), F.count_if(kept).alias("after"))
    stage = lambda name: F.struct(F.lit(step).alias("step"), F.lit(name).alias("stage"), F.col(name).alias("n_rows"), F.lit(len(df.columns)).alias("n_cols"))
    return one.select(F.explode(F.array(stage("before"), stage("after"))).alias("s")).select("s.*")
