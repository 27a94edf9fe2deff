"""Deduplication, imputation, outlier and row filters, projections.

Imputers and the IQR filter follow fit/transform: ``fit_*`` runs one small
aggregate (a few scalars reach the driver), ``apply_*`` adds literal
expressions, so the transform is a narrow, codegen'd projection with no join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact_quantiles


#: Digests of repeated rows are broadcast up to this number (16 bytes each), and joined by a shuffle beyond it.
BROADCAST_DIGESTS = 1 << 18


def row_digest(cols: Sequence[str]) -> list[Column]:
    """128 bits of a row as two 64-bit hashes; which columns are null is hashed too, as a null leaves a hash as it was."""
    nulls = F.concat_ws("", *(F.col(c).isNull().cast("int").cast("string") for c in cols))
    return [F.xxhash64(F.lit(seed), *cols, nulls) for seed in (1, 2)]


def in_repeated(df: DataFrame, cols: Sequence[str], digest: Callable[[Sequence[str]], list[Column]] = row_digest) -> DataFrame | None:
    """``df`` with a flag ``_rep``: whether another row has this row's digest over ``cols``; None if no row has.

    Only digests are grouped, so a row's 16 bytes are shuffled and not the row. Equal rows have equal digests; rows that
    are flagged may still differ, and are compared by whoever asks.
    """
    hashed = [h.alias(f"_d{i}") for i, h in enumerate(digest(cols))]
    names = [f"_d{i}" for i in range(len(hashed))]
    groups = df.select(*hashed).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*names, F.lit(True).alias("_rep"))
    groups = materialize(groups, "repeated_digests")
    n = groups.count()
    if n == 0:
        return None
    marked = df.select("*", *hashed).join(F.broadcast(groups) if n <= BROADCAST_DIGESTS else groups, names, "left")
    return marked.drop(*names).withColumn("_rep", F.coalesce("_rep", F.lit(False)))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep_min: str | None = None,
                    digest: Callable[[Sequence[str]], list[Column]] = row_digest) -> DataFrame:
    """C1 drop duplicate rows (NULLs compare equal).

    With ``keep_min`` the surviving row of each duplicate group is the one with
    the smallest value of that key column (a deterministic "keep first").

    Rows whose digest no other row has stay where they are; only the others are shuffled and compared, column by column.
    """
    subset = list(subset or [c for c in df.columns if c != keep_min])
    marked = in_repeated(df, subset, digest)
    if marked is None:
        return df
    single, repeated = marked.where("NOT _rep").drop("_rep"), marked.where("_rep").drop("_rep")
    if keep_min is None:
        return single.unionByName(repeated.dropDuplicates(subset))
    others = [c for c in df.columns if c not in subset and c != keep_min]
    if not others:
        kept = repeated.groupBy(*subset).agg(F.min(keep_min).alias(keep_min))
    else:
        # carry the other columns of the smallest-key row (struct order: key first)
        first = F.min(F.struct(F.col(keep_min).alias(keep_min), *[F.col(c) for c in others])).alias("_first")
        kept = repeated.groupBy(*subset).agg(first).select(*subset, "_first.*")
    return single.unionByName(kept.select(*df.columns))


def fit_stats(df: DataFrame, means: Sequence[str] = (), quantiles: dict[str, Sequence[float]] | None = None
              ) -> tuple[dict[str, float | None], dict[str, list[float | None]]]:
    """Means and exact quantiles of several columns in one set of passes
    (the means ride on the quantile sketch's aggregate)."""
    quantiles = dict(quantiles or {})
    extra = [F.avg(F.col(c).cast("double")) for c in means]
    if not quantiles:
        row = df.agg(*[e.alias(f"m{i}") for i, e in enumerate(extra)]).first() if extra else None
        return {c: row[f"m{i}"] for i, c in enumerate(means)}, {}
    got: dict[int, float] = {}
    q = exact_quantiles(df, list(quantiles), quantiles, extra_aggs=extra, extra_out=got)
    return {c: got[i] for i, c in enumerate(means)}, q


def materialize(df: DataFrame, name: str = "materialized") -> DataFrame:
    """Cut the lineage before several fitting passes: write the table as
    parquet below the shared checkpoint folder and read it back (survives
    executor loss; columnar, so each later pass reads only its columns)."""
    from ..session import shared_path
    from ..sources.files import write_once
    return write_once(df, shared_path(df.sparkSession, "stages", name, unique=True))


def fit_mean(df: DataFrame, col: str) -> float | None:
    return df.agg(F.avg(F.col(col).cast("double"))).first()[0]


def fit_median(df: DataFrame, col: str) -> float | None:
    return exact_quantiles(df, [col], [0.5])[col][0]


def fill(df: DataFrame, col: str, value: float | None) -> DataFrame:
    if value is None:
        return df
    typ = df.schema[col].dataType
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(value).cast(typ)))


def impute_mean(df: DataFrame, col: str) -> DataFrame:
    """C2 fill NULL with the column mean."""
    return fill(df, col, fit_mean(df, col))


def impute_median(df: DataFrame, col: str) -> DataFrame:
    """C3 fill NULL with the exact column median."""
    return fill(df, col, fit_median(df, col))


def fit_iqr_bounds(df: DataFrame, col: str, whis: float = 1.5) -> tuple[float, float] | None:
    q1, q3 = exact_quantiles(df, [col], [0.25, 0.75])[col]
    if q1 is None:
        return None
    return q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)


def iqr_filter(df: DataFrame, col: str, whis: float = 1.5) -> DataFrame:
    """C4 keep rows with Q1 - 1.5 IQR <= x <= Q3 + 1.5 IQR (NULL rows drop)."""
    bounds = fit_iqr_bounds(df, col, whis)
    if bounds is None:
        return df.where(F.lit(False))
    lo, hi = bounds
    return df.where(F.col(col).between(F.lit(lo), F.lit(hi)))


def age_filter(df: DataFrame, col: str = "person_age", limit: int = 100) -> DataFrame:
    """C5 keep rows with age strictly below the limit (the code's rule: 100 drops)."""
    return df.where(F.col(col) < limit)


def nonzero(df: DataFrame, col: str) -> DataFrame:
    """C6 ``query('col > 0')`` on a report."""
    return df.where(F.col(col) > 0)


def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C7 column projection (pruned down to the scan by Catalyst)."""
    return df.select(*cols)


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """C7 column drop."""
    return df.drop(*cols)


def sort_report(df: DataFrame, by: str, tie: str | None = None) -> DataFrame:
    """C8 report sort: one count descending, name ascending to break ties."""
    return df.orderBy(F.desc(by), *([tie] if tie else []))
