"""The data tables behind the exploratory plots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exact_quantiles

# Class names used by the reference for loan_status 0 / 1.
STATUS_NAMES = {0: "Good Loan", 1: "Bad Loan"}


def status_name(label: str = "loan_status"):
    return F.when(F.col(label) == 0, STATUS_NAMES[0]).when(F.col(label) == 1, STATUS_NAMES[1])


def corr_matrix(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """E1 Pearson correlation of every column pair, long form.

    The upper triangle is computed in one aggregate (pairwise NULL skipping,
    like pandas) and mirrored; the mirror is a row-level explode, not a join.
    """
    cols = list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}")
                    for k, (a, b) in enumerate(pairs)])
    entries = []
    for k, (a, b) in enumerate(pairs):
        entries.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"r{k}").alias("r")))
        if a != b:
            entries.append(F.struct(F.lit(b).alias("col_a"), F.lit(a).alias("col_b"), F.col(f"r{k}").alias("r")))
    return (wide.select(F.explode(F.array(*entries)).alias("e"))
            .select("e.col_a", "e.col_b", F.round("e.r", digits).alias("corr")))


def boxplot_stats(df: DataFrame, cols: Sequence[str], whis: float = 1.5, digits: int = 6) -> DataFrame:
    """E2 quartiles, fences, whisker ends (furthest points inside the fences) and
    the number of points outside, per column. Two passes: exact quartiles, then
    one aggregate with the fences as literals."""
    cols = list(cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    fences = {}
    for i, c in enumerate(cols):
        q1, q3 = q[c][0], q[c][2]
        if q1 is None:
            fences[c] = (None, None)
            aggs += [F.lit(None).alias(f"wl{i}"), F.lit(None).alias(f"wh{i}"),
                     F.lit(0).alias(f"o{i}"), F.count(c).alias(f"n{i}")]
            continue
        lo, hi = q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)
        fences[c] = (lo, hi)
        x = F.col(c).cast("double")
        inside = (x >= F.lit(lo)) & (x <= F.lit(hi))
        aggs += [F.min(F.when(inside, x)).alias(f"wl{i}"), F.max(F.when(inside, x)).alias(f"wh{i}"),
                 F.count_if(~inside).alias(f"o{i}"), F.count(c).alias(f"n{i}")]
    row = df.agg(*aggs).first()
    r = lambda v: None if v is None else round(float(v), digits)
    data = [(c, int(row[f"n{i}"]), r(q[c][0]), r(q[c][1]), r(q[c][2]), r(fences[c][0]), r(fences[c][1]),
             r(row[f"wl{i}"]), r(row[f"wh{i}"]), int(row[f"o{i}"] or 0)) for i, c in enumerate(cols)]
    schema = ("column_name string, n bigint, q1 double, median double, q3 double, lower_fence double, "
              "upper_fence double, whisker_low double, whisker_high double, n_outliers bigint")
    return df.sparkSession.createDataFrame(data, schema)


def class_counts(df: DataFrame, features: Sequence[str], label: str = "loan_status") -> DataFrame:
    """E3 count per (feature, value, class) for several features in one pass."""
    kv = F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features
    ])).alias("kv")
    return (df.select(kv, F.col(label)).select("kv.feature", "kv.value", label)
            .groupBy("feature", "value", label).count()
            .select("feature", "value", label, status_name(label).alias("status_name"), "count"))


def class_rate(df: DataFrame, feature: str, label: str = "loan_status", digits: int = 6) -> DataFrame:
    """E3 wide form: good / bad counts per value and the default rate."""
    wide = df.groupBy(feature).pivot(label, [0, 1]).count()
    good, bad = F.coalesce(F.col("0"), F.lit(0)), F.coalesce(F.col("1"), F.lit(0))
    return wide.select(feature, good.cast("bigint").alias("n_good"), bad.cast("bigint").alias("n_bad"),
                       (good + bad).cast("bigint").alias("n_total"),
                       F.round(bad / (good + bad), digits).alias("default_rate"))


def pair_bins(df: DataFrame, cols: Sequence[str], label: str = "loan_status", bins: int = 10) -> DataFrame:
    """E4 pair plot as data: 2-D binned counts per class for every column pair.

    Pass 1 finds min/max of every column in one aggregate; pass 2 bins with
    ``floor`` arithmetic, emits one row per pair and counts (partial aggregation
    keeps the shuffle at pairs x bins x classes per partition).
    """
    cols = list(cols)
    mm = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo{i}") for i, c in enumerate(cols)],
                *[F.max(F.col(c).cast("double")).alias(f"hi{i}") for i, c in enumerate(cols)]).first()

    def b(i, c):
        lo, hi = mm[f"lo{i}"], mm[f"hi{i}"]
        if lo is None:
            return F.lit(None).cast("int")
        if hi == lo:
            return F.when(F.col(c).isNotNull(), F.lit(0))
        raw = F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo) * bins).cast("int")
        # least() skips NULLs, so keep NULL inputs out of the last bin explicitly
        return F.when(F.col(c).isNotNull(), F.least(raw, F.lit(bins - 1)))

    binned = df.select(*[b(i, c).alias(f"b{i}") for i, c in enumerate(cols)], F.col(label))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    kv = F.explode(F.array(*[
        F.struct(F.lit(cols[i]).alias("col_x"), F.lit(cols[j]).alias("col_y"),
                 F.col(f"b{i}").alias("bin_x"), F.col(f"b{j}").alias("bin_y")) for i, j in pairs
    ])).alias("kv")
    return (binned.select(kv, label)
            .where(F.col("kv.bin_x").isNotNull() & F.col("kv.bin_y").isNotNull())
            .groupBy("kv.col_x", "kv.col_y", "kv.bin_x", "kv.bin_y", label).count())
