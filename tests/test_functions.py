import math

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from creditspark.functions import (cumulative_sums, exact_quantiles, mix, mix2, mix2_sql, mix_sql,
                                   right_closed_bins, safe_div)
from creditspark.functions.prefix import positions
from creditspark.functions.quantiles import order_statistic
from creditspark.operators.features import INCOME_EDGES, INCOME_LABELS


def test_hash_matches_sql(spark):
    keys = [0, 1, 2, 17, 123456789, 6_000_000_000]
    got = spark.createDataFrame([(k, c) for k in keys for c in (1, 3)], "k long, c long") \
        .select("k", "c", mix(F.col("k"), 42).alias("h"), mix2(F.col("k"), F.col("c"), 43).alias("h2")).collect()
    con = duckdb.connect()
    for r in got:
        h = con.execute(f"SELECT {mix_sql(str(r['k']), 42)}, {mix2_sql(str(r['k']), str(r['c']), 43)}").fetchone()
        assert (r["h"], r["h2"]) == h


def test_quartiles_fixture(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 4, 7, 11, 16]], "x double")
    assert exact_quantiles(df, ["x"], [0.25, 0.5, 0.75])["x"] == [2.5, 5.5, 10.0]


def test_quantiles_match_numpy_with_narrowing(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=20000).round(4), np.full(15000, 2.5), [np.nan] * 10])
    pdf = pd.DataFrame({"x": vals})
    df = spark.createDataFrame(pdf).select(F.when(~F.isnan("x"), F.col("x")).alias("x"))
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    want = np.nanquantile(vals, probs)
    for max_collect in (100000, 500):
        got = exact_quantiles(df, ["x"], probs, accuracy=1000, max_collect=max_collect)["x"]
        assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_order_statistic(spark):
    df = spark.createDataFrame([(None if v is None else float(v),) for v in [5, 3, 3, 9, 1, None]], "x double")
    assert [order_statistic(df, "x", r) for r in range(5)] == [1.0, 3.0, 3.0, 5.0, 9.0]
    assert order_statistic(df, "x", 5) is None


def test_all_null_quantile(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_cumulative_sums_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"s": np.arange(500, dtype=float), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    for asc in (True, False):
        got = cumulative_sums(df, "s", ["v"], ascending=asc, n_buckets=7).toPandas().sort_values("s", ascending=asc)
        want = pdf.sort_values("s", ascending=asc)["v"].cumsum().to_numpy()
        assert (got["cum_v"].to_numpy() == want).all()


def test_income_bins_fixture(spark):
    vals = [-1.0, 0.0, 0.01, 25000.0, 25000.01, 100000.0, 100000.01, None]
    want = [None, None, "low", "low", "low-middle", "high-middle", "high", None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, x double")
    got = [r["g"] for r in df.select("i", right_closed_bins("x", INCOME_EDGES, INCOME_LABELS).alias("g"))
           .orderBy("i").collect()]
    assert got == want
    assert math.isinf(INCOME_EDGES[-1])


def test_safe_div_zero_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 4.0), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(safe_div("a", "b")).collect()] == [None, 0.25, None]


def test_quantiles_few_distinct_large_n(spark):
    # n above max_collect with few distinct values: grouped values are collected whole
    df = spark.range(5000).select((F.col("id") % 37).cast("double").alias("x"))
    pdf = df.toPandas()
    got = exact_quantiles(df, ["x"], [0.1, 0.5, 0.9], max_collect=1000)["x"]
    assert np.allclose(got, np.quantile(pdf.x, [0.1, 0.5, 0.9]))


def test_quantiles_extra_aggs_fused(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "x double")
    extra = {}
    q = exact_quantiles(df, ["x"], {"x": [0.5]}, extra_aggs=[F.avg("x"), F.max("x")], extra_out=extra)
    assert q["x"] == [2.5] and extra == {0: 2.5, 1: 4.0}


def test_quantile_collect_stays_bounded(spark, monkeypatch):
    # two hot values around a wide continuous middle: their rows must not keep the bracket wide
    rng = np.random.default_rng(8)
    vals = np.concatenate([np.full(9000, 1.0), rng.uniform(1, 2, 2000), np.full(9000, 2.0)])
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    sizes, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (lambda rows: (sizes.append(len(rows)), rows)[1])(collect(self)))
    probs = [0.2, 0.46, 0.5, 0.53, 0.8]
    got = exact_quantiles(df, ["x"], probs, accuracy=100, max_collect=60)["x"]
    assert np.allclose(got, np.quantile(vals, probs), rtol=0, atol=1e-12)
    assert max(sizes) <= 60 * 2 * len(probs)


def test_positions_over_partitions(spark):
    rows = [(i * 7919 % 1000 // 3, i) for i in range(1000)]
    got = positions(spark.createDataFrame(rows, "a long, b long").repartition(5), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["position"])] == sorted(rows)
    assert sorted(r["position"] for r in got) == list(range(1000))
    assert positions(spark.createDataFrame([], "a long"), ["a"]).count() == 0
