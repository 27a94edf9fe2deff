import pytest
from pyspark.sql import functions as F

from creditspark.operators import clean as C
from creditspark.operators import profile as P


def _df(spark):
    rows = [(1, 30, "RENT", 1.0), (2, 30, "RENT", 1.0), (3, None, "OWN", None), (4, 101, None, 4.0),
            (5, 100, "OWN", 2.0), (6, None, "OWN", None)]
    return spark.createDataFrame(rows, "id long, age int, home string, x double")


def test_null_report(spark):
    rep = {r["column_name"]: (r["missing_values"], r["missing_pct"]) for r in P.null_report(_df(spark)).collect()}
    assert rep["age"] == (2, round(200 / 6, 4)) and rep["id"] == (0, 0.0)
    assert {r["column_name"] for r in P.null_report(_df(spark), nonzero_only=True).collect()} == {"age", "home", "x"}


def test_distinct_report_skips_null(spark):
    rep = {r["column_name"]: r["unique_values"] for r in P.distinct_report(_df(spark), exclude=["id"]).collect()}
    assert rep == {"age": 3, "home": 2, "x": 3}


def test_duplicates_nulls_equal(spark):
    df = _df(spark).drop("id")
    assert P.duplicate_count(df).first()[0] == 2
    assert C.drop_duplicates(df).count() == 4


def test_distinct_by_bitmaps_is_exact(spark):
    values = [0, -1, 1, 32767, 32768, 32769, -32768, -32769, 5, 5, None, 100_000]
    rows = [(v, None if v is None else v * 10**12, i % 3, None) for i, v in enumerate(values * 3)]
    df = spark.createDataFrame(rows, "near int, far long, few short, none long")
    assert P.dense_columns(df, df.columns) == ["near", "few"]
    for c, n in (("near", 10), ("few", 3), ("none", 0), ("far", 10)):  # right for any column, small for dense ones
        assert P.bitmap_distinct(df, c).first()[1] == n
    rep = {r["column_name"]: (r["column_type"], r["unique_values"]) for r in P.distinct_report(df).collect()}
    assert rep == {"near": ("numeric", 10), "far": ("numeric", 10), "few": ("numeric", 3), "none": ("numeric", 0)}
    only = P.distinct_report(df.select("near", "few"))
    assert "Expand" not in only._jdf.queryExecution().optimizedPlan().toString() and only.count() == 2


@pytest.mark.parametrize("digest", [C.row_digest, lambda cols: [F.lit(1), F.lit(2)], lambda cols: [F.xxhash64(cols[0]), F.lit(2)]])
@pytest.mark.parametrize("limit", [1 << 18, 0])
def test_duplicates_by_digest_are_exact(spark, digest, limit, monkeypatch):
    """Whatever rows share a digest (all of them, in the second case), and whether digests are broadcast or shuffled."""
    monkeypatch.setattr(C, "BROADCAST_DIGESTS", limit)
    rows = [(i, i % 7 if i % 5 else None, None if i % 3 else "x", [0.0, -0.0, float("nan"), None][i % 4]) for i in range(90)] + [(100, None, "1", 1.5), (101, 1, None, 1.5)]
    df = spark.createDataFrame(rows, "id long, a int, b string, c double")
    bare = df.drop("id")
    plain = bare.dropDuplicates()
    as_text = lambda d: sorted(str(tuple(r)).replace("-0.0", "0.0") for r in d.collect())
    assert as_text(C.drop_duplicates(bare, digest=digest)) == as_text(plain)
    assert P.duplicate_count(bare, digest=digest).first()[0] == len(rows) - plain.count()
    first = df.groupBy("a", "b", "c").agg(F.min("id").alias("id"))
    assert as_text(C.drop_duplicates(df, ["a", "b", "c"], "id", digest).select("id")) == as_text(first.select("id"))


def test_no_repeated_digest_moves_no_row(spark):
    df = spark.range(1000).selectExpr("id", "id * 3 AS x", "cast(id AS string) AS s")
    assert P.duplicate_count(df).first()[0] == 0
    out = C.drop_duplicates(df, ["x", "s"], "id")
    assert out.count() == 1000 and "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    # one repeated row: its digest is broadcast, the other rows stay where they are
    more = df.unionByName(df.limit(1))
    plan = C.drop_duplicates(more, ["id", "x", "s"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftOuter" in plan and "broadcast" in plan


def test_drop_duplicates_keep_min(spark):
    out = C.drop_duplicates(_df(spark), subset=["age", "home", "x"], keep_min="id").orderBy("id").collect()
    assert [r["id"] for r in out] == [1, 3, 4, 5]


def test_describe_and_std(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "x double")
    r = P.numeric_describe(df, ["x"]).first()
    assert (r["count"], r["mean"], r["std"], r["q25"], r["q50"], r["q75"]) == (4, 2.5, 1.290994, 1.75, 2.5, 3.25)


def test_categorical_describe_tie_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "v string")
    r = P.categorical_describe(df, ["v"]).first()
    assert (r["count"], r["unique"], r["top"], r["freq"]) == (5, 3, "a", 2)


def test_value_counts_drops_null(spark):
    got = [(r["home"], r["count"]) for r in P.value_counts(_df(spark), "home").collect()]
    assert got == [("OWN", 3), ("RENT", 2)]


def test_impute_and_filters(spark):
    df = _df(spark)
    m = C.impute_mean(df, "x").where("id = 3").first()["x"]
    assert m == 2.0
    med = C.impute_median(df, "x").where("id = 6").first()["x"]
    assert med == 1.5
    assert sorted(r["id"] for r in C.age_filter(df, "age").collect()) == [1, 2]   # 100 drops, NULL drops
    kept = C.iqr_filter(df, "x").collect()
    assert all(r["x"] is not None for r in kept) and len(kept) == 4


def test_row_audit(spark):
    df = _df(spark)
    rows = {r["stage"]: r["n_rows"] for r in P.row_audit({"before": df, "after": C.age_filter(df, "age")}, "age").collect()}
    assert rows == {"before": 6, "after": 2}


def test_info_report_types(spark):
    rep = {r["column_name"]: (r["dtype"], r["non_null"]) for r in P.info_report(_df(spark)).collect()}
    assert rep["age"] == ("int", 4) and rep["home"] == ("string", 5)


def test_type_split(spark):
    rows = {r["column_type"]: r["n_columns"] for r in P.type_split(_df(spark), exclude=["id"]).collect()}
    assert rows == {"numeric": 2, "categorical": 1}


def test_column_max(spark):
    assert P.column_max(_df(spark), ["age"]).first()[0] == 101


def test_drop_duplicates_keep_min_carries_other_columns(spark):
    df = spark.createDataFrame([(2, "a", "late"), (1, "a", "early"), (3, "b", "only")], "id long, k string, note string")
    out = {r["k"]: (r["id"], r["note"]) for r in C.drop_duplicates(df, subset=["k"], keep_min="id").collect()}
    assert out == {"a": (1, "early"), "b": (3, "only")}


def test_csv_scan_nan_and_empty_to_null(spark, tmp_path):
    from creditspark.sources.files import RAW_SCHEMA, read_loan_csv
    header = ",".join(f.name for f in RAW_SCHEMA.fields)
    body = ["22,59000,RENT,123.0,PERSONAL,D,35000,16.02,1,0.59,Y,3",
            "21,9600,OWN,NaN,EDUCATION,B,1000,,0,0.1,N,2"]
    path = tmp_path / "loans.csv"
    path.write_text("\n".join([header, *body]) + "\n")
    rows = read_loan_csv(spark, str(path)).orderBy("person_age").collect()
    assert rows[0]["person_emp_length"] is None and rows[0]["loan_int_rate"] is None
    assert rows[1]["loan_int_rate"] == 16.02 and rows[1]["loan_status"] == 1
