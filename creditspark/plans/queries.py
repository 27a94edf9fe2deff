"""Registered queries: one per operator of the inventory, each ``(spark, sf_dir)
-> DataFrame`` over the whole driver tables, plus the DuckDB SQL twin where
the result is SQL-expressible. Doubles are rounded to 6 decimals on both
sides; every computed column carries the same alias on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import mix
from ..functions.expr import rnd
from ..operators import clean as C
from ..operators import evaluate as V
from ..operators import explore as E
from ..operators import features as Fe
from ..operators import profile as P
from ..operators import sampling as R
from ..session import shared_path
from ..sources import KEY, LABEL, RAW_COLUMNS, loan_book, read_table
from ..sources.files import KEYED_SCHEMA, read_loan_csv, write_loan_csv, write_stage
from . import prepare as PR
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
D = 6  # rounding digits for doubles in query outputs


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


# ---- shared Spark stages ------------------------------------------------------
def imputed(spark: SparkSession, sf: str) -> DataFrame:
    return PR.impute_loans(loan_book(spark, sf))[0]


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return PR.clean_loans(loan_book(spark, sf))


def engineered(spark: SparkSession, sf: str) -> DataFrame:
    return PR.engineer(cleaned(spark, sf))[0]


def scaled(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    eng = engineered(spark, sf)
    feats = PR.feature_columns(eng)
    return PR.scaled_features(eng, feats)[0], feats


def evals(spark: SparkSession, sf: str) -> DataFrame:
    """Deterministic classifier output: label, score (3 dp, floored), prediction."""
    lb = loan_book(spark, sf)
    amt, inc = F.col("loan_amnt").cast("double"), F.col("person_income").cast("double")
    r = amt / (amt + 0.5 * F.abs(inc) + 1.0)
    noise = F.pmod(mix(F.col(KEY), 7), F.lit(1000)).cast("double") / 1000.0
    score = F.floor(1000.0 * (0.8 * r + 0.2 * noise)) / 1000.0
    out = lb.select(KEY, F.col(LABEL).alias("label"), "loan_grade", score.alias("score"))
    return out.withColumn("prediction", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def cluster_points(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[int, list[float]]]:
    """Scaled clustering features of ``cleaned`` and nearest-centroid clusters,
    centroids = mean point of each home-ownership group (k = 4, fixed by data)."""
    cl = cleaned(spark, sf)
    feats = Fe.CLUSTER_FEATURES
    sc = Fe.fit_scaler(cl, feats)
    owners = S.CATEGORIES["person_home_ownership"]
    grp = F.array_position(F.array(*[F.lit(v) for v in owners]), F.col("person_home_ownership")) - 1
    pts = sc.transform(cl.select(KEY, "person_home_ownership", *feats), fill_null=0.0).select(
        KEY, grp.cast("int").alias("grp"), *feats)
    cents = {r["grp"]: [r[f] for f in feats]
             for r in pts.groupBy("grp").agg(*[F.avg(f).alias(f) for f in feats]).collect()}
    return V.assign_nearest(pts, feats, cents), cents


def _round_all(df: DataFrame, digits: int = D) -> DataFrame:
    from pyspark.sql.types import DoubleType, FloatType
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def _r(c: str) -> str:
    return f"ROUND({c}, {D}) AS {S.q(c)}"


# ---- 1. minimum slice -----------------------------------------------------------
@register("default_rate_by_income_group", f"""
WITH {S.imputed_cte()},
g AS (SELECT {S.bins_sql()[0]}, loan_status FROM imputed)
SELECT income_group,
  CAST(SUM(CASE WHEN loan_status = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_good,
  CAST(SUM(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_bad,
  CAST(COUNT(*) AS BIGINT) AS n_total,
  ROUND(SUM(CASE WHEN loan_status = 1 THEN 1 ELSE 0 END) / CAST(COUNT(*) AS DOUBLE), 6) AS default_rate
FROM g GROUP BY income_group""")
def q_default_rate_by_income_group(spark, sf):
    # imputation touches neither column, so its passes are left out
    df = Fe.discretize(PR.deduplicated(loan_book(spark, sf)), drop_source=False)
    return E.class_rate(df, "income_group")


# ---- 2. profiling ---------------------------------------------------------------
@register("preview", f"WITH {S.loan_book_cte()} SELECT * FROM loan_book ORDER BY loan_id LIMIT 5")
def q_preview(spark, sf):
    return P.preview(loan_book(spark, sf), 5, KEY)


@register("shape", f"WITH {S.loan_book_cte()} SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, 13 AS n_cols FROM loan_book")
def q_shape(spark, sf):
    return P.shape(loan_book(spark, sf))


def _values_sql(cols) -> str:
    return f"CAST({' + '.join(f'COUNT({c})' for c in cols)} AS BIGINT)"


@register("type_split", f"""
WITH {S.loan_book_cte()}
SELECT 'numeric' AS column_type, CAST({len(S.NUMERIC_RAW)} AS BIGINT) AS n_columns, '{",".join(S.NUMERIC_RAW)}' AS column_names,
  {_values_sql(S.NUMERIC_RAW)} AS n_values FROM loan_book
UNION ALL SELECT 'categorical', CAST({len(S.CATEGORICAL_RAW)} AS BIGINT), '{",".join(S.CATEGORICAL_RAW)}', {_values_sql(S.CATEGORICAL_RAW)} FROM loan_book""")
def q_type_split(spark, sf):
    return P.type_split(loan_book(spark, sf), exclude=[KEY])


@register("info_report", f"WITH {S.loan_book_cte()} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS column_name, '{S.DTYPES[c]}' AS dtype, "
    f"CAST(COUNT({c}) AS BIGINT) AS non_null FROM loan_book" for i, c in enumerate(S.LOAN_COLUMNS)))
def q_info_report(spark, sf):
    return P.info_report(loan_book(spark, sf))


@register("null_report", f"WITH {S.loan_book_cte()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing_values, "
    f"ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 4) AS missing_pct FROM loan_book"
    for c in S.LOAN_COLUMNS))
def q_null_report(spark, sf):
    return P.null_report(loan_book(spark, sf))


@register("null_report_nonzero", f"WITH {S.loan_book_cte()} SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing_values, "
    f"ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 4) AS missing_pct FROM loan_book"
    for c in S.LOAN_COLUMNS) + ") WHERE missing_values > 0")
def q_null_report_nonzero(spark, sf):
    return P.null_report(loan_book(spark, sf), nonzero_only=True)


@register("report_order", f"""
WITH {S.loan_book_cte()}, r AS ({" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing_values FROM loan_book" for c in S.LOAN_COLUMNS)})
SELECT CAST(ROW_NUMBER() OVER (ORDER BY missing_values DESC, column_name) AS BIGINT) AS place, column_name, missing_values FROM r""")
def q_report_order(spark, sf):
    """The order in which the null report's rows come."""
    report = C.sort_report(P.null_report(loan_book(spark, sf)).select("column_name", "missing_values"), "missing_values", "column_name")
    at = Window.orderBy(F.monotonically_increasing_id())  # a dozen rows, numbered as they come
    return report.withColumn("place", F.row_number().over(at).cast("long"))


@register("distinct_report", f"WITH {S.loan_book_cte()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{'numeric' if c in S.NUMERIC_RAW else 'categorical'}' AS column_type, "
    f"CAST(COUNT(DISTINCT {c}) AS BIGINT) AS unique_values, "
    f"ROUND(COUNT(DISTINCT {c}) * 100.0 / COUNT(*), 4) AS unique_pct FROM loan_book"
    for c in S.LOAN_COLUMNS if c != "loan_id"))
def q_distinct_report(spark, sf):
    return P.distinct_report(loan_book(spark, sf), exclude=[KEY])


@register("duplicate_count", """
SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT COUNT(*) AS c FROM lineitem GROUP BY l_orderkey, l_linenumber)""")
def q_duplicate_count(spark, sf):
    return P.duplicate_count(read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber"]))


@register("duplicate_count_loans", f"""
WITH {S.loan_book_cte()}
SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicates
FROM (SELECT COUNT(*) AS c FROM loan_book GROUP BY {', '.join(c for c in S.LOAN_COLUMNS if c != 'loan_id')})""")
def q_duplicate_count_loans(spark, sf):
    return P.duplicate_count(loan_book(spark, sf), RAW_COLUMNS)


@register("numeric_describe", f"WITH {S.loan_book_cte()} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(COUNT({c}) AS BIGINT) AS count, ROUND(AVG(CAST({c} AS DOUBLE)), 6) AS mean, "
    f"ROUND(STDDEV_SAMP(CAST({c} AS DOUBLE)), 6) AS std, ROUND(MIN(CAST({c} AS DOUBLE)), 6) AS min, "
    f"ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS q25, ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS q50, "
    f"ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS q75, ROUND(MAX(CAST({c} AS DOUBLE)), 6) AS max FROM loan_book"
    for c in S.NUMERIC_RAW))
def q_numeric_describe(spark, sf):
    return P.numeric_describe(loan_book(spark, sf), S.NUMERIC_RAW)


@register("categorical_describe", f"WITH {S.loan_book_cte()} " + " UNION ALL ".join(
    f"SELECT * FROM (SELECT '{c}' AS column_name, CAST(SUM(n) AS BIGINT) AS count, CAST(COUNT(*) AS BIGINT) AS \"unique\", "
    f"(SELECT v FROM (SELECT {c} AS v, COUNT(*) AS n FROM loan_book WHERE {c} IS NOT NULL GROUP BY {c}) "
    f"ORDER BY n DESC, v LIMIT 1) AS top, CAST(MAX(n) AS BIGINT) AS freq "
    f"FROM (SELECT {c} AS v, COUNT(*) AS n FROM loan_book WHERE {c} IS NOT NULL GROUP BY {c}))"
    for c in S.CATEGORICAL_RAW))
def q_categorical_describe(spark, sf):
    return P.categorical_describe(loan_book(spark, sf), S.CATEGORICAL_RAW)


@register("value_counts", f"""
WITH {S.loan_book_cte()}
SELECT loan_intent, CAST(COUNT(*) AS BIGINT) AS count FROM loan_book WHERE loan_intent IS NOT NULL GROUP BY loan_intent""")
def q_value_counts(spark, sf):
    return P.value_counts(loan_book(spark, sf), "loan_intent")


@register("value_counts_status", f"""
WITH {S.cleaned_cte()}
SELECT loan_status, CAST(COUNT(*) AS BIGINT) AS count FROM cleaned GROUP BY loan_status""")
def q_value_counts_status(spark, sf):
    return P.value_counts(cleaned(spark, sf), LABEL)


@register("column_max", f"""
WITH {S.loan_book_cte()}
SELECT 'raw' AS stage, MAX(person_age) AS max_person_age FROM loan_book
UNION ALL SELECT 'age_filtered' AS stage, MAX(person_age) AS max_person_age FROM loan_book WHERE person_age < 100""")
def q_column_max(spark, sf):
    lb = loan_book(spark, sf)
    raw = P.column_max(lb, ["person_age"]).select(F.lit("raw").alias("stage"), "*")
    flt = P.column_max(C.age_filter(lb), ["person_age"]).select(F.lit("age_filtered").alias("stage"), "*")
    return raw.unionByName(flt)


@register("distinct_values", f"WITH {S.engineered_cte()} SELECT DISTINCT loan_grade FROM engineered")
def q_distinct_values(spark, sf):
    return P.distinct_values(engineered(spark, sf), "loan_grade")


@register("row_audit", f"""
WITH {S.cleaned_cte()}
SELECT 'iqr_filter' AS step, 'before' AS stage, CAST(COUNT(*) AS BIGINT) AS n_rows, 13 AS n_cols FROM imputed
UNION ALL SELECT 'iqr_filter', 'after', CAST(COUNT(*) AS BIGINT), 13 FROM iqr_kept""")
def q_row_audit(spark, sf):
    dd, _, quants = PR.fit_imputation(loan_book(spark, sf), {PR.IQR_COLUMN: [0.25, 0.75]})
    q1, q3 = quants[PR.IQR_COLUMN]
    kept = F.lit(False) if q1 is None else F.col(PR.IQR_COLUMN).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return P.filter_audit(dd, kept, "iqr_filter")


# ---- 3. cleaning ----------------------------------------------------------------
@register("dedup", """
SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem""")
def q_dedup(spark, sf):
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])
    return C.drop_duplicates(li)


@register("impute_mean", f"""
WITH {S.loan_book_cte()}
SELECT loan_id, ROUND(COALESCE(loan_int_rate, (SELECT AVG(loan_int_rate) FROM loan_book)), 6) AS loan_int_rate
FROM loan_book""")
def q_impute_mean(spark, sf):
    df = C.impute_mean(loan_book(spark, sf), "loan_int_rate")
    return df.select(KEY, rnd("loan_int_rate").alias("loan_int_rate"))


@register("impute_median", f"""
WITH {S.loan_book_cte()}
SELECT loan_id, ROUND(COALESCE(person_emp_length, (SELECT quantile_cont(person_emp_length, 0.5) FROM loan_book)), 6)
  AS person_emp_length FROM loan_book""")
def q_impute_median(spark, sf):
    df = C.impute_median(loan_book(spark, sf), "person_emp_length")
    return df.select(KEY, rnd("person_emp_length").alias("person_emp_length"))


@register("iqr_filter", f"""
WITH {S.loan_book_cte()}, {S.iqr_bounds_sql('loan_book', 'loan_int_rate', 'b')}
SELECT loan_id, ROUND(loan_int_rate, 6) AS loan_int_rate FROM loan_book, b WHERE loan_int_rate BETWEEN b.lo AND b.hi""")
def q_iqr_filter(spark, sf):
    df = C.iqr_filter(loan_book(spark, sf), "loan_int_rate")
    return df.select(KEY, rnd("loan_int_rate").alias("loan_int_rate"))


@register("age_filter", f"WITH {S.loan_book_cte()} SELECT loan_id, person_age FROM loan_book WHERE person_age < 100")
def q_age_filter(spark, sf):
    return C.age_filter(loan_book(spark, sf)).select(KEY, "person_age")


@register("clean_loans", f"""
WITH {S.cleaned_cte()}
SELECT {', '.join(_r(c) if S.DTYPES[c] == 'double' else c for c in S.LOAN_COLUMNS)} FROM cleaned""")
def q_clean_loans(spark, sf):
    return _round_all(cleaned(spark, sf))


@register("project_features", f"""
WITH {S.cleaned_cte()}
SELECT loan_id, person_age, loan_amnt, ROUND(loan_percent_income, 6) AS loan_percent_income,
  cb_person_cred_hist_length FROM cleaned""")
def q_project_features(spark, sf):
    return _round_all(C.project(cleaned(spark, sf), [KEY, *Fe.CLUSTER_FEATURES]))


# ---- 4. exploration -------------------------------------------------------------
_CORR_COLS = S.NUMERIC_RAW


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(_CORR_COLS):
        for b in _CORR_COLS[i:]:
            e = f"ROUND(CORR(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"
            parts.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {e} AS corr FROM imputed")
            if a != b:
                parts.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, {e} AS corr FROM imputed")
    return f"WITH {S.imputed_cte()} " + " UNION ALL ".join(parts)


@register("corr_matrix", _corr_sql())
def q_corr_matrix(spark, sf):
    return E.corr_matrix(imputed(spark, sf), _CORR_COLS)


def _box_sql() -> str:
    parts = []
    for c in S.NUMERIC_RAW:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS column_name, CAST(COUNT({c}) AS BIGINT) AS n, ROUND(q1, 6) AS q1, ROUND(med, 6) AS median,
  ROUND(q3, 6) AS q3, ROUND(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, ROUND(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
  ROUND(MIN(CASE WHEN {x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {x} END), 6) AS whisker_low,
  ROUND(MAX(CASE WHEN {x} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {x} END), 6) AS whisker_high,
  CAST(SUM(CASE WHEN {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1) THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers
FROM imputed, (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS med, quantile_cont({x}, 0.75) AS q3 FROM imputed)
GROUP BY q1, med, q3""")
    return f"WITH {S.imputed_cte()} " + " UNION ALL ".join(parts)


@register("boxplot_stats", _box_sql())
def q_boxplot_stats(spark, sf):
    return E.boxplot_stats(imputed(spark, sf), S.NUMERIC_RAW)


_CLASS_FEATURES = ["loan_status", "person_age", "person_home_ownership", "loan_grade", "loan_intent",
                   "cb_person_default_on_file"]


@register("class_counts", f"WITH {S.imputed_cte()} " + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, loan_status, "
    f"CASE loan_status WHEN 0 THEN 'Good Loan' WHEN 1 THEN 'Bad Loan' END AS status_name, "
    f"CAST(COUNT(*) AS BIGINT) AS count FROM imputed GROUP BY {f}, loan_status" for f in _CLASS_FEATURES))
def q_class_counts(spark, sf):
    return E.class_counts(imputed(spark, sf), _CLASS_FEATURES)


_PAIR_COLS = [c for c in S.NUMERIC_RAW if c != LABEL]


def _pair_sql() -> str:
    mm = ", ".join(f"MIN(CAST({c} AS DOUBLE)) AS lo{i}, MAX(CAST({c} AS DOUBLE)) AS hi{i}"
                   for i, c in enumerate(_PAIR_COLS))
    bins = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL WHEN hi{i} = lo{i} THEN 0 ELSE "
        f"LEAST(CAST(FLOOR((CAST({c} AS DOUBLE) - lo{i}) / (hi{i} - lo{i}) * 10) AS INTEGER), 9) END AS b{i}"
        for i, c in enumerate(_PAIR_COLS))
    parts = []
    for i in range(len(_PAIR_COLS)):
        for j in range(i + 1, len(_PAIR_COLS)):
            parts.append(f"SELECT '{_PAIR_COLS[i]}' AS col_x, '{_PAIR_COLS[j]}' AS col_y, b{i} AS bin_x, b{j} AS bin_y, "
                         f"loan_status, CAST(COUNT(*) AS BIGINT) AS count FROM binned "
                         f"WHERE b{i} IS NOT NULL AND b{j} IS NOT NULL GROUP BY b{i}, b{j}, loan_status")
    return (f"WITH {S.imputed_cte()}, mm AS (SELECT {mm} FROM imputed), "
            f"binned AS (SELECT {bins}, loan_status FROM imputed, mm) " + " UNION ALL ".join(parts))


@register("pair_bins", _pair_sql())
def q_pair_bins(spark, sf):
    return E.pair_bins(imputed(spark, sf), _PAIR_COLS, LABEL, 10)


# ---- 5. features ----------------------------------------------------------------
@register("ratios", f"""
WITH {S.cleaned_cte()}, r AS (SELECT loan_id, {', '.join(S.ratios_sql())} FROM cleaned)
SELECT loan_id, {', '.join(_r(c) for c in Fe.RATIO_COLUMNS)} FROM r""")
def q_ratios(spark, sf):
    return _round_all(Fe.add_ratios(cleaned(spark, sf)).select(KEY, *Fe.RATIO_COLUMNS))


@register("discretize", f"WITH {S.cleaned_cte()} SELECT loan_id, {', '.join(S.bins_sql())} FROM cleaned")
def q_discretize(spark, sf):
    return Fe.discretize(cleaned(spark, sf)).select(KEY, "income_group", "loan_amount_group")


_ONEHOT = [f"{c}_{v}" for c in Fe.ONE_HOT_COLUMNS for v in S.CATEGORIES[c]]


@register("one_hot", f"WITH {S.engineered_cte()} SELECT loan_id, {', '.join(S.q(c) for c in _ONEHOT)} FROM engineered")
def q_one_hot(spark, sf):
    eng = engineered(spark, sf)
    return eng.select(KEY, *[F.col(f"`{c}`") for c in _ONEHOT])


@register("label_encode", f"""
WITH {S.engineered_cte()} SELECT loan_id, loan_grade, cb_person_default_on_file FROM engineered""")
def q_label_encode(spark, sf):
    return engineered(spark, sf).select(KEY, "loan_grade", "cb_person_default_on_file")


@register("standard_scale", f"""
WITH {S.engineered_cte()}, {S.scaled_cte()}
SELECT loan_id, loan_status, {', '.join(f'ROUND({S.q(f)}, 6) AS {S.q(f)}' for f in S.feature_names())} FROM scaled""")
def q_standard_scale(spark, sf):
    df, feats = scaled(spark, sf)
    return _round_all(df.select(KEY, LABEL, *[F.col(f"`{f}`") for f in feats]))


@register("scale_with_saved_stats", f"""
WITH {S.engineered_cte()},
train AS (SELECT * FROM engineered WHERE NOT {S.split_pred('engineered')}),
test AS (SELECT * FROM engineered WHERE {S.split_pred('engineered')}),
{S.scaled_cte(source='test', fit_on='train', name='tscaled')}
SELECT loan_id, loan_status, {', '.join(f'ROUND({S.q(f)}, 6) AS {S.q(f)}' for f in S.feature_names())} FROM tscaled""")
def q_scale_with_saved_stats(spark, sf):
    eng = engineered(spark, sf)
    feats = PR.feature_columns(eng)
    train, test = R.train_test_split(eng, KEY)
    stats = write_stage(Fe.fit_scaler(train, feats).to_df(spark), "scaler_stats",
                        shared_path(spark, "stages", "scaler_stats", unique=True))
    sc = Fe.ScalerModel.from_df(stats)
    out = sc.transform(test, fill_null=0.0)
    return _round_all(out.select(KEY, LABEL, *[F.col(f"`{f}`") for f in feats]))


@register("align_schema", f"""
WITH {S.engineered_cte()}
SELECT loan_id, loan_status, {', '.join(
    (f'ROUND(CAST({S.q(f)} AS DOUBLE), 6)' if f in S.feature_names() else '0.0') + f' AS {S.q(f)}'
    for f in Fe.REFERENCE_FEATURES)} FROM engineered""")
def q_align_schema(spark, sf):
    return _round_all(Fe.align_schema(engineered(spark, sf), Fe.REFERENCE_FEATURES, keep=[KEY, LABEL]))


# ---- 6. evaluation --------------------------------------------------------------
_TP = "CAST(SUM(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE)"
_FP = "CAST(SUM(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END) AS DOUBLE)"
_FN = "CAST(SUM(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE)"
_TN = "CAST(SUM(CASE WHEN label = 0 AND prediction = 0 THEN 1 ELSE 0 END) AS DOUBLE)"


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) ELSE 0.0 END"


@register("binary_metrics", f"""
WITH {S.eval_cte()}, c AS (SELECT {_TP} AS tp, {_FP} AS fp, {_FN} AS fn, {_TN} AS tn FROM evals)
SELECT ROUND({_div('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, ROUND({_div('tp', 'tp + fp')}, 6) AS precision,
  ROUND({_div('tp', 'tp + fn')}, 6) AS recall, ROUND({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1 FROM c""")
def q_binary_metrics(spark, sf):
    return V.binary_metrics(evals(spark, sf))


@register("confusion_matrix", f"""
WITH {S.eval_cte()}, cells AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS t(actual, predicted))
SELECT actual, predicted, CAST(COUNT(e.label) AS BIGINT) AS count
FROM cells LEFT JOIN evals e ON e.label = cells.actual AND e.prediction = cells.predicted
GROUP BY actual, predicted""")
def q_confusion_matrix(spark, sf):
    return V.confusion_matrix(evals(spark, sf))


@register("classification_report", f"""
WITH {S.eval_cte()}, c AS (SELECT {_TP} AS tp, {_FP} AS fp, {_FN} AS fn, {_TN} AS tn FROM evals),
m AS (SELECT *, {_div('tp', 'tp + fp')} AS p1, {_div('tp', 'tp + fn')} AS r1, {_div('tn', 'tn + fn')} AS p0,
  {_div('tn', 'tn + fp')} AS r0, {_div('2 * tp', '2 * tp + fp + fn')} AS f1, {_div('2 * tn', '2 * tn + fn + fp')} AS f0,
  tp + fn AS s1, tn + fp AS s0, tp + fp + fn + tn AS n FROM c)
SELECT '0' AS class_name, ROUND(p0, 6) AS precision, ROUND(r0, 6) AS recall, ROUND(f0, 6) AS f1_score, CAST(s0 AS BIGINT) AS support FROM m
UNION ALL SELECT '1', ROUND(p1, 6), ROUND(r1, 6), ROUND(f1, 6), CAST(s1 AS BIGINT) FROM m
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND({_div('tp + tn', 'n')}, 6), CAST(n AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', ROUND((p0 + p1) / 2, 6), ROUND((r0 + r1) / 2, 6), ROUND((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', ROUND({_div('p0 * s0 + p1 * s1', 'n')}, 6), ROUND({_div('r0 * s0 + r1 * s1', 'n')}, 6),
  ROUND({_div('f0 * s0 + f1 * s1', 'n')}, 6), CAST(n AS BIGINT) FROM m""")
def q_classification_report(spark, sf):
    return V.classification_report(evals(spark, sf))


@register("roc_points", f"""
WITH {S.eval_cte()},
g AS (SELECT score, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
  FROM evals GROUP BY score),
t AS (SELECT SUM(pos) AS p, SUM(neg) AS n FROM g),
c AS (SELECT score, SUM(pos) OVER (ORDER BY score DESC) AS cp, SUM(neg) OVER (ORDER BY score DESC) AS cn FROM g)
SELECT 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT score AS threshold, ROUND(cn / CAST(t.n AS DOUBLE), 6) AS fpr, ROUND(cp / CAST(t.p AS DOUBLE), 6) AS tpr FROM c, t""")
def q_roc_points(spark, sf):
    return V.roc_points(evals(spark, sf), drop_intermediate=False)


@register("roc_curve", f"""
WITH {S.eval_cte()},
g AS (SELECT score, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
  FROM evals GROUP BY score),
t AS (SELECT SUM(pos) AS p, SUM(neg) AS n FROM g),
c AS (SELECT score, pos, neg, SUM(pos) OVER (ORDER BY score DESC) AS cp, SUM(neg) OVER (ORDER BY score DESC) AS cn, LAG(score) OVER (ORDER BY score DESC) AS before,
  LEAD(pos) OVER (ORDER BY score DESC) AS next_pos, LEAD(neg) OVER (ORDER BY score DESC) AS next_neg FROM g)
SELECT 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT score AS threshold, ROUND(cn / CAST(t.n AS DOUBLE), 6) AS fpr, ROUND(cp / CAST(t.p AS DOUBLE), 6) AS tpr FROM c, t
WHERE before IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg""")
def q_roc_curve(spark, sf):
    """V4 as plotted: without the points on a straight line between their neighbours."""
    return V.roc_points(evals(spark, sf))


_AUC_SQL = """g AS (SELECT score, SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS neg
  FROM {src} GROUP BY score),
c AS (SELECT *, SUM(neg) OVER (ORDER BY score) - neg AS below FROM g),
a AS (SELECT SUM(pos * (below + 0.5 * neg)) AS s, SUM(pos) AS p, SUM(neg) AS n FROM c)"""


@register("roc_auc", f"""
WITH {S.eval_cte()}, {_AUC_SQL.format(src='evals')}
SELECT ROUND(CASE WHEN p > 0 AND n > 0 THEN s / (CAST(p AS DOUBLE) * n) END, 6) AS roc_auc FROM a""")
def q_roc_auc(spark, sf):
    return V.roc_auc(evals(spark, sf))


def _stage_sql(name: str, thr: float) -> str:
    return f"""SELECT '{name}' AS stage, ROUND({_div('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy,
  ROUND({_div('tp', 'tp + fp')}, 6) AS precision, ROUND({_div('tp', 'tp + fn')}, 6) AS recall,
  ROUND({_div('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp,
  CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp,
  (SELECT ROUND(CASE WHEN p > 0 AND n > 0 THEN s / (CAST(p AS DOUBLE) * n) END, 6) FROM a) AS roc_auc
FROM (SELECT {_TP.replace('prediction', 'pr')} AS tp, {_FP.replace('prediction', 'pr')} AS fp,
  {_FN.replace('prediction', 'pr')} AS fn, {_TN.replace('prediction', 'pr')} AS tn
  FROM (SELECT label, CASE WHEN score >= {thr} THEN 1 ELSE 0 END AS pr FROM evals))"""


_STAGES = {"untuned": 0.5, "tuned": 0.45}


@register("stage_comparison", f"""
WITH {S.eval_cte()}, {_AUC_SQL.format(src='evals')}
{' UNION ALL '.join(_stage_sql(n, t) for n, t in _STAGES.items())}""")
def q_stage_comparison(spark, sf):
    ev = evals(spark, sf)
    return V.threshold_comparison(ev, _STAGES)


_SIL_SQL = f"""
cs AS (SELECT cluster, COUNT(*) AS n, SUM({' + '.join(f'{f} * {f}' for f in Fe.CLUSTER_FEATURES)}) AS ss,
  {', '.join(f'SUM({f}) AS s_{f}' for f in Fe.CLUSTER_FEATURES)} FROM assigned GROUP BY cluster),
pd AS (SELECT p.loan_id, p.cluster AS own, c.cluster AS other, c.n,
  ({' + '.join(f'p.{f} * p.{f}' for f in Fe.CLUSTER_FEATURES)})
  - 2 * ({' + '.join(f'p.{f} * (c.s_{f} / c.n)' for f in Fe.CLUSTER_FEATURES)}) + c.ss / c.n AS d
  FROM assigned p, cs c),
ab AS (SELECT loan_id,
  MAX(CASE WHEN own = other THEN (CASE WHEN n > 1 THEN d * n / (n - 1) ELSE 0.0 END) END) AS a,
  MIN(CASE WHEN own <> other THEN d END) AS b, MAX(CASE WHEN own = other THEN n END) AS own_n FROM pd GROUP BY loan_id)"""


@register("silhouette_sq", f"""
WITH {S.cluster_points_cte()}, {_SIL_SQL}
SELECT ROUND(AVG(CASE WHEN own_n <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1 ELSE 0.0 END), 6)
  AS silhouette FROM ab""")
def q_silhouette_sq(spark, sf):
    pts, _ = cluster_points(spark, sf)
    return V.silhouette_sq(pts, Fe.CLUSTER_FEATURES, "cluster")


@register("nearest_centroid", f"WITH {S.cluster_points_cte()} SELECT loan_id, cluster FROM assigned")
def q_nearest_centroid(spark, sf):
    pts, _ = cluster_points(spark, sf)
    return pts.select(KEY, F.col("cluster").cast("int").alias("cluster"))


@register("inertia", f"""
WITH {S.cluster_points_cte()}
SELECT ROUND(SUM(d), 6) AS inertia FROM dists JOIN assigned a ON a.loan_id = dists.loan_id AND a.cluster = dists.cid""")
def q_inertia(spark, sf):
    pts, cents = cluster_points(spark, sf)
    return V.inertia(pts, Fe.CLUSTER_FEATURES, cents, "cluster")


# ---- 7. sampling ----------------------------------------------------------------
@register("train_test_split", f"""
WITH {S.loan_book_cte()}
SELECT loan_id, CASE WHEN {S.split_pred('loan_book')} THEN 'test' ELSE 'train' END AS split FROM loan_book""")
def q_train_test_split(spark, sf):
    return R.with_split(loan_book(spark, sf), KEY).select(KEY, "split")


@register("class_balance", f"""
WITH {S.cleaned_cte()}
SELECT 'raw' AS stage, loan_status, CAST(COUNT(*) AS BIGINT) AS count FROM loan_book GROUP BY loan_status
UNION ALL SELECT 'cleaned', loan_status, CAST(COUNT(*) AS BIGINT) FROM cleaned GROUP BY loan_status
UNION ALL SELECT 'train', loan_status, CAST(COUNT(*) AS BIGINT) FROM cleaned WHERE NOT {S.split_pred()} GROUP BY loan_status
UNION ALL SELECT 'test', loan_status, CAST(COUNT(*) AS BIGINT) FROM cleaned WHERE {S.split_pred()} GROUP BY loan_status""")
def q_class_balance(spark, sf):
    lb = loan_book(spark, sf)
    split = R.with_split(PR.clean_loans(lb), KEY)
    of_cleaned = R.class_balance_flags(split, {"cleaned": F.lit(True), "train": F.col("split") == "train", "test": F.col("split") == "test"})
    return R.class_balance({"raw": lb}).unionByName(of_cleaned)


# ---- S1 / S2 ------------------------------------------------------------------
@register("csv_roundtrip", f"""
WITH {S.loan_book_cte()} SELECT {', '.join(_r(c) if S.DTYPES[c] == 'double' else c for c in S.LOAN_COLUMNS)} FROM loan_book""")
def q_csv_roundtrip(spark, sf):
    path = shared_path(spark, "csv", "loan_book", unique=True)
    lb = loan_book(spark, sf).select(*[f.name for f in KEYED_SCHEMA.fields])
    write_loan_csv(lb, path)
    back = read_loan_csv(spark, path, KEYED_SCHEMA)
    return _round_all(back.select(*S.LOAN_COLUMNS))


@register("stage_roundtrip", f"""
WITH {S.cleaned_cte()}
SELECT {', '.join(_r(c) if S.DTYPES[c] == 'double' else c for c in S.LOAN_COLUMNS)} FROM cleaned""")
def q_stage_roundtrip(spark, sf):
    path = shared_path(spark, "stages", "data_outlier", unique=True)
    return _round_all(write_stage(cleaned(spark, sf), "data_outlier", path))
