"""F1-F8: ratios, right-closed binning, one-hot and label encoding, standard
scaling, schema alignment and PCA.

Fitted one-hot categories, scalers and loadings are small tables whose size is the number of
features; they are saved with S2 and applied as literal column expressions. Label codes are a
table joined by value, as a column may have any number of classes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import right_closed_bins, safe_div
from ..functions.prefix import positions
from .clean import materialize

# ---- Fixed values (must equal the reference for equal results) -------------
INCOME_EDGES = [0, 25000, 50000, 75000, 100000, math.inf]
INCOME_LABELS = ["low", "low-middle", "middle", "high-middle", "high"]
AMOUNT_EDGES = [0, 5000, 10000, 15000, math.inf]
AMOUNT_LABELS = ["small", "medium", "large", "very large"]
ONE_HOT_COLUMNS = ["person_home_ownership", "loan_intent", "income_group", "loan_amount_group"]
LABEL_ENCODED_COLUMNS = ["loan_grade", "cb_person_default_on_file"]
RATIO_COLUMNS = ["loan_to_income_ratio", "loan_to_emp_length_ratio", "int_rate_to_loan_amt_ratio"]
CLUSTER_FEATURES = ["person_age", "loan_amnt", "loan_percent_income", "cb_person_cred_hist_length"]
# The reference model's 29 feature names, in its order (its data's categories).
REFERENCE_FEATURES = [
    "person_age", "person_emp_length", "loan_grade", "loan_int_rate", "loan_percent_income",
    "cb_person_default_on_file", "cb_person_cred_hist_length", "loan_to_income_ratio",
    "loan_to_emp_length_ratio", "int_rate_to_loan_amt_ratio",
    "person_home_ownership_MORTGAGE", "person_home_ownership_OTHER", "person_home_ownership_OWN",
    "person_home_ownership_RENT", "loan_intent_DEBTCONSOLIDATION", "loan_intent_EDUCATION",
    "loan_intent_HOMEIMPROVEMENT", "loan_intent_MEDICAL", "loan_intent_PERSONAL",
    "loan_intent_VENTURE", "income_group_high", "income_group_high-middle", "income_group_low",
    "income_group_low-middle", "income_group_middle", "loan_amount_group_large",
    "loan_amount_group_medium", "loan_amount_group_small", "loan_amount_group_very large",
]
# -----------------------------------------------------------------------------


def add_ratios(df: DataFrame) -> DataFrame:
    """F1 the three ratios; the second is emp_length / amount, as in the reference."""
    return df.select(
        "*",
        safe_div("loan_amnt", "person_income").alias("loan_to_income_ratio"),
        safe_div("person_emp_length", "loan_amnt").alias("loan_to_emp_length_ratio"),
        safe_div("loan_int_rate", "loan_amnt").alias("int_rate_to_loan_amt_ratio"),
    )


def discretize(df: DataFrame, drop_source: bool = True) -> DataFrame:
    """F2 income and amount groups with right-closed bins; out of range -> NULL."""
    out = df.select(
        "*",
        right_closed_bins("person_income", INCOME_EDGES, INCOME_LABELS).alias("income_group"),
        right_closed_bins("loan_amnt", AMOUNT_EDGES, AMOUNT_LABELS).alias("loan_amount_group"),
    )
    if drop_source:
        # the reference drops each source column right after binning it
        cols = [c for c in out.columns if c not in ("person_income", "loan_amnt")]
        cols.remove("income_group")
        cols.remove("loan_amount_group")
        out = out.select(*cols, "income_group", "loan_amount_group")
    return out


def _pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct (column_name, value) of the columns, NULL left out, from one pass."""
    kv = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols])).alias("kv")
    return df.select(kv).select("kv.*").where(F.col("value").isNotNull()).distinct()


@dataclass
class OneHotModel:
    """F3 one-hot encoder: sorted categories per column, none dropped."""
    categories: dict[str, list[str]]

    def output_columns(self) -> list[str]:
        return [f"{c}_{v}" for c, vals in self.categories.items() for v in vals]

    def transform(self, df: DataFrame) -> DataFrame:
        keep = [c for c in df.columns if c not in self.categories]
        enc = [F.when(F.col(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).alias(f"{c}_{v}")
               for c, vals in self.categories.items() for v in vals]
        return df.select(*keep, *enc)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(p, c, i, v) for p, (c, vals) in enumerate(self.categories.items()) for i, v in enumerate(vals)]
        return spark.createDataFrame(rows, "col_pos int, column_name string, code int, value string")

    @staticmethod
    def from_df(df: DataFrame) -> "OneHotModel":
        cats: dict[str, list[str]] = {}
        for r in sorted(df.collect(), key=lambda r: (r["col_pos"], r["code"])):
            cats.setdefault(r["column_name"], []).append(r["value"])
        return OneHotModel(cats)


def fit_one_hot(df: DataFrame, cols: Sequence[str] = ONE_HOT_COLUMNS) -> OneHotModel:
    """One output column per category, whatever their number: a wide column gives a wide frame."""
    return _one_hot(_pairs(df, cols), cols)


def _one_hot(pairs: DataFrame, cols: Sequence[str]) -> OneHotModel:
    found: dict[str, list[str]] = {c: [] for c in cols}
    for r in pairs.collect():  # as many rows as the result has columns
        found[r["column_name"]].append(r["value"])
    return OneHotModel({c: sorted(found[c]) for c in cols})


class LabelEncoderModel:
    """F4 label encoder: codes 0..n-1 in sorted order; unseen values -> NULL.

    The codes are a table (col_pos, column_name, code, value), joined by value, so a
    column may have any number of classes. Spark broadcasts the table while it is small.
    """

    def __init__(self, codes: DataFrame, columns: Sequence[str]):
        self.codes, self.columns = codes, list(columns)

    def transform(self, df: DataFrame) -> DataFrame:
        order = df.columns
        for c in self.columns:
            if c in order:
                one = self.codes.where(F.col("column_name") == c).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
                df = df.join(one, F.col(c).cast("string") == F.col("_value"), "left").drop("_value", c).withColumnRenamed("_code", c)
        return df.select(*[F.col(f"`{c}`") for c in order])

    def to_df(self, spark: SparkSession) -> DataFrame:
        return self.codes

    @staticmethod
    def from_df(df: DataFrame) -> "LabelEncoderModel":
        names = [r["column_name"] for r in df.select("col_pos", "column_name").distinct().orderBy("col_pos").collect()]
        return LabelEncoderModel(df, names)


def fit_label_encoder(df: DataFrame, cols: Sequence[str] = LABEL_ENCODED_COLUMNS) -> LabelEncoderModel:
    """Ranks the distinct values by a range sort; no list of values reaches the driver."""
    return _label_encoder(_pairs(df, cols), list(cols))


def _label_encoder(pairs: DataFrame, cols: list[str]) -> LabelEncoderModel:
    at = positions(pairs, ["column_name", "value"])
    first = {r["column_name"]: r["first"] for r in at.groupBy("column_name").agg(F.min("position").alias("first")).collect()}
    place = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)])
    start = F.create_map(*[F.lit(x) for c in cols for x in (c, int(first.get(c, 0)))])
    return LabelEncoderModel(at.select(place[F.col("column_name")].alias("col_pos"), "column_name",
                                       (F.col("position") - start[F.col("column_name")]).cast("int").alias("code"), "value"), cols)


def fit_encoders(df: DataFrame, one_hot_cols: Sequence[str] = ONE_HOT_COLUMNS,
                 label_cols: Sequence[str] = LABEL_ENCODED_COLUMNS) -> tuple[OneHotModel, "LabelEncoderModel"]:
    """F3 + F4, from one pass over the rows: their distinct values are written once."""
    one_hot_cols, label_cols = list(one_hot_cols), list(label_cols)
    pairs = materialize(_pairs(df, list(dict.fromkeys(one_hot_cols + label_cols))), "categories")
    return (_one_hot(pairs.where(F.col("column_name").isin(one_hot_cols)), one_hot_cols),
            _label_encoder(pairs.where(F.col("column_name").isin(label_cols)), label_cols))


@dataclass
class ScalerModel:
    """F5 standard scaler: (x - mean) / population std; zero std divides by 1."""
    means: dict[str, float | None]
    stds: dict[str, float | None]

    def expr(self, c: str):
        m, s = self.means[c], self.stds[c]
        s = 1.0 if (s is None or s == 0.0) else s
        return ((F.col(c).cast("double") - F.lit(m if m is not None else 0.0)) / F.lit(s))

    def transform(self, df: DataFrame, fill_null: float | None = None) -> DataFrame:
        cols = []
        for c in df.columns:
            if c in self.means:
                e = self.expr(c)
                cols.append((F.coalesce(e, F.lit(fill_null)) if fill_null is not None else e).alias(c))
            else:
                cols.append(F.col(c))
        return df.select(*cols)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, c, self.means[c], self.stds[c]) for i, c in enumerate(self.means)]
        return spark.createDataFrame(rows, "position int, column_name string, mean double, std double")

    @staticmethod
    def from_df(df: DataFrame) -> "ScalerModel":
        rows = sorted(df.collect(), key=lambda r: r["position"])
        return ScalerModel({r["column_name"]: r["mean"] for r in rows},
                           {r["column_name"]: r["std"] for r in rows})


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> ScalerModel:
    """One aggregate computes mean and population std of every column."""
    cols = list(cols)
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return ScalerModel({c: row[f"m{i}"] for i, c in enumerate(cols)},
                       {c: row[f"s{i}"] for i, c in enumerate(cols)})


def standard_scale(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F5 fit and apply in one call."""
    return fit_scaler(df, cols).transform(df)


def align_schema(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """F7 add missing feature columns as 0, drop extras, fix the order."""
    have = set(df.columns)
    cols = [F.col(k) for k in keep if k in have]
    cols += [(F.col(f).cast("double") if f in have else F.lit(0.0)).alias(f) for f in features]
    return df.select(*cols)


@dataclass
class PCAModel2:
    """F8 principal components as loadings; applied as linear expressions.

    The sign of every component is fixed so its largest-magnitude loading is
    positive, which makes the output deterministic.
    """
    columns: list[str]
    loadings: list[list[float]]          # one list per component
    explained_variance: list[float] = field(default_factory=list)

    def transform(self, df: DataFrame, names: Sequence[str] = ("PCA1", "PCA2"), keep: Sequence[str] = ()) -> DataFrame:
        comps = []
        for name, w in zip(names, self.loadings):
            e = None
            for c, wj in zip(self.columns, w):
                term = F.col(c).cast("double") * F.lit(float(wj))
                e = term if e is None else e + term
            comps.append(e.alias(name))
        return df.select(*keep, *comps)

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(k, c, float(w[j]), float(self.explained_variance[k]) if self.explained_variance else None)
                for k, w in enumerate(self.loadings) for j, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, "component int, column_name string, loading double, explained double")

    @staticmethod
    def from_df(df: DataFrame) -> "PCAModel2":
        rows = df.collect()
        ncomp = max(r["component"] for r in rows) + 1
        cols: list[str] = []
        for r in rows:
            if r["component"] == 0:
                cols.append(r["column_name"])
        lut = {(r["component"], r["column_name"]): r["loading"] for r in rows}
        ev = {r["component"]: r["explained"] for r in rows}
        return PCAModel2(cols, [[lut[(k, c)] for c in cols] for k in range(ncomp)],
                         [ev[k] for k in range(ncomp)])


def fit_pca(df: DataFrame, cols: Sequence[str], k: int = 2) -> PCAModel2:
    """F8 fit with ``pyspark.ml.feature.PCA`` (distributed covariance)."""
    cols = list(cols)
    vec = VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="error").transform(df)
    model = PCA(k=k, inputCol="_features", outputCol="_pca").fit(vec.select("_features"))
    pc = model.pc.toArray()  # n_features x k
    loadings = []
    for j in range(k):
        w = pc[:, j]
        if w[int(np.argmax(np.abs(w)))] < 0:
            w = -w
        loadings.append([float(x) for x in w])
    return PCAModel2(cols, loadings, [float(x) for x in model.explainedVariance.toArray()])
