"""Stage plans in the notebook's order (the order that trained the models).

raw loan table -> dedup -> impute (mean rate, median employment length)
-> IQR filter on the last numeric column -> age < 100      = ``data_outlier``
-> ratios -> bins -> one-hot -> label codes               = engineered table
-> standard scaling (NULL scaled features filled with 0, the mean)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import features as Fe
from ..sources import KEY, LABEL, RAW_COLUMNS

RAW_FEATURES = [c for c in RAW_COLUMNS if c != LABEL]
# Q1: the reference's outlier loop keeps only the last numeric column's filter.
IQR_COLUMN = "cb_person_cred_hist_length"


MEAN_COLUMN = "loan_int_rate"
MEDIAN_COLUMN = "person_emp_length"


@dataclass
class Imputation:
    """C2 + C3 values, saved with a model and applied to the rows it scores."""
    rate: float | None
    emp_length: float | None

    def apply(self, df: DataFrame) -> DataFrame:
        return C.fill(C.fill(df, MEAN_COLUMN, self.rate), MEDIAN_COLUMN, self.emp_length)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.rate, self.emp_length)], "rate double, emp_length double")

    @staticmethod
    def from_df(df: DataFrame) -> "Imputation":
        r = df.first()
        return Imputation(r["rate"], r["emp_length"])


def deduplicated(raw: DataFrame) -> DataFrame:
    """The row with the smallest key of each group of equal rows."""
    return C.drop_duplicates(raw, subset=RAW_COLUMNS, keep_min=KEY)


def fit_imputation(raw: DataFrame, extra_quantiles: dict[str, list[float]] | None = None, materialize: bool = True
                   ) -> tuple[DataFrame, Imputation, dict[str, list[float | None]]]:
    """(deduplicated rows, imputation, extra quantiles). The raw rows are written once, and once more without
    duplicates if there are any; the mean, the median and any extra quantiles of untouched columns are fitted in one
    set of passes over them."""
    if materialize:
        raw = C.materialize(raw, "raw")  # its joins would run for the digests and again for the rows
    dd = deduplicated(raw)
    if materialize and dd is not raw:
        dd = C.materialize(dd, "dedup")
    means, quants = C.fit_stats(dd, [MEAN_COLUMN], {MEDIAN_COLUMN: [0.5], **(extra_quantiles or {})})
    return dd, Imputation(means[MEAN_COLUMN], quants[MEDIAN_COLUMN][0]), quants


def impute_loans(raw: DataFrame, extra_quantiles: dict[str, list[float]] | None = None,
                 materialize: bool = True) -> tuple[DataFrame, dict[str, list[float | None]]]:
    """C1 -> C2 -> C3."""
    dd, values, quants = fit_imputation(raw, extra_quantiles, materialize)
    return values.apply(dd), quants


def clean_loans(raw: DataFrame, iqr_column: str = IQR_COLUMN, materialize: bool = True) -> DataFrame:
    """C1 -> C2 -> C3 -> C4 -> C5 (``data_outlier``)."""
    return clean_and_fit(raw, iqr_column, materialize)[0]


def clean_and_fit(raw: DataFrame, iqr_column: str = IQR_COLUMN, materialize: bool = True) -> tuple[DataFrame, Imputation]:
    """The cleaned rows and the imputation values fitted on the way."""
    if iqr_column in (MEAN_COLUMN, MEDIAN_COLUMN):
        dd, values, _ = fit_imputation(raw, materialize=materialize)
        df = C.iqr_filter(values.apply(dd), iqr_column)
    else:
        # imputation does not touch the IQR column: fit its quartiles in the same passes
        dd, values, quants = fit_imputation(raw, {iqr_column: [0.25, 0.75]}, materialize)
        df = values.apply(dd)
        q1, q3 = quants[iqr_column]
        if q1 is None:
            df = df.where("false")
        else:
            df = df.where(F.col(iqr_column).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)))
    return C.age_filter(df), values


@dataclass
class Encoders:
    one_hot: Fe.OneHotModel
    labels: Fe.LabelEncoderModel


def engineer(cleaned: DataFrame, encoders: Encoders | None = None) -> tuple[DataFrame, Encoders]:
    """F1 -> F2 -> F3 -> F4. Encoders are fitted here unless given (scoring)."""
    df = Fe.discretize(Fe.add_ratios(cleaned))
    if encoders is None:
        encoders = Encoders(*Fe.fit_encoders(df))
    df = encoders.labels.transform(encoders.one_hot.transform(df))
    return df, encoders


def feature_columns(engineered: DataFrame) -> list[str]:
    return [c for c in engineered.columns if c not in (KEY, LABEL)]


def scaled_features(engineered: DataFrame, features: list[str], scaler: Fe.ScalerModel | None = None,
                    fill: float | None = 0.0) -> tuple[DataFrame, Fe.ScalerModel]:
    """F5 on the feature columns (label excluded); NULL scaled values -> ``fill``."""
    scaler = scaler or Fe.fit_scaler(engineered, features)
    return scaler.transform(engineered, fill_null=fill), scaler
