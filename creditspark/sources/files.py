"""S1 CSV scan with a declared schema, S2 stage tables, S3 model persistence.

Stage tables and models live below the shared checkpoint folder, so every
executor sees them and a lost executor never loses a stage.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_path
from .versions import commit, current, new_folder

#: Spark removes the shuffle files of a query when it ends, not when the driver's next full collection finds them unused
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Schema of the raw loan table as a CSV file (no inference at scale).
RAW_SCHEMA = T.StructType([
    T.StructField("person_age", T.IntegerType()),
    T.StructField("person_income", T.LongType()),
    T.StructField("person_home_ownership", T.StringType()),
    T.StructField("person_emp_length", T.DoubleType()),
    T.StructField("loan_intent", T.StringType()),
    T.StructField("loan_grade", T.StringType()),
    T.StructField("loan_amnt", T.LongType()),
    T.StructField("loan_int_rate", T.DoubleType()),
    T.StructField("loan_status", T.IntegerType()),
    T.StructField("loan_percent_income", T.DoubleType()),
    T.StructField("cb_person_default_on_file", T.StringType()),
    T.StructField("cb_person_cred_hist_length", T.IntegerType()),
])

KEYED_SCHEMA = T.StructType([T.StructField("loan_id", T.LongType()), *RAW_SCHEMA.fields])


def nan_to_null(df: DataFrame) -> DataFrame:
    """Map floating NaN to NULL once at the scan (NaN poisons corr/avg)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.when(F.isnan(f.name), F.lit(None).cast(f.dataType))
                        .otherwise(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_loan_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """``read_csv(path)``: header row, comma separated, declared schema."""
    df = (spark.read.schema(schema)
          .option("header", "true").option("sep", ",").option("mode", "FAILFAST")
          .csv(path))
    return nan_to_null(df)


def write_loan_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", "true").csv(path)
    return path


def stage_path(spark: SparkSession, name: str) -> str:
    return shared_path(spark, "stages", name)


def write_once(df: DataFrame, path: str) -> DataFrame:
    """Persist a table below a path of its own and read it back, which cuts the lineage.

    The write's shuffle files go when it ends: nothing reads them again, and those of many stages would fill the disks.
    """
    spark = df.sparkSession
    was = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, was)
    return spark.read.parquet(path)


def write_stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Persist a stage table as parquet in the shared folder and read it back.

    Reading back cuts the lineage: later jobs restart from the files, not from
    the plan that produced them. Writing a stage again adds a version (``versions``): tables read
    before keep their rows, ``df`` may read the stage it replaces, and a write that fails leaves the stage as it was.
    """
    spark = df.sparkSession
    path = path or stage_path(spark, name)
    folder = new_folder(spark, path)
    out = write_once(df, folder)
    commit(spark, path, folder)
    return out


def read_stage(spark: SparkSession, name: str, path: str | None = None) -> DataFrame:
    """The newest version of a stage."""
    return spark.read.parquet(current(spark, path or stage_path(spark, name)))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
