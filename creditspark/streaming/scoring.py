"""M9 as a Structured Streaming job: application files arriving in a folder
are scored with the saved bundles and appended to a sink.

Scoring is stateless and row-wise (its only join is with the static label codes), so the batch
function, NaN rule and imputation included, runs unchanged on the streaming DataFrame; the checkpoint lives in
the shared folder, so a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.jobs import ClassifierBundle, ClusterBundle, score_applications
from ..session import shared_path
from ..sources.files import KEYED_SCHEMA

APPLICATION_SCHEMA = T.StructType([f for f in KEYED_SCHEMA.fields if f.name != "loan_status"])


def start_scoring_stream(spark: SparkSession, source_dir: str, sink_dir: str, classifier_path: str,
                         cluster_path: str, fmt: str = "parquet", checkpoint: str | None = None,
                         available_now: bool = True, max_files_per_trigger: int = 1000) -> StreamingQuery:
    clf = ClassifierBundle.load(spark, classifier_path)
    clu = ClusterBundle.load(spark, cluster_path)
    apps = (spark.readStream.schema(APPLICATION_SCHEMA).format(fmt)
            .option("maxFilesPerTrigger", max_files_per_trigger)
            .option("header", "true").load(source_dir))
    scored = score_applications(apps, clf, clu)
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint or shared_path(spark, "streams", "scoring", unique=True))
              .option("path", sink_dir))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
