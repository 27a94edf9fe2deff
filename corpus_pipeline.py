"""Corpus pipeline: quality filter, near-duplicate join, decontamination, secret scan, byte-level BPE.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.llm import frames
from creditspark.llm.bpe import bpe_round_trip
from creditspark.llm.decontaminate import decontaminate
from creditspark.llm.jaccard_join import keep_one
from creditspark.llm.quality import filter_quality, fit_quality
from creditspark.llm.queries import fold, sha256
from creditspark.llm.secret_scan import redact_secrets


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now (a null text keeps its number)."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(kind))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels that op5 learns from."""
    labels = frames.table(spark, sf_dir, "labels", "doc_id", "quality").where(fold("doc_id", 5) != 0)
    return filter_quality(docs, fit_quality(docs.select("doc_id", "text"), labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more, smallest doc_id."""
    return keep_one(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go."""
    return _recounted(decontaminate(docs, frames.table(spark, sf_dir, "benchmark", "item_id", "text")))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    return _recounted(redact_secrets(docs, frames.work_path(spark, "pipeline-ledger")))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of their decoded bytes (the text again)."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    return tokens.select("doc.doc_id", "doc.lang", "doc.source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                         sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("byte_bpe", byte_bpe)]

#: no SQL: the classifier, the links' components and the merges of the tokenizer cannot be written in it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = frames.work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
