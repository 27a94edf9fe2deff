"""One registered query per operator: the operator over its whole table, and the digests that its contract asks for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames, sql
from .bpe import bpe_decode, bpe_encode
from .collocation import collocations
from .decontaminate import find_contamination
from .jaccard_join import jaccard_components
from .langid import fit_languages, identify
from .license_scan import confidence, find_licenses, labels_of
from .pii import KINDS, find_personal_data
from .quality import CUT, fit_quality, score_quality
from .secret_scan import scan_secrets
from .simhash import neighbour_likeness, with_near_counts
from .spans import listing
from .substring_dedup import substring_dedup
from .token_store import read_tokens, write_tokens
from .vector_codes import compress_vectors, with_label_error

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f
    return add


def sha256(col: Column | str) -> Column:
    return F.sha2(F.col(col) if isinstance(col, str) else col, 256)


@query("op1_decontamination", sql.decontamination())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = find_contamination(frames.table(spark, sf_dir, "documents", "doc_id", "text"), frames.table(spark, sf_dir, "benchmark", "item_id", "text"))
    hit = F.aggregate("marks.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = marked.select("doc.doc_id", "marks.n_words", hit.alias("n_hit"), F.col("marks.items").alias("items"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256(F.array_join("items", ",")).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = bpe_decode(bpe_encode(frames.table(spark, sf_dir, "documents", "doc_id", "text"), path), path)
    return tokens.select("doc.doc_id", F.size("ids").cast("long").alias("n_tokens"), sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
                         sha256("decoded").alias("decoded_sha256"))


@query("op3_substring_dedup", sql.substring_dedup())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(frames.table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


@query("op4_token_store")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = frames.work_path(spark, "op4-tokens")
    write_tokens(frames.table(spark, sf_dir, "documents", "doc_id", "text"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents", "doc_id", "text")
    model = fit_quality(docs, frames.table(spark, sf_dir, "labels", "doc_id", "quality").where(fold("doc_id", 5) != 0))
    scored = score_quality(docs, model).select("doc.doc_id", "score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


@query("op9_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit_languages(docs.where(fold("doc_id", 3) != 1))
    named = identify(docs.select("doc_id", "text"), model).select("doc.doc_id", "lang_pred", "score", "rejected")
    return named.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op6_sanitisation")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(frames.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", *(count_kind("base", k).alias(f"n_{k}") for k in KINDS[:4]), sha256(listing(F.col("base"))).alias("base_sha256"), listing(F.col("spans")).alias("spans"))


@query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(frames.table(spark, sf_dir, "documents", "doc_id", "text"), frames.work_path(spark, "op8-ledger"))
    base = F.filter("findings", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc.doc_id", "findings", base.alias("base")).select(
        "doc_id", *(count_kind("findings", k).alias(f"n_{k}") for k in ("assign", "access", "hex")), sha256(listing(F.col("base"))).alias("base_sha256"), listing(F.col("findings")).alias("spans"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = frames.work_path(spark, "op7-fingerprints")
    neighbour_likeness(frames.table(spark, sf_dir, "documents", "doc_id", "text")).write.parquet(path)
    return with_near_counts(spark.read.parquet(path), F.col("doc_id") % 50 == 0)


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_components(frames.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


@query("op11_collocations", sql.collocation())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(frames.table(spark, sf_dir, "documents", "text", "lang"))


@query("op12_license_scan")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licenses(frames.table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("detections", lambda d: d["base"])
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    return found.select("doc_id", "n_words", "detections", base.alias("base")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(labels_of(F.col("base")), ",").alias("base_labels"), F.array_join(labels_of(F.col("detections")), ",").alias("labels"), confidence(F.col("detections")).alias("score"))


@query("op13_vector_codes", sql.vector_codes())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress_vectors(frames.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
