"""Language ID by nearest centroid: TF-IDF vectors of character trigrams against several clustered centroids a language.

A text's letters (lower case, everything else a space) give byte trigrams, hashed into ``dims`` counters. Document
frequencies come from all learning rows; the centroids from a bounded sample of them (``sample`` documents a language),
clustered by spherical k-means. A document takes the language of the centroid with the largest cosine; one that is farther
from it than almost all sample documents of that language are from theirs is marked as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays as A
from .frames import prepare

DIMS = 4096
UNKNOWN = "und"
_LETTER = np.full(256, A.SPACE, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def trigram_counts(offsets: np.ndarray, raw: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(documents, dims) counts of hashed byte trigrams; runs of other characters count as one space."""
    n_docs = len(offsets) - 1
    buf = np.full(len(raw) + 2 * n_docs, A.SPACE, np.uint8)  # a space on both sides of each document
    keep = np.ones(len(buf), bool)
    begin = offsets[:-1] + 2 * np.arange(n_docs)
    keep[begin] = keep[offsets[1:] + 2 * np.arange(n_docs) + 1] = False
    buf[keep] = _LETTER[raw]
    doc = np.repeat(np.arange(n_docs), np.diff(offsets) + 2)
    solid = np.ones(len(buf), bool)
    solid[1:] = (buf[1:] != A.SPACE) | (buf[:-1] != A.SPACE) | (doc[1:] != doc[:-1])
    buf, doc = buf[solid].astype(np.uint32), doc[solid]
    code = (buf[:-2] << 16) | (buf[1:-1] << 8) | buf[2:]
    same = doc[:-2] == doc[2:]
    slot = ((code * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(dims)
    return np.bincount(doc[:-2][same] * dims + slot[same], minlength=n_docs * dims).reshape(n_docs, dims)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # one normalised row each
    owner: np.ndarray  # language of each row
    reach: np.ndarray  # smallest cosine that is not rejected, per language

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return tfidf(counts, self.idf)


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts).astype(np.float32) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def cluster(v: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from farthest-first seeds; deterministic."""
    centres = [v.mean(0)]
    for _ in range(1, min(k, len(v))):
        near = np.max(v @ np.array(centres).T, axis=1)
        centres.append(v[int(np.argmin(near))])
    c = np.array(centres, np.float32)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        at = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[at == i].mean(0) if (at == i).any() else c[i] for i in range(len(c))])
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def fit_languages(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 500, clusters: int = 4, reject: float = 0.001, dims: int = DIMS) -> LanguageModel:
    """Learns from every row with a non-null language and a text; ``sample`` bounds the documents a language for the clusters.

    Of a language with more keys the ``sample`` ones with the smallest hashes are clustered, each with the first of its texts, so
    repeated keys do not widen the sample. ``reject``: share of the sample that may fall
    outside a language's reach. No learning rows: a model without languages, which answers 'und'.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in batches:
            offsets, raw = A.utf8(batch.column(0))
            for lo, hi in A.cuts(offsets, 1_000_000):
                total += (trigram_counts(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]], dims) > 0).sum(0)
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims), pa.int32()), pa.array(np.concatenate([[n], total]))], ["slot", "n"])

    found = rows.select("text").mapInArrow(frequencies, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(dims + 1)
    for r in found:
        df[r.slot] = r.n  # slot -1, the last, counts the documents
    idf = (np.log((1 + df[-1]) / (1 + df[:-1])) + 1).astype(np.float32)
    keyed = rows.withColumn("h", F.xxhash64("key"))
    first = keyed.select("lang", "h").distinct().withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= sample)
    last = {r.lang: r.h for r in first.groupBy("lang").agg(F.max("h").alias("h")).collect()}  # one row a language
    if not last:
        return LanguageModel([], idf, np.zeros((0, dims), np.float32), np.zeros(0, int), np.zeros(0))
    bound = F.create_map(*(x for name, h in sorted(last.items()) for x in (F.lit(name), F.lit(h))))
    some = keyed.where(F.col("h") <= bound[F.col("lang")]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = A.utf8(batch.column(1))
            for lo, hi in A.cuts(offsets, 1_000_000):
                v = tfidf(trigram_counts(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]], dims), idf).astype("<f4")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in v], pa.binary())], ["lang", "v"])

    got: dict[str, list[bytes]] = {}
    for r in some.mapInArrow(vectors, "lang string, v binary").collect():
        got.setdefault(r.lang, []).append(bytes(r.v))
    languages, parts, owner, reach = sorted(got), [], [], []
    for i, name in enumerate(languages):
        v = np.frombuffer(b"".join(sorted(got[name])), "<f4").reshape(-1, dims)
        c = cluster(v, clusters)
        parts.append(c)
        owner += [i] * len(c)
        reach.append(float(np.quantile(np.max(v @ c.T, axis=1), reject)))
    return LanguageModel(languages, idf, np.concatenate(parts) if parts else np.zeros((0, dims), np.float32), np.array(owner, int), np.array(reach))


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``doc`` (struct of the columns of ``docs``, so names cannot clash), ``lang_pred``, ``score`` (cosine, 0 to 1) and
    ``rejected`` (too far from every centroid of that language), in one narrow pass.

    Null text or text without a letter: 'und' with score 0, rejected. Ties go to the first language by name.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = len(model.idf)
        for batch in batches:
            texts = batch.column(1)
            offsets, raw = A.utf8(texts)
            total = np.concatenate([[0], np.cumsum(ascii_letter[raw])])
            for lo, hi in A.cuts(offsets, 1_000_000):
                letters = (total[offsets[lo + 1: hi + 1]] - total[offsets[lo: hi]]) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = has_letter(texts[lo + int(i)].as_py())
                if model.languages:
                    cos = model.vectors(trigram_counts(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]], dims)) @ model.centroids.T
                    best = np.argmax(cos, axis=1)
                    lang, score = model.owner[best], np.clip(cos[np.arange(len(best)), best].astype(float), 0, 1)
                    far = score < model.reach[lang]
                else:
                    letters[:] = False
                    lang, score, far = np.zeros(hi - lo, int), np.zeros(hi - lo), np.ones(hi - lo, bool)
                names = [model.languages[x] if ok else UNKNOWN for x, ok in zip(lang, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(far | ~letters)],
                                                 ["doc", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(label, f"doc {rows.schema['doc'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")
