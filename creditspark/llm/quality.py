"""Quality classifier: Bradley-Terry pairwise ranking of documents by features of their whole text.

A bounded, documented sample of labelled documents gives preference pairs (a good document is preferred to a bad one).
The score of a document is linear in its features; the weights minimise the logistic loss of feature differences over
the pairs. A document passes if its score reaches a quantile of the sample's scores, by default the one that splits off
as large a share as the labels reject. ``score`` maps that cut to 0.3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .frames import prepare

CUT = 0.3
FEATURES = ("log_words", "word_bytes", "symbols", "symbol_words", "marks", "pipes", "exclamations", "upper_letters", "upper_words", "digits",
            "repeated_words", "distinct_words", "line_ends", "long_words")

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 usual marks, 5 other ASCII signs, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 4 if chr(_c) in ".,;:'\"()-?" else 5


def text_features(offsets: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document; an empty text has zeros."""
    words = A.Words(offsets, raw)
    n_docs, n = len(offsets) - 1, len(words.start)
    out = np.zeros((n_docs, len(FEATURES)))
    if not n:
        return out
    doc = np.repeat(np.arange(n_docs), words.n_words)
    kinds = _CLASS[words.buf]

    def up_to(flag: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flag)])

    at = words.doc_end
    begin = np.concatenate([[0], at[:-1] + 1])
    size = np.maximum(at - begin, 1)

    def per_byte(flag: np.ndarray, by: np.ndarray | int) -> np.ndarray:
        total = up_to(flag)
        return (total[at] - total[begin]) / by

    def per_word(flag: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flag, n_docs) / np.maximum(words.n_words, 1)

    def inside(flag: np.ndarray) -> np.ndarray:
        total = up_to(flag)
        return total[words.end] - total[words.start]

    length = words.end - words.start
    lower, upper, signs = inside(kinds == 1), inside(kinds == 2), inside(kinds == 5)
    letters = per_byte((kinds == 1) | (kinds == 2) | (kinds == 6), 1)
    h = words.hashes()
    again = np.zeros(n, bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((h, doc))
    fresh = np.ones(n, bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    columns = (np.log1p(words.n_words), np.minimum(per_word(length), 50) / 10, per_byte(kinds == 5, size), per_word(signs > 0), per_byte(kinds == 4, size),
               per_byte(words.buf == 124, np.maximum(words.n_words, 1)), per_byte(words.buf == 33, np.maximum(words.n_words, 1)),
               per_byte(kinds == 2, np.maximum(letters, 1)), per_word((upper > 1) & (lower == 0)), per_byte(kinds == 3, size),
               per_word(again), np.bincount(doc[order], fresh, n_docs) / np.maximum(words.n_words, 1), per_byte(words.buf == 10, np.maximum(words.n_words, 1)), per_word(length > 30))
    out[:] = np.stack(columns, 1)
    # shares also as square roots, so that small ones stand out
    out[:, 2:] = np.sqrt(np.clip(out[:, 2:], 0, None))
    return out


@dataclass(frozen=True)
class QualityModel:
    """Linear Bradley-Terry score over standardised features, and the score at the quantile cut."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def raw(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.centre) / self.spread) @ self.weights

    def score(self, features: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the quantile."""
        z = np.clip(self.raw(features) - self.cut, -60, 60) + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-z))


def fit_pairs(features: np.ndarray, labels: np.ndarray, quantile: float | None = None, per_document: int = 8, l2: float = 1e-3, rounds: int = 30) -> QualityModel:
    """Newton steps on the mean logistic loss of (preferred - other) feature differences.

    Each labelled document meets ``per_document`` of the other label, dealt round robin, so pairs are linear in the sample.
    Without both labels there are no pairs: all weights are 0 and everything passes.
    """
    centre, spread = features.mean(0) if len(features) else np.zeros(len(FEATURES)), features.std(0) if len(features) else np.ones(len(FEATURES))
    spread = np.where(spread > 1e-9, spread, 1.0)
    x = (features - centre) / spread
    good, bad = np.flatnonzero(labels == 1), np.flatnonzero(labels == 0)
    w = np.zeros(features.shape[1])
    if not len(good) or not len(bad):
        return QualityModel(centre, spread, w, 0.0)
    rng = np.random.default_rng(7)
    n = max(len(good), len(bad)) * per_document
    diff = x[rng.permutation(np.resize(good, n))] - x[rng.permutation(np.resize(bad, n))]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(diff @ w, -60, 60)))  # chance that the pair is ordered wrongly
        step = np.linalg.solve((diff * (p * (1 - p))[:, None]).T @ diff / n + l2 * np.eye(len(w)), diff.T @ p / n - l2 * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.sort(x @ w)
    at = (len(bad) / len(labels) if quantile is None else quantile) * len(scores)
    lo, hi = scores[max(0, min(len(scores) - 1, int(at) - 1))], scores[min(len(scores) - 1, int(at))]
    return QualityModel(centre, spread, w, float(lo + hi) / 2)


def _features(limit: int = 1_000_000):
    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = A.utf8(batch.column(1))
            for lo, hi in A.cuts(offsets, limit):
                f = text_features(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]])
                values = A.list_array(np.arange(0, f.size + 1, f.shape[1]), pa.array(f.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), values], ["label", "h", "features"])
    return features


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", quantile: float | None = None,
                max_labelled: int = 20_000) -> QualityModel:
    """Learns from a sample of the labelled documents.

    ``max_labelled`` bounds it exactly: of more (key, label) pairs those with the smallest key hashes are taken, and of more documents
    with these keys those with the smallest hashes of key and text. Rows with a null key or label teach nothing; repeated label rows and
    repeated rows of a key and text teach once, so one key that holds a third of either table is one pair or a few. Only text is read from ``docs``.
    """
    prepare(docs.sparkSession)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).dropna().distinct()
    if known.count() > max_labelled:
        known = known.orderBy(F.xxhash64("key"), "key", "label").limit(max_labelled)
    # at most max_labelled rows of two numbers: a proven bound for the broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key").select("label", "text", F.xxhash64("key", "text").alias("h"))
    found = rows.mapInArrow(_features(), "label int, h long, features array<double>").dropDuplicates(["h", "label"])
    got = sorted((r.label, r.features) for r in found.orderBy("h", "label").limit(max_labelled).collect())  # any partitioning gives the same model
    x = np.array([f for _, f in got]).reshape(len(got), len(FEATURES))
    return fit_pairs(x, np.array([y for y, _ in got], int), quantile)


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", limit: int = 1_000_000) -> DataFrame:
    """``doc`` (struct of the columns of ``docs``, so names cannot clash) and ``score`` of each row, in one narrow pass.

    Null and empty texts have all-zero features and a score like any other; one very long text is scored whole.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"), F.col(text).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, raw = A.utf8(batch.column(1))
            for lo, hi in A.cuts(offsets, limit):
                s = model.score(text_features(offsets[lo: hi + 1] - offsets[lo], raw[offsets[lo]: offsets[hi]]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(s)], ["doc", "score"])

    return rows.mapInArrow(score, f"doc {rows.schema['doc'].dataType.simpleString()}, score double")


def filter_quality(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows whose score reaches the cut, with the columns of ``docs``."""
    return score_quality(docs, model, text).where(F.col("score") >= CUT).select("doc.*")
