"""Operators 5 and 9 against plain-Python scores, and their bounded samples under repeated keys; spans of texts with many matches."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditspark.llm import langid, pii, quality, secret_scan

from .helpers import docs_of

ASCII = re.compile("[^a-z\x80-\xff]+")


# --- 5: Bradley-Terry

def plain_bradley_terry(pairs, l2, rounds=4000, rate=0.5):
    """Gradient steps on the mean of log(1 + exp(-w . (preferred - other))) plus the ridge, one number at a time."""
    w = [0.0] * len(pairs[0])
    for _ in range(rounds):
        step = [-l2 * x for x in w]
        for d in pairs:
            p = 1 / (1 + math.exp(sum(a * b for a, b in zip(w, d))))
            for i, x in enumerate(d):
                step[i] += p * x / len(pairs)
        w = [a + rate * b for a, b in zip(w, step)]
    return w


def test_pairwise_weights_are_those_of_plain_steps():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(14, 3))
    y = (x[:, 0] - x[:, 1] + rng.normal(size=14) > 0).astype(int)
    model = quality.fit_pairs(x, y, per_document=3, l2=0.05)
    z = (x - x.mean(0)) / x.std(0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    deal, n = np.random.default_rng(7), max(len(good), len(bad)) * 3
    first, second = deal.permutation(np.resize(good, n)), deal.permutation(np.resize(bad, n))
    plain = plain_bradley_terry([[float(a - b) for a, b in zip(z[g], z[d])] for g, d in zip(first, second)], 0.05)
    assert np.allclose(model.weights, plain, atol=1e-3)
    for row, score in zip(x, model.score(x)):
        raw = sum((v - c) / s * w for v, c, s, w in zip(row, x.mean(0), x.std(0), plain)) - model.cut + math.log(0.3 / 0.7)
        assert score == pytest.approx(1 / (1 + math.exp(-raw)), abs=2e-3)


def test_quality_sample_is_bounded(spark, monkeypatch):
    """A third of the labels and of the documents have one key."""
    rows = [(1, f"same key {i} " * 5) for i in range(40)] + [(i, f"other text {i} and more") for i in range(2, 80)]
    labels = spark.createDataFrame([(1, 1)] * 40 + [(i, i % 2) for i in range(2, 80)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "fit_pairs", lambda x, y, q=None: seen.append((len(x), sorted(y))))
    docs = docs_of(spark, rows + rows[:40])
    for bound in (10, 50, 1000):
        quality.fit_quality(docs, labels, max_labelled=bound)
        quality.fit_quality(docs.repartition(5), labels.repartition(3), max_labelled=bound)
        assert seen[-1] == seen[-2] and seen[-1][0] <= bound
    assert seen[-1][0] == 40 + 78  # repeated rows and repeated labels teach once


# --- 9: nearest centroids

def plain_counts(text, dims):
    """Hashed byte trigrams of a text, with one space for each run of other bytes and at both ends."""
    line = " " + ASCII.sub(" ", (text or "").encode().decode("latin-1").translate({c: c + 32 for c in range(65, 91)})) + " "
    line = re.sub(" +", " ", line)
    return Counter(((((ord(a) << 16 | ord(b) << 8 | ord(c)) * 2654435761) % 2**32) >> 16) % dims for a, b, c in zip(line, line[1:], line[2:]))


def plain_vector(text, idf):
    v = {s: math.log1p(n) * float(idf[s]) for s, n in plain_counts(text, len(idf)).items()}
    norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
    return {s: x / norm for s, x in v.items()}


def test_language_scores_are_plain_cosines(spark):
    rng = random.Random(4)
    words = {"en": "the and of thing with other", "fr": "été où ça déjà même leur", "de": "und über größe nicht mit"}
    rows = [(i, " ".join(rng.choices(words[w].split(), k=12)), w) for i, w in enumerate(["en", "fr", "de"] * 8)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_languages(learn, dims=512)
    n = len(rows)
    df = Counter(s for _, t, _ in rows for s in plain_counts(t, 512))
    assert np.allclose(model.idf, [math.log((1 + n) / (1 + df[s])) + 1 for s in range(512)], atol=1e-5)
    texts = [t for _, t, _ in rows[:6]] + ["The Thing, über ça!", "x", "nicht 12 nicht"]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, list(enumerate(texts))), model).select("doc.doc_id", "lang_pred", "score").collect()}
    for i, text in enumerate(texts):
        v = plain_vector(text, model.idf)
        cosines = [sum(x * float(c[s]) for s, x in v.items()) for c in model.centroids]
        best = max(range(len(cosines)), key=lambda j: (round(cosines[j], 6), -j))
        assert got[i].score == pytest.approx(max(0.0, min(1.0, cosines[best])), abs=1e-4)
        assert cosines[best] - max((c for c, o in zip(cosines, model.owner) if o != model.owner[best]), default=0) < 1e-4 or got[i].lang_pred == model.languages[model.owner[best]]


def test_language_sample_is_bounded(spark, monkeypatch):
    seen, real = [], langid.cluster
    monkeypatch.setattr(langid, "cluster", lambda v, k, rounds=15: seen.append(len(v)) or real(v, k, rounds))
    rows = [(1, f"the thing {i}", "en") for i in range(60)] + [(i, f"the other thing {i}", "en") for i in range(2, 40)] + [(i, "ça déjà", "fr") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for frame in (docs, docs.repartition(6)):
        langid.fit_languages(frame, sample=7, dims=256)
        langid.fit_languages(frame, sample=1000, dims=256)
    assert seen[:4] == seen[4:] == [7, 3, 39, 3]


# --- 6 and 8: many matches in one text

def log_text(n):
    return "".join(f"host{i % 97} 10.0.{i % 250}.{i % 240} password=abc{i % 1000:06d} user{i % 50}@mail.example.org\n" for i in range(n))


def taken(make, sizes=(1_000, 1_000, 10_000)):
    out = {}
    for n in sizes:
        t = time.perf_counter()
        out[n] = make(n), time.perf_counter() - t
    return out


def test_many_mentions_in_one_text_are_linear(spark):
    found = taken(lambda n: pii.find_personal_data(docs_of(spark, [(1, log_text(n))])).select(F.size("base")).first()[0])
    assert found[1_000][0] == 2_000 and found[10_000][0] == 20_000
    assert found[10_000][1] < 15 * found[1_000][1] + 5


def test_many_secrets_in_one_text_are_linear(spark, tmp_path):
    def run(n):
        out = secret_scan.redact_secrets(docs_of(spark, [(1, log_text(n))]), f"{tmp_path}/ledger-{n}-{time.time()}").first().text
        return hashlib.sha256(out.encode()).hexdigest(), out.count("[ASSIGN]")
    found = taken(run)
    assert found[10_000][0][1] == 10_000
    assert found[10_000][0][0] == hashlib.sha256(re.sub(r"password=abc[0-9]{6}", "[ASSIGN]", log_text(10_000)).encode()).hexdigest()
    assert found[10_000][1] < 15 * found[1_000][1] + 5


def test_contexts_of_glued_and_overlapping_mentions(spark):
    """Terms beside mentions that share a word, follow each other without a blank, or hold blanks."""
    texts = ["alpha a@b.co,c@d.co omega", "see(10.0.0.1)end +1 (555) 010 2030 call", "x +49 30 10.11.12.13 45 y", "a@b.co", "  lead\na@b.co\ttail  ", "one two three four five six a@b.co seven"]
    rows = pii.find_base(docs_of(spark, list(enumerate(texts))), "doc_id", "text", 2).select("key", "mentions", "near").collect()
    for r in rows:
        text, want = texts[r.key], set()
        covered = set()
        for m in r.mentions:
            covered |= set(range(m.start, m.end))
        marked = "".join("￿" if i in covered and not c.isspace() else c for i, c in enumerate(text))
        for m in r.mentions:
            before, after = re.split(r"\s+", marked[: m.start]), re.split(r"\s+", marked[m.end:])
            whole = [w for w in before[:-1] if w][-2:] + [w for w in after[1:] if w][:2]
            parts = [before[-1].split("￿")[-1], after[0].split("￿")[0]]
            for w in [w for w in whole if "￿" not in w] + parts:
                term = re.sub(r"^\W+|\W+$", "", w.lower())
                if re.search(r"[^\W\d_]", term):
                    want.add(f"{term} {m.entity}")
        assert set(r.near) == want, (text, r.near, want)
