"""Operators 11 to 13 against brute-force forms, on awkward rows too."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from creditspark.llm import collocation, license_scan, queries, vector_codes
from creditspark.llm import license_rules as LR

from .helpers import AWKWARD, LOWER, clean_words, docs_of, with_clashes

SF = "/root/testdata/sf0.001"


# --- 11: collocations

def brute_collocations(rows, threshold, longest=4, first=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i: i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    out = {}
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= threshold}
    held = {}
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                held[lang, w[i: i + k]] = max(held.get((lang, w[i: i + k]), 0), a)
    for (lang, w), a in cand.items():
        if 100 * held.get((lang, w), 0) >= 80 * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, xs in out.items() for i, (s, a, p, left, right) in enumerate(sorted(xs)[:first]))


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "é", "中文", "a b", "x-y", "city", "Hall", "in", "z"]
    rows = []
    for _ in range(n):
        out = []
        for _ in range(rng.randrange(30)):
            out.append(rng.choice(["new york city hall", "in the", rng.choice(words), rng.choice(words)]) + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]))
        rows.append(("".join(out), rng.choice(["en", "en", None, "und", ""])))
    return rows + [(t, "en") for _, t in AWKWARD] + [("q q q q q q q q q", "en")] * 4 + [(None, None), ("", "xx")]


def found_collocations(df, **options):
    return sorted(tuple(r) for r in collocation.collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("options", [{"shards": 2}, {"shards": 3, "bits": 4, "chars_per_bucket": 40_000}])
def test_collocations_brute_force(spark, options):
    rows = phrase_rows(1)
    df = with_clashes(spark.createDataFrame(rows, "text string, lang string")).repartition(5)
    want = brute_collocations(rows, 6)
    assert len(want) > 20 and {r[0] for r in want} >= {"en", "und"}
    assert found_collocations(df, threshold=6, **options) == want


def test_collocations_in_files_of_one_shard_each(spark):
    # seven files in four shards: phrases become active in the middle of a cycle
    rows = phrase_rows(2, 60)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    assert found_collocations(df, threshold=5, first=10) == brute_collocations(rows, 5, first=10)


def test_collocations_empty(spark):
    none = spark.createDataFrame([], "text string, lang string")
    assert found_collocations(none, shards=2) == []
    assert found_collocations(spark.createDataFrame([(None, "en"), (" \n", None)], "text string, lang string"), shards=2) == []


def test_collocations_write_small_row_groups(spark, monkeypatch):
    # tasks buffer a batch of texts and a row group: both have to be small from the first row on
    rng, paths, seen = random.Random(3), [], []
    work, encode = collocation.work_path, collocation._encode
    conf = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    monkeypatch.setattr(collocation, "work_path", lambda spark, name: paths.append(work(spark, name)) or paths[-1])
    monkeypatch.setattr(collocation, "_encode", lambda shards: seen.append([int(spark.conf.get(k)) for k in conf]) or encode(shards))
    monkeypatch.setattr(collocation, "ROW_GROUP", 1 << 19)
    rows = [(" ".join(f"{rng.randrange(16**6):06x}" for _ in range(15_000)), "en") for _ in range(20)]
    collocation.prepare(spark)
    before = [spark.conf.get(k) for k in conf]
    phrases, totals = collocation.frequent_phrases(spark.createDataFrame(rows, "text string, lang string").coalesce(1), shards=1)
    assert phrases.count() == 0 and [tuple(r) for r in totals.collect()] == [("en", 300_000)]
    assert max(seen[0]) <= collocation.TEXTS and [spark.conf.get(k) for k in conf] == before
    (file,) = Path(next(x for x in paths if "dic-shards" in x).removeprefix("file:")).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    row = sum(sizes) / meta.num_rows
    assert meta.num_rows == 20 and max(sizes) < 2 * (1 << 19) + 2 * row and len(sizes) >= 5


def test_small_batches_make_whole_slices():
    texts = [None, "", *(f"{i} " * 100 for i in range(50)), "x" * 9_000, "end"]
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[i: i + 3], pa.string()), "lang": pa.array(["en"] * len(texts[i: i + 3]), pa.string())}) for i in range(0, len(texts), 3)]
    joined = list(collocation._joined([batches[0].slice(0, 0), *batches], 5_000))
    assert [t for b in joined for t in b.column(0).to_pylist()] == texts
    assert all(5_000 <= b.nbytes for b in joined[:-1]) and 2 < len(joined) < len(batches)
    assert list(collocation._joined([], 5_000)) == [] and sum(b.num_rows for b in collocation._joined([batches[0].slice(0, 0)], 5_000)) == 0


def test_scores_are_exact(spark):
    big = 3 * 10**17
    phrases = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)], "lang string, phrase string, len int, a long")
    row = collocation.score_phrases(phrases, spark.createDataFrame([("en", 10**18)], "lang string, n long")).collect()
    assert [tuple(r) for r in row] == [("en", "a b", big - 2, big, big - 1, 10**18, 2_000_000 * (big - 2) // (2 * big - 1))]


# --- 12: licenses

def brute_licenses(text, rules):
    words = clean_words(text)
    line = " " + " ".join(words) + " "
    hits = []
    if any(" " + s in line for s in LR.STEMS):
        for i, r in enumerate(rules):
            if all(" " + k in line for k in r.keywords):
                for m in re.finditer(f" (?:{r.pattern})(?= )", line):
                    start = line[: m.start()].count(" ")
                    hits.append((start, start + m.group().count(" "), r.label, r.kind, i, r.base))
    prio = {i: LR.KINDS[rules[i].kind][0] for i in {h[4] for h in hits}}
    kept = [h for h in hits if h[5] or not any(
        e is not h and e[0] <= h[0] and e[1] >= h[1] and prio[e[4]] >= prio[h[4]]
        and (e[:2] != h[:2] or (-prio[e[4]], e[4]) < (-prio[h[4]], h[4])) for e in hits)]
    return len(words), sorted(kept)


LICENSE_TEXTS = [
    "Released under the MIT License.", "under the mit license under the MIT-License (under the  mit license)", "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "This work is licensed under the GNU Lesser General Public License v2.1, not the GNU General Public License.", "SPDX-License-Identifier: GPL-2.0-or-later",
    "# SPDX-License-Identifier: MIT-0\nspdx license identifier mit", "CC BY-NC 4.0 and CC-BY-NC-SA, cc by nc", "see https://www.gnu.org/licenses/gpl-3.0.html", "mit freundlichen Grüßen, keine Lizenz",
    "All rights reserved. under the MIT license", "This is free and unencumbered software released into the public domain", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "BSD 3-Clause License; Apache License 1.1; GPLv3; LGPL v3 or later licence", "Kit license under the Kit license", "under the mıt license", "licensed under the terms of the Mozilla Public License, v. 2.0",
]


def test_licenses_brute_force(spark):
    rules = license_scan.default_rules()
    assert len(rules) > 300 and sum(r.base for r in rules) == 3
    rng = random.Random(3)
    vocabulary = [w for line in LR.SIGNATURES.split("\n") for w in re.findall("[a-z]+", line.lower())] + ["2", "0", "3", "v2"]
    texts = LICENSE_TEXTS + [" ".join(rng.choice([*LICENSE_TEXTS, rng.choice(vocabulary), rng.choice(vocabulary)]) for _ in range(12)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + AWKWARD + [(3, texts[3]), (None, texts[4])]
    got = license_scan.find_licenses(with_clashes(docs_of(spark, rows))).collect()
    key = lambda x: (str(x[0]), x[1], x[2])
    assert sorted(((r.doc_id, r.n_words, [tuple(d) for d in r.detections]) for r in got), key=key) == sorted(((k, *brute_licenses(t, rules)) for k, t in rows), key=key)
    assert license_scan.find_licenses(docs_of(spark, [])).count() == 0


def sample(pattern, rng):
    """A random text that a pattern matches."""
    def one(op, arg):
        op = str(op)
        if op == "LITERAL":
            return chr(arg)
        if op in ("NOT_LITERAL", "ANY"):
            return rng.choice("abc")
        if op == "IN":
            if str(arg[0][0]) == "NEGATE":
                return rng.choice("abc")
            kind, value = rng.choice(arg)
            return chr(value) if str(kind) == "LITERAL" else chr(rng.randint(*value))
        if op == "BRANCH":
            return many(rng.choice(arg[1]))
        if op == "SUBPATTERN":
            return many(arg[3])
        assert op == "MAX_REPEAT", op
        lo, hi, inner = arg
        return "".join(many(inner) for _ in range(rng.randint(lo, min(int(hi), lo + 3))))

    many = lambda items: "".join(one(op, arg) for op, arg in items)
    return many(re._parser.parse(pattern))


def test_license_rules_are_gated():
    """What a rule can match holds its keywords and one of the stems."""
    rng = random.Random(5)
    for r in license_scan.default_rules():
        for _ in range(15):
            text = sample(r.pattern, rng)
            line = " " + " ".join(clean_words(text)) + " "
            assert re.search(f" (?:{r.pattern})(?= )", line), (r, text)
            assert all(" " + k in line for k in r.keywords), (r, text)
            assert any(" " + s in line for s in LR.STEMS), (r, text)


def test_license_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op12(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = clean_words(docs[r.doc_id])
        at = sorted((i, label) for label, p in LR.BASE for i in range(len(w)) if w[i: i + len(p.split())] == p.split())
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        assert r.base_labels == ",".join(sorted({label for _, label in at})) and set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def test_licenses_are_native_and_linear(spark):
    plan = license_scan.find_licenses(docs_of(spark, AWKWARD))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    taken = {}
    for n in (3_000, 3_000, 30_000):
        rows = docs_of(spark, [(1, "Released under the MIT License. " * n)])
        t = time.perf_counter()
        found = license_scan.find_licenses(rows).select(F.size("detections"), "n_words").first()
        taken[n] = time.perf_counter() - t
        assert found[0] >= n and found[1] == 5 * n
    assert taken[30_000] < 15 * taken[3_000] + 5


# --- 13: vector codes

def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(k, label, [math.floor(scale * x) for x in v]) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    if not kept:
        return [], hashlib.sha256(b"").hexdigest()
    kept.sort(key=order)
    width = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == width]
    edges = [width * i // parts for i in range(parts + 1)]
    coded = [["", 0] for _ in kept]
    books = []
    for lo, hi in zip(edges, edges[1:]):
        points = [r[2][lo:hi] for r in kept]
        book = [list(p) for p in points[:entries]]
        near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, e)), i) for i, e in enumerate(book))  # noqa: B023, E731
        for _ in range(rounds):
            at = [near(p)[1] for p in points]
            for e in range(len(book)):
                mine = [p for p, i in zip(points, at) if i == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        for c, p in zip(coded, points):
            d, i = near(p)
            c[0] += f"{i:02x}"
            c[1] += d
        books.append(book)
    sums = Counter()
    for r, c in zip(kept, coded):
        sums[r[1]] += c[1]
    fits = lambda x: x if x < 1 << 63 else None
    out = [(r[0], c[0], fits(c[1]), fits(sums[r[1]])) for r, c in zip(kept, coded)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def vector_rows(seed, n, width, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width)) * spread
    return [(int(i), [float(x) for x in np.float32(centres[i % 5] + 0.2 * spread * rng.normal(size=width))], int(i % 3) if i % 7 else None) for i in rng.permutation(n)]


def found_codes(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).withColumn("part", F.lit(1))
    coded, books = vector_codes.compress_vectors(df, **options)
    return [tuple(r) for r in vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error").collect()], books


@pytest.mark.parametrize(("rows", "options"), [
    (vector_rows(1, 90, 8), {"entries": 7, "block_rows": 8}),
    (vector_rows(2, 60, 10), {"entries": 256, "rounds": 2}),  # fewer rows than entries, parts of two and three components
    (vector_rows(3, 40, 3), {"entries": 5, "block_rows": 4}),  # an empty part
    (vector_rows(4, 60, 8) + [(500 + i, [0.5] * 8, 1) for i in range(60)] + [(7, [0.25] * 8, None)] * 3, {"entries": 9, "block_rows": 16}),  # copies, ties, repeated keys
    (vector_rows(5, 30, 4, spread=1e5), {"entries": 4, "block_rows": 4}),  # beyond what doubles hold exactly
    (vector_rows(5, 30, 4, spread=1e9), {"entries": 4, "block_rows": 4}),  # beyond 64 bits
    ([(i, [float(i % 2)] * 4, 0) for i in range(20)], {"entries": 3, "block_rows": 5}),  # every distance ties
])
def test_codes_brute_force(spark, rows, options):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got, books = found_codes(spark, rows, **options)
    options = {k: v for k, v in options.items() if k != "block_rows"}
    want, sha = brute_codes(rows, **options)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert books.sha256() == sha


def test_codes_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = vector_rows(6, 25, 8) + [(100, None, 1), (101, [nan] * 8, 1), (102, [inf] + [0.0] * 7, 1), (103, [0.0] * 7 + [-inf], 1), (104, [0.0] * 7 + [None], 1), (105, [], 1),
                                    (106, [0.0] * 9, 1), (None, [0.1] * 8, None), (None, [0.1] * 8, None)]
    got, books = found_codes(spark, rows, entries=6)
    want, sha = brute_codes(rows, entries=6)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key) and books.sha256() == sha
    first = next(r for r in got if r[0] == 0)
    assert len(books.decode(first[1])) == 8
    for none in ([], [(1, None, 1)]):
        got, books = found_codes(spark, none)
        assert got == [] and books.sha256() == hashlib.sha256(b"").hexdigest()


def test_hilbert_curve_visits_neighbours():
    for d, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d, indexing="ij"), -1).reshape(-1, d)
        keys = vector_codes.hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(1 << (bits * d)))
        steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_shortlist_holds_every_nearest_entry():
    rng = np.random.default_rng(8)
    for _ in range(200):
        points, book = rng.integers(-20, 20, size=(9, 3)), rng.integers(-30, 30, size=(12, 3))
        short = vector_codes.shortlist(points.min(0), points.max(0), book)
        d = vector_codes.squared_distances(points, book)
        assert set(d.argmin(1)) <= set(short)
        assert (vector_codes._nearest(points, short, book)[0] == d.argmin(1)).all()
