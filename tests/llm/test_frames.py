"""Key ranges hold about the wanted number of characters."""

import random

import pytest
from pyspark.sql import functions as F

from creditspark.llm import frames

from .helpers import docs_of


def sizes(spark, rows, wanted):
    df = docs_of(spark, rows).repartition(6)
    bounds = frames.range_bounds(df, "doc_id", "text", wanted)
    assert bounds == sorted(set(bounds))
    got = df.groupBy(frames.range_index(F.col("doc_id"), bounds).alias("r")).agg(F.sum(F.length("text")).alias("n")).collect()
    return [r.n or 0 for r in sorted(got)]


def test_long_texts_that_stand_together(spark):
    rows = [(i, "x" * (3000 if i < 400 else 100)) for i in range(4000)]
    total = sum(len(t) for _, t in rows)
    found = sizes(spark, rows, 50_000)
    assert max(found) <= 2 * 50_000 and total / 50_000 <= len(found) <= 3 * total / 50_000


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_lengths(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(10**9), "x" * int(rng.expovariate(1 / 200))) for _ in range(3000)] + [(None, "y" * 10)] * 5
    found = sizes(spark, rows, 30_000)
    assert max(found) <= 2 * 30_000 and len(found) <= 3 * sum(len(t) for _, t in rows) / 30_000 + 1


def test_few_rows(spark):
    assert sizes(spark, [(1, "x" * 1000)], 10) == [1000]
    assert sizes(spark, [(None, "abc"), (None, None)], 1) == [3]
    assert frames.range_bounds(docs_of(spark, []), "doc_id", "text", 10) == []
    assert sizes(spark, [(1, "x" * 100), (2, "x" * 100), (3, None)], 100) in ([100, 100], [100, 100, 0])
