"""DataFrame helpers of the operators: ranges of a key, working folders."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditspark.session import shared_path, ship_package
from creditspark.sources import read_table


#: Rows of an Arrow batch: texts may have tens of thousands of characters, and several batches are in memory at once.
BATCH_ROWS = 1000
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Before an operator with Python inside: ship the package, keep Arrow batches of texts small (a smaller setting stays)."""
    ship_package(spark)
    rows = int(spark.conf.get(_BATCH_KEY, "10000"))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it Parquet and Arrow batches have at most ``rows`` rows, for tables whose rows are some 100 KB each."""
    keys = (_BATCH_KEY, "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(k) for k in keys]
    try:
        for k in keys:
            spark.conf.set(k, str(rows))
        yield
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, sf_dir, name, list(columns) or None)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for one written table, below the shared checkpoint folder."""
    return shared_path(spark, "llm", name, unique=True)


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and held on the executors' disks, two copies on a cluster; cuts the lineage and goes when nothing reads it any more.

    For narrow tables of a few numbers a row that later steps of the same run read. Unlike a written table it makes no files: Hadoop's local
    file system starts a process (chmod) for each file's rights, and until that process is running it counts as a second JVM of full size.
    """
    alone = re.fullmatch(r"local(\[[^\]]*\])?", df.sparkSession.sparkContext.master)
    return df.localCheckpoint(True, StorageLevel.DISK_ONLY if alone else StorageLevel.DISK_ONLY_2)


def remove_path(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


#: key ranges of equal row numbers that are measured, for each range that is wanted
FINE = 16


def range_bounds(df: DataFrame, key: str, text: str, chars_per_range: int) -> list[int]:
    """Upper bounds (exclusive of the last range) that cut ``key`` into ranges of about ``chars_per_range`` characters.

    Characters are summed over FINE times as many ranges of equal row numbers, and these are joined up to the wanted size: long texts that
    stand together get ranges of their own. Only a fine range that is larger by itself (one key with very many or very long
    texts) exceeds it. The driver holds FINE numbers per range, which grows with the input divided by the range size.
    """
    size = F.coalesce(F.length(text), F.lit(0)).cast("long")
    total, rows = df.agg(F.sum(size), F.count(key)).first()
    n = math.ceil((total or 0) / chars_per_range)
    if n < 2 or rows < 2:
        return []
    n *= FINE
    fine = sorted(set(df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 5 * n))).first()[0]))
    sizes = {r[0]: r[1] for r in df.groupBy(range_index(F.col(key), fine).alias("at")).agg(F.sum(size)).collect()}
    bounds, held = [], 0
    for i, bound in enumerate(fine):
        held += sizes.get(i, 0)
        if held + sizes.get(i + 1, 0) > chars_per_range:
            bounds.append(bound)
            held = 0
    return bounds


def range_index(key: Column, bounds: list[int]) -> Column:
    """Number of bounds below the key: two-level search in literal arrays; null comes first."""
    if not bounds:
        return F.lit(0)
    width = math.ceil(math.sqrt(len(bounds)))
    groups = [bounds[i: i + width] for i in range(0, len(bounds), width)]
    tops = F.lit([g[-1] for g in groups])
    outer = F.size(F.filter(tops, lambda b: b < key))
    inner = F.get(F.lit(groups + [[]]), outer)
    place = outer * width + F.size(F.filter(inner, lambda b: b < key))
    return F.when(key.isNull(), 0).otherwise(place)
