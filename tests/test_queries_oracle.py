"""Every registered query with a SQL twin must equal DuckDB on the small tables."""

import hashlib
import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from creditspark.sources.tables import TABLES

from .conftest import SF_SMALL

SQL = entry.oracle_sql()


def _norm(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 9)) if not math.isinf(v) else str(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def _digest(df):
    cols = sorted(df.columns)
    rows = sorted("|".join(_norm(v) for v in r) for r in df[cols].itertuples(index=False, name=None))
    return len(df), cols, hashlib.sha1("\n".join(rows).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    sp = entry.queries()[name](spark, SF_SMALL).toPandas()
    dd = con.execute(SQL[name]).df()
    assert _digest(sp) == _digest(dd)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["income_group", "n_good", "n_bad", "n_total", "default_rate"]
    assert df.count() > 0
