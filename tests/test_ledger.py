"""M2's ledger: killed and limited runs add up to the whole grid, with the results of one run."""

import math

import numpy as np
import pytest

from creditspark.operators import models as M
from creditspark.operators.ledger import data_digest
from creditspark.session import shared_path

from .conftest import SF_SMALL

GRID = {"learning_rate": [0.1, 0.3], "max_depth": [2], "n_estimators": [2, 4]}
FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=240) > 0).astype(int)
    return spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y)], "a double, b double, loan_status int").coalesce(1)


def search(rows, ledger=None, max_fits=None):
    model, table = M.grid_search(rows, FEATURES, grid=GRID, folds=2, parallelism=2, ledger=ledger, max_fits=max_fits)
    return model, [tuple(r) for r in table.orderBy("setting").collect()]


@pytest.fixture
def fits(monkeypatch):
    """Counts fits; raises at the fit whose number stands in ``at``."""
    made, real = {"n": 0, "at": None}, M.gbt_pipeline

    def counted(*a, **k):
        made["n"] += 1
        if made["n"] == made["at"]:
            raise RuntimeError("killed")
        return real(*a, **k)

    monkeypatch.setattr(M, "gbt_pipeline", counted)
    return made


def test_killed_run_goes_on(spark, rows, fits):
    _, whole = search(rows)
    assert len(whole) == 4 and all(r[-1] is not None for r in whole)
    ledger = shared_path(spark, "tests", "ledger", unique=True)
    fits.update(n=0, at=3)
    with pytest.raises(RuntimeError):
        search(rows, ledger)
    done = spark.read.parquet(f"{ledger}/*").count()
    assert 0 < done < 8
    fits.update(n=0, at=None)
    model, again = search(rows, ledger)
    assert model is not None and again == whole
    # four fits in all (two settings, two folds), each of two numbers of rounds, then the winner on all rows
    assert fits["n"] == 4 - done // 2 + 1
    fits.update(n=0)
    assert search(rows, ledger)[1] == whole and fits["n"] == 1
    table = spark.read.parquet(f"{ledger}/*")
    assert table.count() == 8 and table.dropDuplicates(["setting", "fold", "n_estimators"]).count() == 8


def test_limited_runs_add_up(spark, rows):
    ledger = shared_path(spark, "tests", "ledger", unique=True)
    seen = []
    for _ in range(4):
        model, table = search(rows, ledger, max_fits=1)
        seen.append(sum(r[-1] is not None for r in table))
        assert (model is not None) == (seen[-1] == 4)
    assert seen == [0, 2, 2, 4] and table == search(rows)[1]


def test_other_data_starts_anew(spark, rows):
    ledger = shared_path(spark, "tests", "ledger", unique=True)
    search(rows, ledger)
    other = rows.where("a < 1.5")
    assert search(other, ledger)[1] == search(other)[1]
    assert spark.read.parquet(f"{ledger}/*").select("digest").distinct().count() == 2


def test_digest(spark, rows):
    assert data_digest(rows) == data_digest(rows.repartition(7))
    assert data_digest(rows) != data_digest(rows.union(rows.limit(1)))
    a = spark.createDataFrame([(None, 1), (2, 3)], "x int, y int")
    b = spark.createDataFrame([(1, None), (2, 3)], "x int, y int")
    assert data_digest(a) != data_digest(b)


def test_the_grid_query_works_through_the_whole_grid(spark, monkeypatch):
    """F16: no subset of settings, rounds or folds."""
    from types import SimpleNamespace

    from creditspark.plans import model_queries as Q

    asked = {}

    def search(train, features, label, grid=None, folds=5, **_):
        asked.update(grid=grid or M.GBT_GRID, folds=folds, settings=math.prod(map(len, (grid or M.GBT_GRID).values())))
        return None, spark.createDataFrame([(0, 0.5)], "setting int, cv_accuracy double")

    monkeypatch.setattr(Q.J, "prepare_classifier", lambda *_, **__: SimpleNamespace(balanced=None, features=[]))
    monkeypatch.setattr(Q.M, "grid_search", search)
    Q.q_gbt_grid(spark, SF_SMALL)
    assert asked == {"grid": M.GBT_GRID, "folds": 5, "settings": 288}
