"""Stages and bundles that are replaced as a whole."""

import os
import shutil

import pytest

from creditspark.operators import features as Fe
from creditspark.plans import jobs as J
from creditspark.session import shared_path
from creditspark.sources import versions
from creditspark.sources.files import read_stage, write_stage


def place(spark):
    return shared_path(spark, "tests", "versions", unique=True)


def test_reader_keeps_its_rows(spark):
    path = place(spark)
    write_stage(spark.range(10), "s", path)
    before = read_stage(spark, "s", path)
    # the new version is made out of the one that it replaces
    write_stage(before.selectExpr("id + 100 AS id").limit(4), "s", path)
    assert sorted(r.id for r in before.collect()) == list(range(10))
    assert read_stage(spark, "s", path).count() == 4 and read_stage(spark, "s", path).agg({"id": "min"}).first()[0] >= 100


def test_failed_write_leaves_the_stage(spark):
    path = place(spark)
    write_stage(spark.range(3), "s", path)
    with pytest.raises(Exception):
        write_stage(spark.range(3).selectExpr("raise_error('stop') AS id"), "s", path)
    assert read_stage(spark, "s", path).count() == 3
    with pytest.raises(FileNotFoundError):
        read_stage(spark, "s", place(spark))


def bundle(shift: float) -> J.ClusterBundle:
    return J.ClusterBundle(Fe.ScalerModel({"a": shift, "b": 0.0}, {"a": 1.0, "b": 2.0}), Fe.PCAModel2(["a", "b"], [[1.0, 0.0], [0.0, 1.0]], [2.0, 1.0]), {0: [shift, 0.0], 1: [5.0, 5.0]})


def content(b: J.ClusterBundle):
    return b.scaler, dict(zip(b.pca.columns, zip(*b.pca.loadings))), b.centroids


def test_bundle_is_replaced_as_a_whole(spark, monkeypatch):
    path = place(spark)
    bundle(1.0).save(spark, path)
    real = J.M.centroids_df
    monkeypatch.setattr(J.M, "centroids_df", lambda *a: 1 / 0)  # scaler and loadings are written, centroids are not
    with pytest.raises(ZeroDivisionError):
        bundle(2.0).save(spark, path)
    assert content(J.ClusterBundle.load(spark, path)) == content(bundle(1.0))
    monkeypatch.setattr(J.M, "centroids_df", real)
    bundle(3.0).save(spark, path)
    assert content(J.ClusterBundle.load(spark, path)) == content(bundle(3.0))


def test_changed_files_are_not_loaded(spark):
    path = place(spark)
    bundle(1.0).save(spark, path)
    folder = versions.current(spark, path)
    assert versions.current(spark, path, check=True) == folder
    local = folder.removeprefix("file:")
    part = next(os.path.join(d, n) for d, _, names in os.walk(f"{local}/pca") for n in names if n.startswith("part-"))
    shutil.copy(part, f"{local}/pca/part-one-more.parquet")
    with pytest.raises(ValueError):
        J.ClusterBundle.load(spark, path)
