import os
import tempfile

import pytest
from pyspark.sql import functions as F

from creditspark.operators import evaluate as V
from creditspark.operators import models as M
from creditspark.operators import features as Fe
from creditspark.plans import jobs as J
from creditspark.plans import prepare as PR
from creditspark.session import shared_path
from creditspark.sources import KEY, LABEL, loan_book
from creditspark.sources.files import read_stage
from creditspark.streaming import start_scoring_stream

from .conftest import SF_SMALL


@pytest.fixture(scope="module")
def bundles(spark):
    run = shared_path(spark, "tests", "bundles", unique=True)
    lb = loan_book(spark, SF_SMALL)
    clf, scored = J.train_classifier(lb, run, n_estimators=10, max_depth=3)
    clu, pts = J.train_clusterer(read_stage(spark, "data_outlier", f"{run}/data_outlier"), run, k=4)
    return lb, clf, scored, clu, pts, run


def test_classifier_scores_test_rows(bundles):
    lb, clf, scored, *_ = bundles
    rows = scored.collect()
    assert rows and all(r["prediction"] in (0, 1) and 0.0 <= r["score"] <= 1.0 for r in rows)
    assert V.roc_auc(scored).first()[0] >= 0.85     # a constant score has 0.5


def test_kmeans_assigns_nearest_centroid(bundles):
    *_, clu, pts, _run = bundles
    cents = clu.centroids
    assert list(cents) == [0, 1, 2, 3]
    assert sorted(cents.values()) == [cents[i] for i in range(4)]   # renumbered by centroid order
    for r in pts.limit(200).collect():
        d = {c: (r["PCA1"] - v[0]) ** 2 + (r["PCA2"] - v[1]) ** 2 for c, v in cents.items()}
        assert d[r["cluster"]] == pytest.approx(min(d.values()))


def test_bundle_roundtrip_same_predictions(spark, bundles):
    lb, clf, _scored, clu, _pts, run = bundles
    clf.save(spark, f"{run}/clf")
    clu.save(spark, f"{run}/clu")
    apps = lb.drop(LABEL)
    a = J.score_applications(apps, clf, clu).orderBy(KEY).collect()
    b = J.score_applications(apps, J.ClassifierBundle.load(spark, f"{run}/clf"),
                             J.ClusterBundle.load(spark, f"{run}/clu")).orderBy(KEY).collect()
    assert a == b and len(a) == lb.count()
    assert {r["verdict"] for r in a} <= {M.VERDICT_DEFAULT, M.VERDICT_REPAY}
    assert all(r["description"] == M.CLUSTER_DESCRIPTIONS[r["cluster"]] for r in a)


def test_streaming_scoring_equals_batch(spark, bundles):
    lb, _clf, _s, _clu, _pts, run = bundles
    src = tempfile.mkdtemp(prefix="apps-")
    # a NaN rate must reach the model as a missing value, in the stream as in the batch
    apps = lb.drop(LABEL).withColumn("loan_int_rate", F.when(F.col(KEY) % 5 == 0, F.lit(float("nan"))).otherwise(F.col("loan_int_rate")))
    apps.repartition(3).write.mode("overwrite").parquet(os.path.join(src, "in"))
    sink = os.path.join(src, "out")
    q = start_scoring_stream(spark, os.path.join(src, "in"), sink, f"{run}/clf", f"{run}/clu",
                             checkpoint=os.path.join(src, "ckpt"))
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink).orderBy(KEY).collect()
    batch = J.score_applications(apps, J.ClassifierBundle.load(spark, f"{run}/clf"),
                                 J.ClusterBundle.load(spark, f"{run}/clu")).orderBy(KEY).collect()
    assert streamed == batch


def test_unknown_cluster_description(spark):
    df = spark.createDataFrame([(0,), (3,), (7,)], "cluster int")
    got = [r[0] for r in df.select(M.cluster_description()).collect()]
    assert got == [M.CLUSTER_DESCRIPTIONS[0], M.CLUSTER_DESCRIPTIONS[3], M.CLUSTER_UNKNOWN]


def test_elbow_k1_total_sum_of_squares(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 0.0), (0.0, 2.0), (2.0, 2.0)], "a double, b double")
    table = {r["k"]: r["inertia"] for r in M.elbow(df, ["a", "b"], [1, 2]).collect()}
    assert table[1] == pytest.approx(8.0) and table[2] <= table[1]


def test_scoring_features_equal_training_features(spark, bundles):
    """Rows seen on both paths get the same features, missing values included."""
    lb, clf, *_ = bundles
    cleaned, values = PR.clean_and_fit(lb)
    assert values == clf.imputation
    trained, _ = PR.engineer(cleaned, clf.encoders)
    scored = J.application_features(lb.drop(LABEL), clf.imputation, clf.encoders)
    rows = Fe.align_schema(trained, clf.features, keep=[KEY])
    same = rows.join(Fe.align_schema(scored, clf.features, keep=[KEY]), rows.columns, "left_semi")
    assert lb.where("loan_int_rate IS NULL OR person_emp_length IS NULL").join(rows, KEY, "left_semi").count() > 0
    null_safe = rows.exceptAll(Fe.align_schema(scored, clf.features, keep=[KEY]))
    assert null_safe.count() == 0 and same.count() > 0


def test_reference_order_training(spark):
    """Scaling and SMOTE before the split: the test part holds synthetic rows of a balanced table."""
    p = J.prepare_classifier(loan_book(spark, SF_SMALL), shared_path(spark, "tests", "order", unique=True), split_first=False)
    counts = {r[LABEL]: r["count"] for r in p.balanced.unionByName(p.test).groupBy(LABEL).count().collect()}
    assert len(set(counts.values())) == 1
    assert p.test.where("copy_no > 0").count() > 0 and p.balanced.join(p.test, [KEY, "copy_no"], "left_semi").count() == 0
    first = J.prepare_classifier(loan_book(spark, SF_SMALL), shared_path(spark, "tests", "order", unique=True))
    assert "copy_no" not in first.test.columns and first.balanced.join(first.test, KEY, "left_semi").count() == 0


def test_grid_search_prefixes_and_first_maximum(spark):
    rows = [(float(i % 10), float(i % 7), int((i % 10) > 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, loan_status int")
    grid = {"learning_rate": [0.1, 0.3], "max_depth": [2], "n_estimators": [3, 6]}
    best, table = M.grid_search(df, ["a", "b"], grid=grid, folds=2, parallelism=2)
    got = {r["setting"]: r for r in table.collect()}
    assert [(got[i]["learning_rate"], got[i]["n_estimators"]) for i in range(4)] == [(0.1, 3), (0.1, 6), (0.3, 3), (0.3, 6)]
    assert all(r["cv_accuracy"] == 1.0 for r in got.values())
    # all tie: the first setting wins and is refitted
    assert len(best.stages[-1].treeWeights) == 3 and best.stages[-1].getOrDefault("stepSize") == 0.1
    full = M.fit_gbt(df, ["a", "b"], n_estimators=6, max_depth=2)
    short = M.fit_gbt(df, ["a", "b"], n_estimators=4, max_depth=2)
    cut = M.prefix_model(full, 4)
    key = lambda m: sorted((r["a"], r["b"], r["prediction"], round(r["score"], 9)) for r in M.predict(m, df, ["a", "b"]).collect())
    assert key(cut) == key(short)


def test_tune_classifier_compares_both_models(spark):
    grid = {"learning_rate": [0.3], "max_depth": [3], "n_estimators": [4, 8]}
    plain, tuned, table, both = J.tune_classifier(loan_book(spark, SF_SMALL), shared_path(spark, "tests", "tune", unique=True), grid, folds=2, n_estimators=2, max_depth=2)
    assert table.count() == 2 and len(plain.model.stages[-1].treeWeights) == 2
    rows = {r["stage"]: r for r in both.collect()}
    assert set(rows) == {"untuned", "tuned"} and all(r["roc_auc"] > 0.85 for r in rows.values())
    n = lambda r: r["tn"] + r["fp"] + r["fn"] + r["tp"]
    assert n(rows["tuned"]) == n(rows["untuned"]) > 0


def test_kmeans_tuning_shares_restarts_and_refits(spark, bundles):
    lb, *_ = bundles
    grid = {"n_clusters": [2, 3], "init": ["k-means++", "random"], "n_init": [2, 4], "max_iter": [5, 50]}
    clu, pts, table = J.tune_clusterer(PR.clean_loans(lb), shared_path(spark, "tests", "km", unique=True), grid)
    rows = table.collect()
    assert len(rows) == 16 and [(r["n_clusters"], r["init"], r["n_init"], r["max_iter"]) for r in rows[:3]] == [(2, "k-means++", 2, 5), (2, "k-means++", 2, 50), (2, "k-means++", 4, 5)]
    best = max(rows, key=lambda r: r["silhouette"])     # max keeps the first of equal values
    assert len(clu.centroids) == best["n_clusters"]
    assert V.silhouette_sq(pts, J.PCA_NAMES, "cluster", None).first()[0] == pytest.approx(best["silhouette"], abs=1e-6)


def test_runs_side_by_side_equal_the_estimator_and_share_their_passes(spark, monkeypatch):
    import numpy as np
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(400, 2))], "a double, b double").repartition(3).localCheckpoint()
    runs = [(2, "random", 1), (3, "k-means++", 1), (4, "random", 7)]
    passes = []
    sums = M._cluster_sums
    monkeypatch.setattr(M, "_cluster_sums", lambda now, dims: passes.append(len(now)) or sums(now, dims))
    got = M.kmeans_runs(df, ["a", "b"], runs, [2, 40], spark_tol=1e-3)
    assert len(got) == 6 and passes[0] == 3 and len(passes) <= 40
    vec = M._vectors(df, ["a", "b"]).persist()
    for k, init, seed in runs:
        for n in (2, 40):
            want = KMeans(k=k, seed=seed, maxIter=n, initMode=M._INIT[init], tol=1e-3, featuresCol="features").fit(vec)
            cost, centres = got[k, init, seed, n]
            assert abs(cost - want.summary.trainingCost) < 1e-6
            assert np.allclose(list(centres.values()), want.clusterCenters(), atol=1e-9)
    vec.unpersist()


def test_chunks_inside_a_region_count_as_a_whole():
    """the sums are those of comparing every row with every centre, but few rows are compared."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(8)
    for n, dims, k in ((0, 2, 3), (5, 2, 2), (60000, 2, 5), (5000, 1, 3), (5000, 3, 4)):
        x = rng.normal(size=(n, dims)).round(2)  # many equal rows
        x[: n // 10] = 0.5
        runs = [(0, rng.normal(size=(k, dims))), (4, np.array([[0.5] * dims, [0.5] * dims, [1.5] * dims]))]
        batches = pa.table({f"x{j}": x[:, j] for j in range(dims)}).to_batches(max_chunksize=7000)
        got = {(r["run"], r["cluster"]): [r[f"s{j}"] for j in range(dims + 2)] for b in M._cluster_sums(runs, dims)(iter(batches)) for r in b.to_pylist()}
        want = {}
        for run, centres in runs:
            d = ((x[:, None, :] - centres) ** 2).sum(axis=2)
            for i in np.unique(own := d.argmin(axis=1)) if n else []:
                want[run, int(i)] = [(own == i).sum(), d[own == i, i].sum(), *x[own == i].sum(axis=0)]
        assert got.keys() == want.keys() and all(np.allclose(got[r], want[r], rtol=1e-9, atol=1e-9) for r in want)
    x = rng.normal(size=(2, 1 << 17))
    x = x[:, M._near_order(list(x))].reshape(2, -1, M.CHUNK_ROWS)
    _, sure = M._whole_chunks(rng.normal(size=(4, 2)), x.min(axis=2), x.max(axis=2))
    assert sure.mean() > 0.75


def test_first_centres_are_the_estimators_without_a_fit_for_each_run(spark, monkeypatch):
    """all runs draw from vectors that are held once."""
    import numpy as np
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rng.normal(size=(300, 2)).round(1)], "a double, b double").repartition(3).localCheckpoint()
    vec = M._vectors(df, ["a", "b"]).persist()
    runs = [(2, "random", 1), (5, "random", 2), (3, "k-means++", 1), (6, "k-means++", 9)]
    want = {(k, init, seed): KMeans(k=k, seed=seed, maxIter=1, initMode=M._INIT[init], tol=1e-9, featuresCol="features").fit(vec).clusterCenters() for k, init, seed in runs}
    vec.unpersist()
    monkeypatch.setattr(M, "KMeans", None)
    got = M.kmeans_runs(df, ["a", "b"], runs, [1], spark_tol=1e-9)
    assert all(np.allclose(list(got[*r, 1][1].values()), want[r], atol=1e-9) for r in runs)
