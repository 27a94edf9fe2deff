import numpy as np
import pytest
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler

from creditspark.operators import evaluate as V
from creditspark.operators import features as Fe


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(float(v), 5.0) for v in [1, 2, 3, 4]], "x double, c double")
    sc = Fe.fit_scaler(df, ["x", "c"])
    assert round(sc.stds["x"], 6) == 1.118034
    out = sc.transform(df).collect()
    assert [round(r["x"], 6) for r in out] == [round((v - 2.5) / 1.118033988749895, 6) for v in [1, 2, 3, 4]]
    assert all(r["c"] == 0.0 for r in out)   # zero std divides by 1


def test_one_hot_and_label_encoding(spark):
    df = spark.createDataFrame([("b", "Y"), ("a", "N"), ("c", "Y")], "g string, d string")
    oh = Fe.fit_one_hot(df, ["g"])
    assert oh.output_columns() == ["g_a", "g_b", "g_c"]
    new = spark.createDataFrame([("z", "N"), (None, "Y"), ("a", "Y")], "g string, d string")
    rows = oh.transform(new).collect()
    assert [(r["g_a"], r["g_b"], r["g_c"]) for r in rows] == [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    le = Fe.fit_label_encoder(df, ["g", "d"])
    assert sorted((r["g"] is None, r["g"] or 0, r["d"]) for r in le.transform(new).collect()) == [(False, 0, 1), (True, 0, 0), (True, 0, 1)]
    assert le.transform(new).columns == new.columns


def test_encoders_take_any_number_of_categories(spark):
    df = spark.range(1500).selectExpr("id", "concat('v', lpad(id, 5, '0')) AS g", "'x' AS d").repartition(4)
    codes = Fe.fit_label_encoder(df, ["g", "d"]).transform(df)
    assert codes.where("g <> id OR d <> 0").count() == 0 and codes.count() == 1500
    assert len(Fe.fit_one_hot(df, ["g"]).output_columns()) == 1500


def test_align_schema(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "id long, a double, extra double")
    out = Fe.align_schema(df, ["b", "a"], keep=["id"])
    assert out.columns == ["id", "b", "a"] and out.first()["b"] == 0.0


def test_pca_orthonormal_and_sign(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)) @ np.array([[3, 0, 0], [1, 1, 0], [0, 0, 0.2]])
    x = x - x.mean(axis=0)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    p = Fe.fit_pca(df, ["a", "b", "c"], 2)
    w = np.array(p.loadings)
    assert np.allclose(w @ w.T, np.eye(2), atol=1e-9)
    for comp in w:
        assert comp[np.argmax(np.abs(comp))] > 0
    ev = p.explained_variance
    assert ev[0] >= ev[1]


def test_confusion_fixture(spark):
    rows = [(0, 0)] * 4814 + [(0, 1)] * 31 + [(1, 0)] * 383 + [(1, 1)] * 4545
    df = spark.createDataFrame(rows, "label int, prediction int")
    m = V.binary_metrics(df, digits=4).first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.9576, 0.9932, 0.9223)
    cm = {(r["actual"], r["predicted"]): r["count"] for r in V.confusion_matrix(df).collect()}
    assert cm == {(0, 0): 4814, (0, 1): 31, (1, 0): 383, (1, 1): 4545}
    rep = {r["class_name"]: r for r in V.classification_report(df).collect()}
    assert rep["1"]["support"] == 4545 + 383 and rep["accuracy"]["f1_score"] == round(9359 / 9773, 6)


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "score double, label int")
    assert V.roc_auc(df).first()[0] == 0.875
    pts = {r["threshold"]: (r["fpr"], r["tpr"]) for r in V.roc_points(df).collect()}
    assert pts[0.9] == (0.0, 0.5) and pts[0.5] == (0.5, 1.0) and pts[0.1] == (1.0, 1.0)


def test_roc_curve_without_points_on_lines(spark):
    import random
    rng = random.Random(4)
    rows = [(s / 50, int(rng.random() < s / 60)) for s in range(50) for _ in range(1 + s % 2)] + [(2.0 + i, 1) for i in range(40)] + [(-1.0 - i, 0) for i in range(40)]
    df = spark.createDataFrame(rows, "score double, label int").repartition(5)
    pos, neg = {}, {}
    for s, y in rows:
        pos[s], neg[s] = pos.get(s, 0) + y, neg.get(s, 0) + 1 - y
    order = sorted(pos, reverse=True)
    step = [(pos[s], neg[s]) for s in order]
    want = {s for i, s in enumerate(order) if i in (0, len(order) - 1) or step[i] != step[i + 1]}
    every = {r.threshold: (r.fpr, r.tpr) for r in V.roc_points(df, digits=12, drop_intermediate=False).collect()}
    kept = {r.threshold: (r.fpr, r.tpr) for r in V.roc_points(df, digits=12).collect()}
    assert set(kept) == want | {float("inf")} and len(kept) < len(every) and all(every[t] == p for t, p in kept.items())
    curve = [kept[t] for t in sorted(kept, reverse=True)]
    area = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(curve, curve[1:]))
    assert abs(area - V.roc_auc(df, digits=12).first()[0]) < 1e-9


def test_roc_curve_of_one_score(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert sorted(tuple(r) for r in V.roc_points(df).collect()) == [(0.5, 1.0, 1.0), (float("inf"), 0.0, 0.0)]


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(0.5, 1), (0.7, 1)], "score double, label int")
    assert V.roc_auc(df).first()[0] is None


POINTS = [(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (4.0, 5.0), (8.0, 8.0), (9.0, 8.0), (8.0, 10.0)]


def test_silhouette_and_inertia_fixture(spark):
    rows = [(x, y, 0 if i < 3 else 1) for i, (x, y) in enumerate(POINTS)]
    df = spark.createDataFrame(rows, "x double, y double, cluster int")
    s = V.silhouette_sq(df, ["x", "y"], "cluster").first()[0]
    assert s == pytest.approx(0.81935, abs=1e-5)
    vec = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        df.withColumn("prediction", df.cluster.cast("int")))
    assert ClusteringEvaluator().evaluate(vec) == pytest.approx(s, abs=1e-6)
    cents = {0: [1 / 3, 1 / 3], 1: [29 / 4, 31 / 4]}
    assert V.inertia(df, ["x", "y"], cents).first()[0] == pytest.approx(28.83333, abs=1e-5)
    assigned = V.assign_nearest(df.drop("cluster"), ["x", "y"], cents).collect()
    assert [r["cluster"] for r in assigned] == [0, 0, 0, 1, 1, 1, 1]


def test_encoders_roundtrip_keep_order(spark):
    df = spark.createDataFrame([("b", "y", "Q"), ("a", "x", "P")], "zz string, aa string, g string")
    oh, le = Fe.fit_encoders(df, ["zz", "aa"], ["g"])
    oh2 = Fe.OneHotModel.from_df(oh.to_df(spark))
    le2 = Fe.LabelEncoderModel.from_df(le.to_df(spark))
    assert list(oh2.categories) == ["zz", "aa"] and oh2.categories == oh.categories
    assert le2.columns == ["g"]
    assert [(r["value"], r["code"]) for r in le2.codes.orderBy("code").collect()] == [("P", 0), ("Q", 1)]


def test_encoders_read_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([("b", "y", "Q"), ("a", None, "P"), (None, "x", "P"), ("a", "y", None)], "zz string, aa string, g string").mapInArrow(count, "zz string, aa string, g string")
    oh, le = Fe.fit_encoders(df, ["zz", "aa"], ["g", "aa"])
    assert seen.value == 4
    assert oh.categories == {"zz": ["a", "b"], "aa": ["x", "y"]}
    assert sorted(tuple(r) for r in le.codes.collect()) == [(0, "g", 0, "P"), (0, "g", 1, "Q"), (1, "aa", 0, "x"), (1, "aa", 1, "y")]


def test_raw_rows_are_made_once(spark):
    from creditspark.plans import prepare as PR
    from creditspark.sources import KEY

    row = (30, 50_000, "RENT", 4.0, "1-URGENT", "A", 9_000, 5.5, 0, 0.18, "N", 3)
    for twice in (False, True):
        rows = [(i, 20 + i, *row[1:]) for i in range(8)] + [(8, 21 if twice else 28, *row[1:]), (9, None, *row[1:7], None, *row[8:])]
        seen = spark.sparkContext.accumulator(0)

        def count(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        raw = spark.createDataFrame(rows, f"{KEY} long, person_age int, person_income long, person_home_ownership string, person_emp_length double, loan_intent string, loan_grade string, "
                                    "loan_amnt long, loan_int_rate double, loan_status int, loan_percent_income double, cb_person_default_on_file string, cb_person_cred_hist_length int")
        got = PR.clean_loans(raw.mapInArrow(count, raw.schema)).collect()
        assert sorted(r[KEY] for r in got) == [*range(8)] + [8] * (not twice)
        assert seen.value == len(rows)
