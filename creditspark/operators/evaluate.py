"""V1-V8: classifier and clustering evaluation.

Classification metrics come from one conditional aggregate (TP/FP/FN/TN);
ROC points and AUC group by score first and then use range-bucketed running
sums, so no step orders all rows in one task. Silhouette uses the linear-cost
squared-Euclidean form (per-cluster sums broadcast as literals, k rows).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cumulative_sums


def _counts(df: DataFrame, label: str, prediction: str):
    y, p = F.col(label), F.col(prediction)
    return [F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 1)).alias("fp"),
            F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 0) & (p == 0)).alias("tn")]


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   digits: int = 6) -> DataFrame:
    """V1 accuracy, precision, recall, F1 for class 1 (0/0 gives 0)."""
    c = df.agg(*_counts(df, label, prediction))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return c.select(
        F.round(_ratio(tp + tn, tp + fp + fn + tn), digits).alias("accuracy"),
        F.round(prec, digits).alias("precision"), F.round(rec, digits).alias("recall"),
        F.round(_ratio(2 * tp, 2 * tp + fp + fn), digits).alias("f1"))


def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """V2 the 2x2 confusion matrix in long form (absent cells are 0)."""
    c = df.agg(*_counts(df, label, prediction))
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(n).alias("count"))
        for a, b, n in cells])).alias("e")).select("e.actual", "e.predicted", "e.count")


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction",
                          digits: int = 6) -> DataFrame:
    """V3 per-class precision/recall/F1/support plus accuracy, macro and weighted averages."""
    c = df.agg(*_counts(df, label, prediction))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    # class 1: positive = 1; class 0: positive = 0 (tn plays tp)
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, tn + fp)
    f1_1, f1_0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fn + fp)
    s1, s0 = tp + fn, tn + fp
    acc = _ratio(tp + tn, n)
    rows = [
        ("0", p0, r0, f1_0, s0),
        ("1", p1, r1, f1_1, s1),
        ("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        ("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n),
        ("weighted avg", _ratio(p0 * s0 + p1 * s1, n), _ratio(r0 * s0 + r1 * s1, n),
         _ratio(f1_0 * s0 + f1_1 * s1, n), n),
    ]
    return c.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("class_name"), F.round(p, digits).alias("precision"),
                 F.round(r, digits).alias("recall"), F.round(f, digits).alias("f1_score"),
                 s.cast("bigint").alias("support"))
        for name, p, r, f, s in rows])).alias("e")).select("e.*")


def _score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, written once as a stage: the
    running sums read it several times, and the predictions behind it (a model
    applied to the whole test set) are then scanned only once."""
    from .clean import materialize
    g = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return materialize(g, "score_counts")


def roc_points(df: DataFrame, label: str = "label", score: str = "score", digits: int = 6, drop_intermediate: bool = True) -> DataFrame:
    """V4 ROC curve: one point per distinct score threshold (score >= t is
    positive), plus the (0, 0) start at threshold +inf.

    ``drop_intermediate`` leaves out the points whose step is the step of the point after them (same positives, same negatives): they lie
    on a straight line, so the curve and its area stay. The first and the last threshold are kept.
    """
    g = _score_counts(df, label, score)
    tot = g.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = cumulative_sums(g, "score", ["pos", "neg"], ascending=False, following=["pos", "neg"] if drop_intermediate else ())
    if drop_intermediate:
        cum = cum.where(F.col("is_first") | F.col("next_pos").isNull() | (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg")))
    totals = tot.first()
    p_all, n_all = float(totals["P"] or 0), float(totals["N"] or 0)
    rate = lambda c, t: (F.col(c) / F.lit(t)) if t > 0 else F.lit(None).cast("double")
    pts = cum.select(F.col("score").alias("threshold"),
                     F.round(rate("cum_neg", n_all), digits).alias("fpr"),
                     F.round(rate("cum_pos", p_all), digits).alias("tpr"))
    start = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"),
        (F.lit(0.0) if n_all > 0 else F.lit(None).cast("double")).alias("fpr"),
        (F.lit(0.0) if p_all > 0 else F.lit(None).cast("double")).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(df: DataFrame, label: str = "label", score: str = "score", digits: int = 6) -> DataFrame:
    """V5 area under the ROC curve, exact with ties counted half:
    sum over scores of pos(s) * (neg below s + neg(s) / 2), over P * N.
    NULL when only one class is present."""
    g = _score_counts(df, label, score)
    cum = cumulative_sums(g, "score", ["neg"], ascending=True)
    agg = cum.agg(F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * 0.5)).alias("s"),
                  F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    p, n = F.col("P").cast("double"), F.col("N").cast("double")
    return agg.select(F.round(F.when((p > 0) & (n > 0), F.col("s") / (p * n)), digits).alias("roc_auc"))


def silhouette_sq(df: DataFrame, features: Sequence[str], cluster: str = "cluster",
                  digits: int | None = 6) -> DataFrame:
    """V6 mean silhouette with squared Euclidean distance, linear cost.

    mean_{y in C} ||x - y||^2 = ||x||^2 - 2 x . mean(C) + mean_{y in C} ||y||^2.
    The per-cluster sums (k rows) are collected once and applied as literals.
    Own-cluster distance excludes the point itself (n / (n - 1)); singleton
    clusters score 0. This is the definition of Spark's ClusteringEvaluator.
    """
    features = list(features)
    x = [F.col(f).cast("double") for f in features]
    sq = sum((xi * xi for xi in x[1:]), x[0] * x[0])
    stats = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum(sq).alias("ss"),
                                    *[F.sum(xi).alias(f"s{i}") for i, xi in enumerate(x)]).collect()
    if len(stats) < 2:
        return df.sparkSession.range(1).select(F.lit(None).cast("double").alias("silhouette"))
    dists = {}
    for r in stats:
        n = r["n"]
        dot = sum((x[i] * F.lit(r[f"s{i}"] / n) for i in range(1, len(x))), x[0] * F.lit(r["s0"] / n))
        dists[r[cluster]] = (sq - 2 * dot + F.lit(r["ss"] / n), n)
    own = None
    other = None
    for cid, (d, n) in dists.items():
        a = F.when(F.lit(n) > 1, d * F.lit(n / max(1, n - 1))).otherwise(F.lit(0.0))
        own = F.when(F.col(cluster) == cid, a) if own is None else own.when(F.col(cluster) == cid, a)
        cand = F.when(F.col(cluster) != cid, d)
        other = cand if other is None else F.least(other, cand)
    sizes = {cid: n for cid, (_d, n) in dists.items()}
    size = None
    for cid, n in sizes.items():
        size = F.when(F.col(cluster) == cid, F.lit(n)) if size is None else size.when(F.col(cluster) == cid, F.lit(n))
    a, b = F.col("_a"), F.col("_b")
    s = (F.when(F.col("_n") <= 1, F.lit(0.0))
         .when(a < b, 1 - a / b).when(a > b, b / a - 1).otherwise(F.lit(0.0)))
    return (df.select(own.alias("_a"), other.alias("_b"), size.alias("_n"))
            .agg((F.avg(s) if digits is None else F.round(F.avg(s), digits)).alias("silhouette")))


def assign_nearest(df: DataFrame, features: Sequence[str], centroids: dict[int, Sequence[float]],
                   out: str = "cluster") -> DataFrame:
    """Nearest-centroid assignment with fixed centroids (ties: smaller id), as
    one expression: k is small, so the centroids are literals."""
    x = [F.col(f).cast("double") for f in features]
    best = None
    for cid in sorted(centroids):
        c = centroids[cid]
        d = sum(((x[i] - F.lit(float(c[i]))) ** 2 for i in range(1, len(x))), (x[0] - F.lit(float(c[0]))) ** 2)
        item = F.struct(d.alias("d"), F.lit(cid).alias("id"))
        best = item if best is None else F.least(best, item)
    return df.withColumn(out, best["id"])


def inertia(df: DataFrame, features: Sequence[str], centroids: dict[int, Sequence[float]],
            cluster: str = "cluster", digits: int = 6) -> DataFrame:
    """V7 sum of squared distances of points to their own centroid."""
    x = [F.col(f).cast("double") for f in features]
    d = None
    for cid, c in centroids.items():
        dc = sum(((x[i] - F.lit(float(c[i]))) ** 2 for i in range(1, len(x))), (x[0] - F.lit(float(c[0]))) ** 2)
        d = F.when(F.col(cluster) == cid, dc) if d is None else d.when(F.col(cluster) == cid, dc)
    return df.agg(F.round(F.sum(d), digits).alias("inertia"))


def stage_comparison(stages: dict[str, DataFrame], label: str = "label", prediction: str = "prediction",
                     score: str = "score", digits: int = 6) -> DataFrame:
    """V8 before/after table: V1 metrics, V2 counts and V5 AUC per stage.

    Each stage contributes one conditional aggregate and one AUC job; the
    resulting handful of numbers form the report.
    """
    rows = []
    for name, d in stages.items():
        c = d.agg(*_counts(d, label, prediction)).first()
        tp, fp, fn, tn = (int(c[x]) for x in ("tp", "fp", "fn", "tn"))
        auc = roc_auc(d, label, score, digits).first()[0]
        div = lambda a, b: a / b if b else 0.0
        prec, rec = div(tp, tp + fp), div(tp, tp + fn)
        rows.append((name, round(div(tp + tn, tp + fp + fn + tn), digits), round(prec, digits),
                     round(rec, digits), round(div(2 * tp, 2 * tp + fp + fn), digits), tn, fp, fn, tp, auc))
    schema = ("stage string, accuracy double, precision double, recall double, f1 double, "
              "tn bigint, fp bigint, fn bigint, tp bigint, roc_auc double")
    first = next(iter(stages.values()))
    return first.sparkSession.createDataFrame(rows, schema)


def threshold_comparison(df: DataFrame, thresholds: dict[str, float], label: str = "label", score: str = "score",
                         digits: int = 6) -> DataFrame:
    """V8 for one score cut at several thresholds: the rows are counted per score once, and one aggregate over
    these counts gives every stage's V1 metrics, V2 counts and the AUC that they share."""
    cum = cumulative_sums(_score_counts(df, label, score), "score", ["neg"], ascending=True)
    s = F.col("score")
    counts = []
    for i, t in enumerate(thresholds.values()):
        counts += [F.coalesce(F.sum(F.when(s < t, F.col("neg"))), F.lit(0)).cast("bigint").alias(f"tn{i}"),
                   F.coalesce(F.sum(F.when(s >= t, F.col("neg"))), F.lit(0)).cast("bigint").alias(f"fp{i}"),
                   F.coalesce(F.sum(F.when(s < t, F.col("pos"))), F.lit(0)).cast("bigint").alias(f"fn{i}"),
                   F.coalesce(F.sum(F.when(s >= t, F.col("pos"))), F.lit(0)).cast("bigint").alias(f"tp{i}")]
    one = cum.agg(*counts, F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N"),
                  F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * 0.5)).alias("area"))
    auc = F.round(F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("area") / (F.col("P") * F.col("N"))), digits)

    def share(a, b):
        return F.round(F.when(b != 0, a.cast("double") / b).otherwise(0.0), digits)

    stages = []
    for i, name in enumerate(thresholds):
        tn, fp, fn, tp = (F.col(f"{c}{i}") for c in ("tn", "fp", "fn", "tp"))
        stages.append(F.struct(F.lit(name).alias("stage"), share(tp + tn, tp + fp + fn + tn).alias("accuracy"), share(tp, tp + fp).alias("precision"),
                               share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"), tn.alias("tn"), fp.alias("fp"),
                               fn.alias("fn"), tp.alias("tp"), auc.alias("roc_auc")))
    return one.select(F.explode(F.array(*stages)).alias("s")).select("s.*")
