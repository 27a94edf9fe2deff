"""M1-M9: boosted-tree classifier, grid search, K-means, elbow, tuning, scoring.

Model training is ``pyspark.ml`` (distributed tree and Lloyd iterations); our
code only maps the reference's parameters, loops over small grids on the
driver, and turns fitted models into tables.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark import SparkContext, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import _to_java_object_rdd
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evaluate import assign_nearest, silhouette_sq
from .ledger import FitLedger, data_digest, setting_name

# ---- Fixed values (the reference's settings) --------------------------------
# Boosted-tree defaults of the reference's library.
GBT_DEFAULTS = {"n_estimators": 100, "learning_rate": 0.3, "max_depth": 6,
                "subsample": 1.0, "colsample_bytree": 1.0}
# Classifier grid: 4 x 3 x 6 x 2 x 2 = 288 settings, 5 folds, scored by accuracy.
GBT_GRID = {
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "max_depth": [3, 5, 7],
    "n_estimators": [50, 100, 150, 200, 300, 500],
    "subsample": [0.8, 1.0],
    "colsample_bytree": [0.8, 1.0],
}
# K-means grid: 5 x 2 x 2 x 4 = 80 settings, best by silhouette.
KMEANS_GRID = {
    "n_clusters": [2, 3, 4, 5, 6],
    "init": ["k-means++", "random"],
    "n_init": [10, 20],
    "max_iter": [100, 300, 500, 1000],
}
# Scoring texts: verdict for class 1 / 0, cluster descriptions, unknown cluster.
VERDICT_DEFAULT = "Nasabah Berpotensi Gagal Bayar"
VERDICT_REPAY = "Nasabah Berpotensi Tidak Gagal Bayar"
CLUSTER_DESCRIPTIONS = {
    0: "Nasabah dengan potensi kredit tinggi, kemungkinan besar mampu memenuhi kewajiban pinjaman.",
    1: "Nasabah dengan potensi kredit moderat, evaluasi lebih lanjut diperlukan.",
    2: "Nasabah dengan potensi kredit rendah, perlu waspada terhadap kemungkinan risiko gagal bayar.",
    3: "Nasabah dengan potensi risiko gagal bayar tinggi, perlu dilakukan mitigasi atau penundaan persetujuan.",
}
CLUSTER_UNKNOWN = "Cluster tidak dikenali."
# -----------------------------------------------------------------------------

_INIT = {"k-means++": "k-means||", "random": "random", "k-means||": "k-means||"}


# ---- M1-M3 ------------------------------------------------------------------
def gbt_pipeline(features: Sequence[str], label: str = "loan_status", seed: int = 42,
                 **params) -> Pipeline:
    """M1 estimator: assembler + GBTClassifier with the reference's parameter names
    mapped (n_estimators -> maxIter, learning_rate -> stepSize, max_depth ->
    maxDepth, subsample -> subsamplingRate, colsample_bytree -> per-node
    featureSubsetStrategy fraction)."""
    p = {**GBT_DEFAULTS, **params}
    col = float(p["colsample_bytree"])
    gbt = GBTClassifier(featuresCol="features", labelCol=label, seed=seed,
                        maxIter=int(p["n_estimators"]), stepSize=float(p["learning_rate"]),
                        maxDepth=int(p["max_depth"]), subsamplingRate=float(p["subsample"]),
                        featureSubsetStrategy="all" if col >= 1.0 else str(col),
                        checkpointInterval=10)
    asm = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error")
    return Pipeline(stages=[asm, gbt])


def fit_gbt(train: DataFrame, features: Sequence[str], label: str = "loan_status", seed: int = 42,
            **params) -> PipelineModel:
    data = train.select(*features, F.col(label).cast("double").alias(label))
    return gbt_pipeline(features, label, seed, **params).fit(data)


def predict(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """M3 class and positive-class probability."""
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("prediction"),
                      vector_to_array("probability")[1].alias("score"))


def prefix_model(model: PipelineModel, n: int) -> PipelineModel:
    """The model after its first ``n`` boosting rounds: boosting is sequential, so it equals a fit with n rounds.

    Needs a classic session (not Spark Connect): the shorter model is made through the JVM gateway.
    """
    gbt = model.stages[-1]
    sc = SparkContext._active_spark_context
    java, gw = gbt._java_obj, sc._gateway
    n = min(n, len(gbt.treeWeights))
    trees = gw.new_array(sc._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gw.new_array(sc._jvm.double, n)
    for i in range(n):
        trees[i], weights[i] = java.trees()[i], float(gbt.treeWeights[i])
    cut = sc._jvm.org.apache.spark.ml.classification.GBTClassificationModel(f"{java.uid()}_{n}", trees, weights)
    java.copyValues(cut, java.extractParamMap())
    return PipelineModel([*model.stages[:-1], GBTClassificationModel(cut)])


def grid_search(train: DataFrame, features: Sequence[str], label: str = "loan_status",
                grid: dict[str, list] | None = None, folds: int = 5, parallelism: int = 4,
                seed: int = 42, ledger: str | None = None, max_fits: int | None = None) -> tuple[PipelineModel | None, DataFrame]:
    """M2 cross-validated grid search scored by accuracy. Returns the best model (first maximum in grid order), refitted on all
    rows, and a table of every setting with its mean fold accuracy.

    Settings that differ only in ``n_estimators`` share one fit of the longest run per fold; the shorter
    ones are read from its first rounds (288 settings of the full grid are 48 fits a fold).

    With ``ledger`` (a lasting folder) each fit is committed there and fits that it has are not run again, so a run that was killed
    goes on where it stopped, and runs of ``max_fits`` fits each add up to the whole grid. It holds results per content of ``train``: keep
    that table as a stage. While fits are missing there is no model, and the settings they belong to have no accuracy.
    """
    grid = grid or GBT_GRID
    names = list(grid)
    settings = [dict(zip(names, v)) for v in itertools.product(*[grid[n] for n in names])]
    rest = [n for n in names if n != "n_estimators"]
    rounds = lambda s: int(s.get("n_estimators", GBT_DEFAULTS["n_estimators"]))
    shared = lambda s: {n: s[n] for n in rest}
    data = train.select(*features, F.col(label).cast("double").alias(label),
                        F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(folds)).alias("_fold")).persist(StorageLevel.MEMORY_AND_DISK)
    ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")
    sizes: dict[str, list[int]] = {}
    for s in settings:
        sizes.setdefault(setting_name(shared(s)), []).append(rounds(s))

    def run(job) -> dict:
        setting, fold = job
        name = setting_name(setting)
        wanted = sorted(set(sizes[name]))
        fitted = gbt_pipeline(features, label, seed, **{**setting, "n_estimators": wanted[-1]}).fit(data.where(F.col("_fold") != fold))
        held = data.where(F.col("_fold") == fold)
        accuracy = {n: ev.evaluate(prefix_model(fitted, n).transform(held)) for n in wanted}
        if book:
            book.commit(setting, fold, accuracy)
        return {(name, fold, n): a for n, a in accuracy.items()}

    try:
        book = FitLedger(train.sparkSession, ledger, data_digest(data.drop("_fold")), folds, seed) if ledger else None
        found = book.known() if book else {}
        distinct = list({setting_name(shared(s)): shared(s) for s in settings}.values())
        jobs = [(s, f) for s, f in itertools.product(distinct, range(folds)) if any((setting_name(s), f, n) not in found for n in sizes[setting_name(s)])]
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            for part in pool.map(run, jobs[:max_fits]):
                found.update(part)
        rows, best = [], None
        for i, s in enumerate(settings):
            parts = [found.get((setting_name(shared(s)), f, rounds(s))) for f in range(folds)]
            mean = None if None in parts else sum(parts) / folds
            rows.append((i, *[float(v) if isinstance(v, float) else v for v in s.values()], mean))
            if mean is not None and (best is None or mean > best[0]):
                best = mean, s
        whole = all(r[-1] is not None for r in rows)
        model = gbt_pipeline(features, label, seed, **best[1]).fit(data) if whole else None
    finally:
        data.unpersist()
    schema = "setting int, " + ", ".join(
        f"{n} {'double' if isinstance(grid[n][0], float) else 'int'}" for n in names) + ", cv_accuracy double"
    return model, train.sparkSession.createDataFrame(rows, schema)


# ---- M4-M8 ------------------------------------------------------------------
def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df).select("features")


def spark_tolerance(df: DataFrame, features: Sequence[str], tol: float = 1e-4) -> float:
    """The reference library's tolerance is relative (tol x mean feature
    variance, on the squared centre shift); Spark's is an absolute shift per
    centre. Map one to the other with one aggregate."""
    row = df.agg(*[F.var_pop(F.col(f).cast("double")).alias(f) for f in features]).first()
    vals = [row[f] for f in features if row[f] is not None]
    mean_var = sum(vals) / len(vals) if vals else 0.0
    return max(1e-12, (tol * mean_var) ** 0.5)


def fit_kmeans(df: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42, max_iter: int = 300,
               init: str = "k-means++", n_init: int = 1, tol: float = 1e-4,
               vectors: DataFrame | None = None, spark_tol: float | None = None) -> KMeansModel:
    """M4 K-means; ``n_init`` restarts with seeds seed..seed+n_init-1, lowest cost wins."""
    vec = vectors if vectors is not None else _vectors(df, features).persist(StorageLevel.MEMORY_AND_DISK)
    eps = spark_tol if spark_tol is not None else spark_tolerance(df, features, tol)
    best = None
    try:
        for r in range(max(1, n_init)):
            m = KMeans(k=k, seed=seed + r, maxIter=max_iter, initMode=_INIT[init], tol=eps,
                       featuresCol="features").fit(vec)
            if best is None or m.summary.trainingCost < best.summary.trainingCost:
                best = m
    finally:
        if vectors is None:
            vec.unpersist()
    return best


#: Rows that a task of ``_cluster_sums`` looks at together, and neighbouring ones of them that may count as a whole; any value gives the same clusters.
BLOCK_ROWS = 1 << 19
CHUNK_ROWS = 128


def _blocks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[list[np.ndarray]]:
    """The columns of many batches joined: blocks of ``BLOCK_ROWS`` rows or a little more."""
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None and batch.num_rows:
            held.append([batch.column(j).to_numpy(zero_copy_only=False) for j in range(dims)])
            n += batch.num_rows
        if held and (batch is None or n >= BLOCK_ROWS):
            yield [np.concatenate([h[j] for h in held]) for j in range(dims)]
            held, n = [], 0


def _near_order(x: list[np.ndarray]) -> np.ndarray:
    """An order in which neighbouring rows are near each other in the first two features (along a Morton curve)."""
    code = np.zeros(len(x[0]), np.uint16)
    for j, c in enumerate(x[:2]):
        lo, hi = c.min(), c.max()
        place = ((c - lo) * (255 / (hi - lo))).astype(np.uint16) if 0 < hi - lo < np.inf else np.zeros(len(c), np.uint16)
        for bit in range(8):
            code |= (place >> bit & 1) << (2 * bit + j)
    return np.argsort(code, kind="stable")


def _whole_chunks(centres: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of boxes (features x boxes): the centre nearest to the middle, and whether it is the nearest of every point of the box.

    |p - c|^2 - |p - other|^2 is linear in p, so it is largest in a corner of the box; too close to call counts as no.
    """
    mid = (lo + hi) / 2
    cand = np.argmin([((mid - c[:, None]) ** 2).sum(axis=0) for c in centres], axis=0)
    own, sure = centres[cand].T, np.ones(lo.shape[1], bool)
    size = np.maximum(lo * lo, hi * hi).sum(axis=0) + (own * own).sum(axis=0)
    for i, c in enumerate(centres):
        w = 2 * (c[:, None] - own)
        most = np.maximum(lo * w, hi * w).sum(axis=0) + (own * own).sum(axis=0) - c @ c
        sure &= (cand == i) | (most < -1e-9 * (size + c @ c))
    return cand, sure


def _cluster_sums(runs: list[tuple[int, np.ndarray]], dims: int):
    """Rows of ``dims`` features: per run and cluster the rows nearest to its centre, the sums of their features and squared distances, a row each task.

    Rows of a block are put side by side in space and cut into chunks. A chunk whose box lies in one centre's region counts by its sums; only the
    rows of the others, along the regions' borders, are compared with the centres one by one.
    """
    def cluster_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros((len(centres), dims + 2)) for _, centres in runs]
        for x in _blocks(batches, dims):
            with np.errstate(invalid="ignore", over="ignore"):
                order = _near_order(x)
                x = [c[order] for c in x]
                starts = np.arange(0, len(order), CHUNK_ROWS)
                count = np.diff(starts, append=len(order))
                lo, hi = (np.array([f.reduceat(c, starts) for c in x]) for f in (np.minimum, np.maximum))
                sums = np.array([np.add.reduceat(c, starts) for c in x])
                mean = sums / count
                spread = np.add.reduceat(sum((c - np.repeat(m, count)) ** 2 for c, m in zip(x, mean, strict=True)), starts)
                for (_, centres), total in zip(runs, totals, strict=True):
                    k = len(centres)
                    cand, sure = _whole_chunks(centres, lo, hi)
                    whole = cand[sure]
                    cost = spread[sure] + count[sure] * ((mean[:, sure] - centres[whole].T) ** 2).sum(axis=0)
                    for j, w in enumerate([count[sure], cost, *sums[:, sure]]):
                        total[:, j] += np.bincount(whole, w, k)
                    at = np.flatnonzero(np.repeat(~sure, count))
                    rest = [c[at] for c in x]
                    best, own = np.full(len(at), np.inf), np.zeros(len(at), np.intp)
                    for i, c in enumerate(centres):
                        d = sum((rest[j] - c[j]) ** 2 for j in range(dims))
                        near = d < best  # ties: the first centre
                        own[near] = i
                        np.minimum(best, d, out=best)
                    for j, w in enumerate([None, best, *rest]):
                        total[:, j] += np.bincount(own, w, k)
        at = [(run, i, total[i]) for (run, _), total in zip(runs, totals, strict=True) for i in range(len(total)) if total[i, 0]]
        yield pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int32()), pa.array([a[1] for a in at], pa.int32()),
                                          *(pa.array([float(a[2][j]) for a in at], pa.float64()) for j in range(dims + 2))], ["run", "cluster", *(f"s{j}" for j in range(dims + 2))])
    return cluster_sums


def _first_centres(points: DataFrame, features: Sequence[str], runs: Sequence[tuple[int, str, int]], parallelism: int = 4) -> list[np.ndarray]:
    """The first centres of each run (k, init, seed), as Spark's estimator draws them.

    The estimator of ``pyspark.ml`` hands its rows to the one of ``pyspark.mllib``, turning rows into vectors in each of its passes. That is called here
    with vectors that are held as such, so the rows are turned once, however many runs there are.
    """
    vectors = _vectors(points, features).rdd.map(lambda r: OldVectors.fromML(r[0]))
    sc = points.sparkSession.sparkContext
    held = _to_java_object_rdd(vectors).rdd().persist(sc._getJavaStorageLevel(StorageLevel.MEMORY_AND_DISK_DESER))

    def start(run) -> np.ndarray:
        k, init, seed = run
        model = sc._jvm.org.apache.spark.mllib.clustering.KMeans().setK(k).setMaxIterations(0).setInitializationMode(_INIT[init]).setSeed(seed).run(held)
        return np.array([c.toArray() for c in model.clusterCenters()], dtype=float).reshape(-1, len(features))

    try:
        held.count()
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            return list(pool.map(start, runs))
    finally:
        held.unpersist(False)


def kmeans_runs(df: DataFrame, features: Sequence[str], runs: Sequence[tuple[int, str, int]], iters: Sequence[int],
                spark_tol: float | None = None, parallelism: int = 4) -> dict[tuple[int, str, int, int], tuple[float, dict[int, list[float]]]]:
    """Many K-means fits side by side: (cost, centres) of each run (k, init, seed) for each ``max_iter`` of ``iters``.

    Spark draws the first centres (``_first_centres``). The iterations of all runs then share their passes: one job sums the rows of every cluster
    of every run that has not converged, so the table is read once an iteration, however many runs there are. Steps, tolerance and
    cost (that of the last assignment) are the estimator's.
    """
    points = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    eps = spark_tol if spark_tol is not None else spark_tolerance(df, features)
    dims, runs = len(features), list(dict.fromkeys(runs))
    centres = _first_centres(points, features, runs, parallelism)
    cost, active, out = [0.0] * len(runs), set(range(len(runs))), {}
    names = [f"s{j}" for j in range(dims + 2)]
    for n in range(1, max(iters) + 1):
        if not active:
            break
        now = [(r, centres[r]) for r in sorted(active)]
        sums = points.mapInArrow(_cluster_sums(now, dims), "run int, cluster int, " + ", ".join(f"{c} double" for c in names))
        found = sums.groupBy("run", "cluster").agg(*[F.sum(c).alias(c) for c in names]).collect()  # one row a centre
        moved = {r: centres[r].copy() for r in active}
        for r in active:
            cost[r] = 0.0
        for row in found:
            moved[row["run"]][row["cluster"]] = [row[c] / row["s0"] for c in names[2:]]
            cost[row["run"]] += row["s1"]
        for r, new in moved.items():
            done = ((new - centres[r]) ** 2).sum(axis=1).max() <= eps * eps
            centres[r] = new
            if n in iters:
                out[*runs[r], n] = cost[r], {i: [float(v) for v in c] for i, c in enumerate(new)}
            if done:
                active.discard(r)
    for r, run in enumerate(runs):
        for n in iters:
            out.setdefault((*run, n), (cost[r], {i: [float(v) for v in c] for i, c in enumerate(centres[r])}))
    return out


def centroid_table(model: KMeansModel, names: Sequence[str] = ("PCA1", "PCA2")) -> dict[int, list[float]]:
    return {i: [float(v) for v in c] for i, c in enumerate(model.clusterCenters())}


def renumber(centroids: dict[int, Sequence[float]]) -> dict[int, list[float]]:
    """Q10: stable cluster ids, ordered by centroid coordinates ascending."""
    order = sorted(centroids, key=lambda i: tuple(centroids[i]))
    return {new: list(centroids[old]) for new, old in enumerate(order)}


def centroids_df(spark, centroids: dict[int, Sequence[float]], names: Sequence[str] = ("PCA1", "PCA2")) -> DataFrame:
    rows = [(int(i), *[float(v) for v in c]) for i, c in sorted(centroids.items())]
    return spark.createDataFrame(rows, "cluster int, " + ", ".join(f"{n} double" for n in names))


def total_sum_of_squares(df: DataFrame, features: Sequence[str]) -> float:
    """Inertia at k = 1 (Spark's KMeans rejects k = 1)."""
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs += [F.sum(x * x).alias(f"q_{f}"), F.sum(x).alias(f"s_{f}")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
    n = row["n"]
    return float(sum(row[f"q_{f}"] - row[f"s_{f}"] ** 2 / n for f in features)) if n else 0.0


def elbow(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(1, 11), seed: int = 42,
          max_iter: int = 300) -> DataFrame:
    """M5 inertia for each k."""
    fits = kmeans_runs(df, features, [(k, "k-means++", seed) for k in ks if k > 1], [max_iter])
    rows = [(int(k), total_sum_of_squares(df, features) if k == 1 else float(fits[k, "k-means++", seed, max_iter][0])) for k in ks]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double")


def best_restart(fits: dict, setting: dict, seed: int) -> tuple[float, dict[int, list[float]]]:
    """(cost, centres) of the first cheapest of a setting's ``n_init`` restarts in the result of ``kmeans_runs``."""
    return min((fits[setting["n_clusters"], setting["init"], seed + s, setting["max_iter"]] for s in range(setting["n_init"])), key=lambda x: x[0])


def kmeans_tuning(df: DataFrame, features: Sequence[str], grid: dict[str, list] | None = None,
                  seed: int = 42, parallelism: int = 4) -> tuple[dict, DataFrame]:
    """M6 fit every grid setting, score by silhouette; the first strict maximum
    (in grid order, unrounded) wins.

    Settings share their restarts: per (k, init) each seed runs once, to the largest ``max_iter``, its state at smaller ones is noted on the
    way, and ``n_init`` restarts are the first so many seeds. All restarts share their passes (``kmeans_runs``).
    """
    grid = grid or KMEANS_GRID
    names = list(grid)
    settings = [dict(zip(names, v)) for v in itertools.product(*[grid[n] for n in names])]
    seeds = range(seed, seed + max(grid["n_init"]))
    fits = kmeans_runs(df, features, list(itertools.product(grid["n_clusters"], grid["init"], seeds)), sorted(set(grid["max_iter"])), parallelism=parallelism)

    def score(centres) -> float | None:
        return silhouette_sq(assign_nearest(df.select(*features), features, dict(enumerate(centres))), features, "cluster", None).first()[0]

    chosen = [best_restart(fits, p, seed)[1] for p in settings]
    keys = [tuple(map(tuple, c.values())) for c in chosen]
    unique = list(dict.fromkeys(keys))
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        by_centres = dict(zip(unique, pool.map(score, unique)))
    rows, best, best_score = [], None, -math.inf
    for p, key in zip(settings, keys):
        s = by_centres[key]
        rows.append((*p.values(), s))
        if s is not None and s > best_score:
            best, best_score = p, s
    schema = ", ".join(f"{n} {'string' if isinstance(grid[n][0], str) else 'int'}" for n in names)
    return best, df.sparkSession.createDataFrame(rows, schema + ", silhouette double")


# ---- M9 ---------------------------------------------------------------------
def verdict(prediction: str = "prediction"):
    return F.when(F.col(prediction) == 1, VERDICT_DEFAULT).when(F.col(prediction) == 0, VERDICT_REPAY)


def cluster_description(cluster: str = "cluster"):
    """Description per cluster id with the fallback text for unknown ids
    (a 4-entry literal map: no join needed)."""
    m = F.create_map(*[x for k, v in CLUSTER_DESCRIPTIONS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[F.col(cluster)], F.lit(CLUSTER_UNKNOWN))
