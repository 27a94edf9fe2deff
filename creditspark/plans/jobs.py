"""Training and scoring jobs (notebook order, with the split before scaling and SMOTE, so no
test row informs these two; imputation values, outlier fences and encoder categories are
fitted on all cleaned rows, as in the notebook).

Fitted artefacts are small tables (encoders, scaler statistics, PCA loadings,
centroids, feature order) plus ``pyspark.ml`` models; they are saved below the
shared folder so any executor or a later job can load them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate as V
from ..operators import features as Fe
from ..operators import models as M
from ..operators import sampling as R
from ..sources import KEY, LABEL
from ..sources.files import load_model, nan_to_null, save_model, write_stage
from ..sources.versions import commit, current, new_folder
from . import prepare as PR

PCA_NAMES = ["PCA1", "PCA2"]


# ---- classifier -----------------------------------------------------------------
@dataclass
class ClassifierBundle:
    imputation: PR.Imputation
    encoders: PR.Encoders
    features: list[str]
    scaler: Fe.ScalerModel
    model: PipelineModel

    def save(self, spark: SparkSession, path: str) -> str:
        """One version of the bundle as a whole (``sources.versions``): a save that fails half way leaves the version before."""
        folder = new_folder(spark, path)
        self.imputation.to_df(spark).write.parquet(f"{folder}/imputation")
        self.encoders.one_hot.to_df(spark).write.parquet(f"{folder}/one_hot")
        self.encoders.labels.to_df(spark).write.parquet(f"{folder}/labels")
        self.scaler.to_df(spark).write.parquet(f"{folder}/scaler")
        spark.createDataFrame(list(enumerate(self.features)), "position int, feature string").write.parquet(f"{folder}/features")
        save_model(self.model, f"{folder}/model")
        commit(spark, path, folder, checked=True)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ClassifierBundle":
        """The newest whole version; its files must be those that were saved."""
        folder = current(spark, path, check=True)
        feats = [r["feature"] for r in sorted(spark.read.parquet(f"{folder}/features").collect(),
                                              key=lambda r: r["position"])]
        return ClassifierBundle(
            PR.Imputation.from_df(spark.read.parquet(f"{folder}/imputation")),
            PR.Encoders(Fe.OneHotModel.from_df(spark.read.parquet(f"{folder}/one_hot")),
                        Fe.LabelEncoderModel.from_df(spark.read.parquet(f"{folder}/labels"))),
            feats, Fe.ScalerModel.from_df(spark.read.parquet(f"{folder}/scaler")),
            load_model(f"{folder}/model"))


@dataclass
class Prepared:
    """What training needs: the balanced training rows, the scaled test rows and everything fitted on the way."""
    imputation: PR.Imputation
    encoders: PR.Encoders
    features: list[str]
    scaler: Fe.ScalerModel
    balanced: DataFrame
    test: DataFrame

    def bundle(self, model: PipelineModel) -> ClassifierBundle:
        return ClassifierBundle(self.imputation, self.encoders, self.features, self.scaler, model)

    def score(self, model: PipelineModel) -> DataFrame:
        """Key, label, prediction and score of the held-out rows."""
        return M.predict(model, self.test, keep=[KEY, F.col(LABEL).alias("label")])


def prepare_classifier(raw: DataFrame, stage_dir: str, seed: int = 42, split_first: bool = True) -> Prepared:
    """Clean -> engineer -> split -> scale (train stats) -> SMOTE (train).

    ``split_first=False`` is the reference's order: scale and oversample everything, then split; test rows
    then inform scaling and hold synthetic rows, so its metrics are optimistic.
    The cleaned and balanced tables are written as stages, which cuts the
    lineage before the fits and the model's iterations.
    """
    cleaned, imputation = PR.clean_and_fit(raw)
    cleaned = write_stage(cleaned, "data_outlier", f"{stage_dir}/data_outlier")
    eng, enc = PR.engineer(cleaned)
    feats = PR.feature_columns(eng)
    if split_first:
        train, test = R.train_test_split(eng, KEY, 0.2, seed)
        train_s, scaler = PR.scaled_features(train, feats)
        test_s = scaler.transform(test, fill_null=0.0)
        balanced = R.smote(train_s, feats, LABEL, KEY, k=5, seed=seed)
        balanced = write_stage(balanced, "data_balanced", f"{stage_dir}/data_balanced")
    else:
        scaled, scaler = PR.scaled_features(eng, feats)
        every = write_stage(R.smote(scaled, feats, LABEL, KEY, k=5, seed=seed), "data_balanced", f"{stage_dir}/data_balanced")
        # a row's draw depends on its key and copy, so synthetic rows are dealt on their own
        held = F.pmod(F.xxhash64(F.lit(seed), KEY, "copy_no"), F.lit(1000)) < 200
        balanced, test_s = every.where(~held), every.where(held)
    return Prepared(imputation, enc, feats, scaler, balanced, test_s)


def train_classifier(raw: DataFrame, stage_dir: str, seed: int = 42, split_first: bool = True,
                     **gbt_params) -> tuple[ClassifierBundle, DataFrame]:
    """Prepare, then fit. Returns the bundle and the scored test rows (key, label, prediction, score)."""
    p = prepare_classifier(raw, stage_dir, seed, split_first)
    model = M.fit_gbt(p.balanced, p.features, LABEL, seed, **gbt_params)
    return p.bundle(model), p.score(model)


def tune_classifier(raw: DataFrame, stage_dir: str, grid: dict[str, list] | None = None, folds: int = 5, seed: int = 42,
                    parallelism: int = 4, ledger: str | None = None, max_fits: int | None = None,
                    **untuned) -> tuple[ClassifierBundle, ClassifierBundle | None, DataFrame, DataFrame]:
    """M2 + V8: the model with default settings, the best of the grid refitted on all training rows, the table of all
    settings, and the before/after table of both on the same held-out rows.

    ``ledger`` and ``max_fits`` are those of ``grid_search``; while fits are missing there is no tuned model and no row of it.

    As in the reference, folds are cut after oversampling: a synthetic row and its parents may fall into different
    folds, so fold accuracies are optimistic; the held-out rows are not touched by it.
    """
    p = prepare_classifier(raw, stage_dir, seed)
    plain = M.fit_gbt(p.balanced, p.features, LABEL, seed, **untuned)
    best, table = M.grid_search(p.balanced, p.features, LABEL, grid, folds, parallelism, seed, ledger, max_fits)
    scored = {name: write_stage(p.score(m), name, f"{stage_dir}/scored_{name}") for name, m in (("untuned", plain), ("tuned", best)) if m is not None}
    return p.bundle(plain), p.bundle(best) if best is not None else None, table, V.stage_comparison(scored)


# ---- clusterer ------------------------------------------------------------------
@dataclass
class ClusterBundle:
    scaler: Fe.ScalerModel
    pca: Fe.PCAModel2
    centroids: dict[int, list[float]]

    def assign(self, df: DataFrame) -> DataFrame:
        """M8 scale (saved stats) -> PCA (saved loadings) -> nearest centroid,
        appended as PCA1, PCA2, cluster; all column expressions."""
        z = {c: F.coalesce(self.scaler.expr(c), F.lit(0.0)) for c in self.pca.columns}
        comps = []
        for name, w in zip(PCA_NAMES, self.pca.loadings):
            e = None
            for c, wj in zip(self.pca.columns, w):
                e = z[c] * F.lit(float(wj)) if e is None else e + z[c] * F.lit(float(wj))
            comps.append(e.alias(name))
        return V.assign_nearest(df.select("*", *comps), PCA_NAMES, self.centroids, "cluster")

    def save(self, spark: SparkSession, path: str) -> str:
        """One version of the bundle as a whole, as ``ClassifierBundle.save``."""
        folder = new_folder(spark, path)
        self.scaler.to_df(spark).write.parquet(f"{folder}/scaler")
        self.pca.to_df(spark).write.parquet(f"{folder}/pca")
        M.centroids_df(spark, self.centroids, PCA_NAMES).write.parquet(f"{folder}/centroids")
        commit(spark, path, folder, checked=True)
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ClusterBundle":
        folder = current(spark, path, check=True)
        cents = {r["cluster"]: [r[n] for n in PCA_NAMES] for r in spark.read.parquet(f"{folder}/centroids").collect()}
        return ClusterBundle(Fe.ScalerModel.from_df(spark.read.parquet(f"{folder}/scaler")),
                             Fe.PCAModel2.from_df(spark.read.parquet(f"{folder}/pca")), cents)


def pca_points(cleaned: DataFrame) -> tuple[DataFrame, Fe.ScalerModel, Fe.PCAModel2]:
    """F5 + F8 on the four clustering columns: (key, PCA1, PCA2)."""
    pts = cleaned.select(KEY, *Fe.CLUSTER_FEATURES)
    scaler = Fe.fit_scaler(pts, Fe.CLUSTER_FEATURES)
    scaled = scaler.transform(pts, fill_null=0.0)
    pca = Fe.fit_pca(scaled, Fe.CLUSTER_FEATURES, 2)
    return pca.transform(scaled, PCA_NAMES, keep=[KEY]), scaler, pca


def train_clusterer(cleaned: DataFrame, stage_dir: str, k: int = 4, seed: int = 42, max_iter: int = 300,
                    init: str = "k-means++", n_init: int = 1) -> tuple[ClusterBundle, DataFrame]:
    """Scale -> PCA(2) -> K-means; clusters renumbered by centroid order (Q10).
    Returns the bundle and (key, PCA1, PCA2, cluster)."""
    pcs, scaler, pca = pca_points(cleaned)
    pcs = write_stage(pcs, "pca_result", f"{stage_dir}/pca_result")
    km = M.fit_kmeans(pcs, PCA_NAMES, k=k, seed=seed, max_iter=max_iter, init=init, n_init=n_init)
    cents = M.renumber(M.centroid_table(km))
    bundle = ClusterBundle(scaler, pca, cents)
    return bundle, V.assign_nearest(pcs, PCA_NAMES, cents, "cluster")


def tune_clusterer(cleaned: DataFrame, stage_dir: str, grid: dict[str, list] | None = None, seed: int = 42,
                   parallelism: int = 4) -> tuple[ClusterBundle, DataFrame, DataFrame]:
    """M6 + M7: try every setting, refit with the winner. Returns the bundle, its (key, PCA1, PCA2, cluster) and the table."""
    pcs, scaler, pca = pca_points(cleaned)
    pcs = write_stage(pcs, "pca_result", f"{stage_dir}/pca_result")
    best, table = M.kmeans_tuning(pcs, PCA_NAMES, grid, seed, parallelism)
    restarts = [(best["n_clusters"], best["init"], seed + s) for s in range(best["n_init"])]
    refit = M.best_restart(M.kmeans_runs(pcs, PCA_NAMES, restarts, [best["max_iter"]], parallelism=parallelism), best, seed)
    cents = M.renumber(refit[1])
    return ClusterBundle(scaler, pca, cents), V.assign_nearest(pcs, PCA_NAMES, cents, "cluster"), table


# ---- M9 scoring ---------------------------------------------------------------------
def normalise_applications(apps: DataFrame) -> DataFrame:
    """Q7: the form's Yes/No becomes the data's Y/N."""
    c = F.col("cb_person_default_on_file")
    return apps.withColumn("cb_person_default_on_file",
                           F.when(c == "Yes", "Y").when(c == "No", "N").otherwise(c))


def application_features(apps: DataFrame, imputation: PR.Imputation, encoders: PR.Encoders) -> DataFrame:
    """Applications as training saw its rows: NaN as NULL, Yes/No as Y/N, missing values filled with the training values
    before the ratios are formed, then bins, one-hot columns and label codes."""
    filled = imputation.apply(normalise_applications(nan_to_null(apps)))
    return PR.engineer(filled, encoders)[0]


def score_applications(apps: DataFrame, clf: ClassifierBundle, clu: ClusterBundle) -> DataFrame:
    """M9 batch (or streaming) scoring: verdict and segment for every application.

    Per row: saved imputation, cluster expressions, feature engineering with the
    training encoders, schema alignment, saved scaling, the GBT model, and
    literal-map texts. The only join is with the (static) label codes, so the same function runs on a
    streaming DataFrame.
    """
    filled = clf.imputation.apply(normalise_applications(nan_to_null(apps)))
    eng, _ = PR.engineer(clu.assign(filled).drop("PCA1", "PCA2"), clf.encoders)
    aligned = Fe.align_schema(eng, clf.features, keep=[KEY, "cluster"])
    scaled = clf.scaler.transform(aligned, fill_null=0.0)
    pred = M.predict(clf.model, scaled, keep=[KEY, "cluster"])
    return pred.select(KEY, "prediction", F.round("score", 6).alias("score"), M.verdict().alias("verdict"),
                       "cluster", M.cluster_description().alias("description"))
