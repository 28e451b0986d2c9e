"""Principal component analysis with MLlib.

``VectorAssembler -> StandardScaler(withMean) -> PCA``: MLlib's PCA takes
the covariance matrix from one distributed pass (p x p on the driver, p =
number of features) and does not centre on transform, so the scaler
centres (and, with ``standardize``, scales by the sample std).  Axis signs
are fixed by making each component's largest-magnitude loading positive.
Model-derived tables (variance, loadings) have p or k rows and are built
from the fitted model; projections are distributed transforms.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLDS = (0.80, 0.90, 0.95)


@dataclass
class PcaFit:
    features: list[str]
    components: np.ndarray      # p x k, sign-fixed
    ratios: np.ndarray          # k explained-variance ratios
    total_variance: float
    pipeline: object
    signs: np.ndarray
    means: dict

    @property
    def eigenvalues(self):
        return self.ratios * self.total_variance

    @property
    def loadings(self):
        return self.components * np.sqrt(self.eigenvalues)[None, :]


def fit_pca(df: DataFrame, features: list[str], k: int | None = None, standardize: bool = True) -> PcaFit:
    """Fit on every row: a missing value (null or NaN) counts as its column's mean."""
    k = k or len(features)
    means = _means(df, features)
    df = _filled(df, features, means)
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw", handleInvalid="error"),
        StandardScaler(withMean=True, withStd=standardize, inputCol="_raw", outputCol="_x"),
        PCA(k=k, inputCol="_x", outputCol="_pc")]).fit(df)
    pca = pipe.stages[-1]
    pc = pca.pc.toArray()
    signs = np.sign(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])])
    signs[signs == 0] = 1.0
    if standardize:
        total = float(len(features))
    else:
        total = float(sum(r or 0.0 for r in df.agg(*[F.var_samp(F.col(c)) for c in features]).first()))
    return PcaFit(features, pc * signs[None, :], pca.explainedVariance.toArray(), total, pipe, signs, means)


def _known(c: str):
    """The value as a double, null when it is null or NaN."""
    x = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(x), x)


def _means(df: DataFrame, features: list[str]) -> dict:
    row = df.agg(*[F.avg(_known(c)).alias(c) for c in features]).first()
    return {c: row[c] if row[c] is not None else 0.0 for c in features}


def _filled(df: DataFrame, features: list[str], means: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(_known(c), F.lit(means[c])) for c in features})


def pca_variance(spark: SparkSession, fit: PcaFit) -> DataFrame:
    r = fit.ratios
    rows = [(i + 1, float(r[i]), float(np.cumsum(r)[i])) for i in range(len(r))]
    return spark.createDataFrame(rows, "component int, variance_ratio double, cumulative double")


def pca_components_needed(spark: SparkSession, fit: PcaFit, thresholds=THRESHOLDS) -> DataFrame:
    cum = np.cumsum(fit.ratios)
    rows = []
    for t in thresholds:
        hit = np.nonzero(cum >= t - 1e-12)[0]
        rows.append((float(t), int(hit[0] + 1) if len(hit) else None))
    return spark.createDataFrame(rows, "threshold double, components int")


def pca_project(df: DataFrame, fit: PcaFit, n: int = 2, keep=("mqtt_message_id", "is_ddos")) -> DataFrame:
    """Scores on the first ``n`` components (sign-fixed) with the kept columns, for every row;
    a missing value counts as the fitted mean."""
    t = fit.pipeline.transform(_filled(df, fit.features, fit.means)).withColumn("_a", vector_to_array("_pc"))
    keep = [c for c in keep if c in df.columns]
    return t.select(*keep, *[(F.col("_a")[i] * F.lit(float(fit.signs[i]))).alias(f"PC{i + 1}") for i in range(n)])


def pca_loadings(spark: SparkSession, fit: PcaFit, top: int | None = None) -> DataFrame:
    """Per feature: loadings on PC1, PC2 (component x sqrt(eigenvalue)) and
    the contribution sqrt(l1^2 + l2^2), largest first."""
    L = fit.loadings
    rows = [(f, float(L[i, 0]), float(L[i, 1]) if L.shape[1] > 1 else 0.0) for i, f in enumerate(fit.features)]
    df = spark.createDataFrame(rows, "feature string, PC1 double, PC2 double")
    df = df.withColumn("contribution", F.sqrt(F.col("PC1") ** 2 + F.col("PC2") ** 2))
    df = df.orderBy(F.desc("contribution"), "feature")
    return df.limit(top) if top else df


def pca_contribution_percent(spark: SparkSession, fit: PcaFit, top: int = 15) -> DataFrame:
    """|component| as a percent of the component's total |weight|, for PC1 and PC2."""
    C = fit.components
    rows = []
    for j in range(min(2, C.shape[1])):
        tot = float(np.abs(C[:, j]).sum())
        for i, f in enumerate(fit.features):
            rows.append((f"PC{j + 1}", f, float(C[i, j]), float(abs(C[i, j]) * 100.0 / tot) if tot else None))
    from pyspark.sql import Window
    df = spark.createDataFrame(rows, "component string, feature string, weight double, percent double")
    w = Window.partitionBy("component").orderBy(F.desc("percent"), "feature")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def pca_heatmap_top(spark: SparkSession, fit: PcaFit, top: int = 20, n_components: int = 5) -> DataFrame:
    """Signed components of the ``top`` features by |PC1| + |PC2|."""
    C = fit.components
    m = min(n_components, C.shape[1])
    rows = [(f, float(abs(C[i, 0]) + (abs(C[i, 1]) if C.shape[1] > 1 else 0.0)),
             *[float(C[i, j]) for j in range(m)]) for i, f in enumerate(fit.features)]
    schema = "feature string, importance double, " + ", ".join(f"PC{j + 1} double" for j in range(m))
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature").limit(top)


def pca_circle(spark: SparkSession, fit: PcaFit, planes=((1, 2), (1, 3), (2, 3)), top: int = 15) -> DataFrame:
    """Correlation-circle coordinates (loadings) per plane, the ``top``
    features by distance from the origin in each plane."""
    L = fit.loadings
    rows = []
    for a, b in planes:
        if max(a, b) > L.shape[1]:
            continue
        for i, f in enumerate(fit.features):
            x, y = float(L[i, a - 1]), float(L[i, b - 1])
            rows.append((f"PC{a}-PC{b}", f, x, y, float(np.hypot(x, y))))
    from pyspark.sql import Window
    df = spark.createDataFrame(rows, "plane string, feature string, x double, y double, radius double")
    w = Window.partitionBy("plane").orderBy(F.desc("radius"), "feature")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).drop("rank")


def pca_reduced_dataset(df: DataFrame, features: list[str], variance: float = 0.90,
                        keep=("mqtt_message_id", "is_ddos"), standardize: bool = True):
    """Keep the fewest components reaching ``variance``; returns the
    projected frame and the reduction in percent of columns."""
    full = fit_pca(df, features, standardize=standardize)
    cum = np.cumsum(full.ratios)
    m = int(np.nonzero(cum >= variance - 1e-12)[0][0] + 1)
    fit = fit_pca(df, features, k=m, standardize=standardize)
    return pca_project(df, fit, m, keep), 100.0 * (1 - m / len(features))


def pca_reduction(spark: SparkSession, fit: PcaFit, variance: float = 0.90) -> DataFrame:
    """(n_features, n_components, reduction_pct, variance_pct) of the fewest components reaching ``variance``."""
    cum = np.cumsum(fit.ratios)
    m = int(np.nonzero(cum >= variance - 1e-12)[0][0] + 1)
    p = len(fit.features)
    return spark.createDataFrame([(p, m, 100.0 * (1 - m / p), 100.0 * float(cum[m - 1]))],
                                 "n_features int, n_components int, reduction_pct double, variance_pct double")
