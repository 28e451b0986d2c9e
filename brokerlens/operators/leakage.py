"""Data-leakage checks between features, target and the train/test parts.

Fixed values of the reference: |corr| > 0.95 (CRITICAL above 0.99);
sample variance < 1e-10; single-feature AUC > 0.99 or < 0.01; same
distribution when mean and std differ by < 0.005 train std and the value
overlap is > 0.995.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.functions.scalar import ratio
from brokerlens.operators.basic import running_sums
from brokerlens.operators.stats import _long_features, fit_scaler, standardize, target_correlation

HIGH_CORR, CRITICAL_CORR = 0.95, 0.99
ZERO_VAR = 1e-10
AUC_HIGH, AUC_LOW = 0.99, 0.01
SAME_DIST, SAME_OVERLAP = 0.005, 0.995


def leak_high_corr(train: DataFrame, cols: list[str], label: str = "is_ddos") -> DataFrame:
    tc = target_correlation(train, cols, label).select("feature", F.abs("corr").alias("correlation"))
    return (tc.where(F.col("correlation") > HIGH_CORR)
              .withColumn("severity", F.when(F.col("correlation") > CRITICAL_CORR, "CRITICAL").otherwise("HIGH")))


def leak_zero_variance(train: DataFrame, cols: list[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("feature"), F.var_samp(F.col(c).cast("double")).alias("variance"))
             for c in cols]
    v = train.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("r")).select("r.*")
    return v.where(F.col("variance") < ZERO_VAR)


def feature_auc(df: DataFrame, cols: list[str], label: str = "is_ddos") -> DataFrame:
    """ROC AUC of each raw feature as a score for the label (ties count
    half: Mann-Whitney with mid-ranks).  Per (feature, value): positives
    and negatives; negatives below each value come from distributed
    running sums; null AUC when a class is absent."""
    lf = _long_features(df, cols, label).where(F.col("x").isNotNull() & F.col("label").isNotNull())
    per = lf.groupBy("feature", "x").agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"),
                                         F.count(F.when(F.col("label") != 1, 1)).alias("neg"))
    cum = running_sums(per, ["feature"], "x", ["neg"])
    below = F.col("cum_neg") - F.col("neg")
    agg = cum.groupBy("feature").agg(
        F.sum(F.col("pos") * (below + F.col("neg") * F.lit(0.5))).alias("u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count(F.lit(1)).alias("n_values"))
    return agg.select("feature", ratio(F.col("u"), F.col("n_pos") * F.col("n_neg")).alias("auc"), "n_values")


def leak_perfect_auc(train: DataFrame, cols: list[str], label: str = "is_ddos") -> DataFrame:
    """Non-constant features whose AUC alone is > 0.99 or < 0.01."""
    a = feature_auc(train, cols, label)
    return (a.where((F.col("n_values") > 1) & ((F.col("auc") > AUC_HIGH) | (F.col("auc") < AUC_LOW)))
             .select("feature", "auc", F.lit("CRITICAL").alias("severity")))


def value_overlap(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Shared distinct values / distinct test values (at least 1), per feature.

    Null counts as a value, as ``set(series.unique())`` does."""
    def distinct_long(df):
        return _long_features(df.withColumn("_l", F.lit(0)), cols, "_l").select("feature", "x").distinct()
    tr, te = distinct_long(train), distinct_long(test)
    te2 = te.select(F.col("feature").alias("_f"), F.col("x").alias("_x"))
    shared = (tr.join(te2, on=[F.col("feature") == F.col("_f"), F.col("x").eqNullSafe(F.col("_x"))], how="inner")
                .select("feature"))
    n_shared = shared.groupBy("feature").agg(F.count(F.lit(1)).alias("n_shared"))
    n_tr = tr.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique_train"))
    n_te = te.groupBy("feature").agg(F.count(F.lit(1)).alias("n_unique_test"))
    j = n_tr.join(n_te, "feature", "full").join(n_shared, "feature", "left")
    return j.select("feature", F.coalesce("n_unique_train", F.lit(0)).alias("n_unique_train"),
                    F.coalesce("n_unique_test", F.lit(0)).alias("n_unique_test"),
                    (F.coalesce(F.col("n_shared"), F.lit(0)).cast("double")
                     / F.greatest(F.coalesce(F.col("n_unique_test"), F.lit(0)), F.lit(1))).alias("overlap_ratio"))


def _moments(df: DataFrame, cols: list[str], prefix: str) -> DataFrame:
    items = [F.struct(F.lit(c).alias("feature"), F.avg(F.col(c).cast("double")).alias(f"{prefix}_mean"),
                      F.stddev_samp(F.col(c).cast("double")).alias(f"{prefix}_std")) for c in cols]
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("r")).select("r.*")


def leak_same_distribution(train: DataFrame, test: DataFrame, cols: list[str],
                           only_flagged: bool = True) -> DataFrame:
    """Features whose train and test distributions are suspiciously identical
    (both std > 0).  ``only_flagged=False`` keeps every feature with a
    ``suspicious`` flag."""
    m = _moments(train, cols, "train").join(_moments(test, cols, "test"), "feature")
    j = m.join(value_overlap(train, test, cols), "feature")
    ok = (F.col("train_std") > 0) & (F.col("test_std") > 0)
    mdr = F.when(ok, F.abs(F.col("train_mean") - F.col("test_mean")) / F.col("train_std"))
    sdr = F.when(ok, F.abs(F.col("train_std") - F.col("test_std")) / F.col("train_std"))
    out = j.select("feature", mdr.alias("mean_diff_ratio"), sdr.alias("std_diff_ratio"), "overlap_ratio",
                   "train_mean", "test_mean", "train_std", "test_std", "n_unique_train", "n_unique_test")
    sus = F.coalesce((F.col("mean_diff_ratio") < SAME_DIST) & (F.col("std_diff_ratio") < SAME_DIST)
                     & (F.col("overlap_ratio") > SAME_OVERLAP), F.lit(False))
    out = out.withColumn("suspicious", sus)
    return out.where("suspicious") if only_flagged else out


def leak_report(train: DataFrame, test: DataFrame, cols: list[str], label: str = "is_ddos") -> DataFrame:
    """All findings in long form (check, feature, value, severity).  Zero
    variance is reported as a cleaning step, not counted as leakage."""
    parts = [
        leak_high_corr(train, cols, label).select(F.lit("high_correlation").alias("check"), "feature",
                                                  F.col("correlation").alias("value"), "severity"),
        leak_perfect_auc(train, cols, label).select(F.lit("perfect_predictor").alias("check"), "feature",
                                                    F.col("auc").alias("value"), "severity"),
        leak_same_distribution(train, test, cols).select(F.lit("same_distribution").alias("check"), "feature",
                                                         F.col("overlap_ratio").alias("value"),
                                                         F.lit("WARNING").alias("severity")),
        leak_zero_variance(train, cols).select(F.lit("zero_variance").alias("check"), "feature",
                                               F.col("variance").alias("value"), F.lit("CLEANING").alias("severity")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def leaky_features(report: DataFrame, drop_same_distribution: bool = False) -> list[str]:
    """Features to drop: zero variance, CRITICAL correlation, every perfect
    predictor, and optionally same-distribution ones (a short list)."""
    cond = ((F.col("check") == "zero_variance") | (F.col("check") == "perfect_predictor")
            | ((F.col("check") == "high_correlation") & (F.col("severity") == "CRITICAL")))
    if drop_same_distribution:
        cond = cond | (F.col("check") == "same_distribution")
    return sorted({r["feature"] for r in report.where(cond).select("feature").distinct().collect()})


def remove_leaky_features(df: DataFrame, report: DataFrame, drop_same_distribution: bool = False) -> DataFrame:
    return df.drop(*leaky_features(report, drop_same_distribution))


def remove_and_standardize(train: DataFrame, test: DataFrame, cols: list[str], report: DataFrame, drop_same_distribution: bool = False):
    """(train, test, kept features): both parts without the condemned features, the others standardised anew with the
    training part's statistics, as they are fitted again after the drop."""
    gone = set(leaky_features(report, drop_same_distribution))
    kept = [c for c in cols if c not in gone]
    drop = [c for c in cols if c in gone]
    train, test = train.drop(*drop), test.drop(*drop)
    params = fit_scaler(train, kept)
    return standardize(train, params, kept), standardize(test, params, kept), kept


def single_class_check(df: DataFrame, label: str = "is_ddos") -> DataFrame:
    return (df.agg(F.countDistinct(label).alias("n_classes"))
              .withColumn("single_class", F.col("n_classes") < 2))
