"""Classifier evaluation on a scored table (label, prediction, probability).

Every function takes optional ``by`` columns (e.g. ``model``, ``part``) so
several models are evaluated in one aggregate; with ``weight`` a row stands for as
many rows as that column says.  Ratios whose denominator is
0 are 0, as sklearn's ``zero_division=0``; AUC is null with one class.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.operators.basic import histogram, running_sums, share_within

# Fixed values of the reference
OVERFIT_HIGH, OVERFIT_MODERATE = 0.1, 0.05
SUSPICIOUS_ACC = 0.95
F1_EXCELLENT, F1_GOOD = 0.8, 0.6
F1_READY, GAP_READY = 0.9, 0.05


def _z(num, den):
    """num / den, 0 when den is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _rows(condition, weight):
    """How many rows meet the condition."""
    return F.count(F.when(condition, 1)) if weight is None else F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0))


def _counts(df: DataFrame, by, weight=None):
    y, p = F.col("label"), F.col("prediction")
    return df.groupBy(*by).agg(
        _rows((y == 1) & (p == 1), weight).alias("tp"), _rows((y == 0) & (p == 1), weight).alias("fp"),
        _rows((y == 1) & (p == 0), weight).alias("fn"), _rows((y == 0) & (p == 0), weight).alias("tn"))


def confusion_matrix(df: DataFrame, by=()) -> DataFrame:
    """(label, prediction, cell, count): the four cells, 0 filled."""
    c = _counts(df, list(by))
    cells = F.array(*[F.struct(F.lit(l).alias("label"), F.lit(p).alias("prediction"), F.lit(n).alias("cell"),
                               F.col(n.lower()).alias("count"))
                      for l, p, n in ((0, 0, "TN"), (0, 1, "FP"), (1, 0, "FN"), (1, 1, "TP"))])
    return c.select(*by, F.explode(cells).alias("r")).select(*by, "r.*")


def confusion_percent(df: DataFrame, by=()) -> DataFrame:
    """Confusion cells as percent of their true class (row percent)."""
    return share_within(confusion_matrix(df, by), "count", [*by, "label"], "percent")


def binary_metrics(df: DataFrame, by=(), weight: str | None = None) -> DataFrame:
    c = _counts(df, list(by), weight)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec, rec = _z(tp, tp + fp), _z(tp, tp + fn)
    return c.select(*by, _z(tp + tn, tp + fp + fn + tn).alias("accuracy"), prec.alias("precision"),
                    rec.alias("recall"), _z(F.lit(2.0) * prec * rec, prec + rec).alias("f1"))


def rate_metrics(df: DataFrame, by=()) -> DataFrame:
    c = _counts(df, list(by))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, _z(tp, tp + fn).alias("tpr"), _z(tn, tn + fp).alias("tnr"),
                    _z(fp, fp + tn).alias("fpr"), _z(fn, fn + tp).alias("fnr"))


def _score_counts(df: DataFrame, by, weight=None):
    return (df.where(F.col("probability").isNotNull() & F.col("label").isNotNull())
              .groupBy(*by, "probability")
              .agg(_rows(F.col("label") == 1, weight).alias("pos"), _rows(F.col("label") != 1, weight).alias("neg")))


def roc_auc(df: DataFrame, by=(), weight: str | None = None) -> DataFrame:
    """Area under the ROC curve, ties counted half (Mann-Whitney).  Scores
    are first reduced to distinct values; negatives below each score come
    from distributed running sums.  Null when a class is absent."""
    by = list(by)
    cum = running_sums(_score_counts(df, by, weight), by, "probability", ["neg"])
    u = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") + F.col("neg") * F.lit(0.5)))
    agg = cum.groupBy(*by).agg(u.alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return agg.select(*by, F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")).alias("roc_auc"))


def roc_curve(df: DataFrame, by=()) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, from the highest down: the share of each class scored at or
    above the threshold; before them the start (0, 0), with an infinite threshold."""
    by = list(by)
    counts = _score_counts(df, by)
    cum = running_sums(counts, by, "probability", ["pos", "neg"], descending=True)
    tot = counts.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.count(F.lit(1)).alias("n_scores"))
    if by:
        j = cum.join(tot, by)
    else:  # one-row totals as scalar subqueries
        j = cum.withColumn("n_pos", tot.select("n_pos").scalar()).withColumn("n_neg", tot.select("n_neg").scalar())
    start = tot.where("n_scores > 0").select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return j.select(*by, F.col("probability").alias("threshold"),
                    _z(F.col("cum_neg"), F.col("n_neg")).alias("fpr"), _z(F.col("cum_pos"), F.col("n_pos")).alias("tpr")).unionByName(start)


def classification_report(df: DataFrame, by=()) -> DataFrame:
    """Per class precision / recall / F1 / support, then accuracy, macro
    and weighted averages (accuracy in the f1 column, as sklearn prints it)."""
    by = list(by)
    c = _counts(df, by)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = _z(tp, tp + fp), _z(tp, tp + fn)
    p0, r0 = _z(tn, tn + fn), _z(tn, tn + fp)
    f1_1, f1_0 = _z(F.lit(2.0) * p1 * r1, p1 + r1), _z(F.lit(2.0) * p0 * r0, p0 + r0)
    s1, s0 = (tp + fn), (tn + fp)
    n = s1 + s0
    def row(name, p, r, f, sup):
        return F.struct(F.lit(name).alias("class"), p.cast("double").alias("precision"),
                        r.cast("double").alias("recall"), f.alias("f1"), sup.alias("support"))
    none = F.lit(None).cast("double")
    rows = F.array(
        row("0", p0, r0, f1_0, s0), row("1", p1, r1, f1_1, s1), row("accuracy", none, none, _z(tp + tn, n), n),
        row("macro avg", (p0 + p1) / F.lit(2.0), (r0 + r1) / F.lit(2.0), (f1_0 + f1_1) / F.lit(2.0), n),
        row("weighted avg", _z(p0 * s0 + p1 * s1, n), _z(r0 * s0 + r1 * s1, n), _z(f1_0 * s0 + f1_1 * s1, n), n))
    return c.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def probability_histogram(df: DataFrame, bins: int = 30, by=()) -> DataFrame:
    """Histogram of the predicted probability per true class."""
    return histogram(df, "probability", bins, by=[*by, "label"])


def model_metrics(scored: DataFrame, by=("model",)) -> DataFrame:
    """accuracy, precision, recall, f1 and roc_auc per model (one row each)."""
    return binary_metrics(scored, by).join(roc_auc(scored, by), list(by))


def overfit_band(gap):
    return (F.when(gap > OVERFIT_HIGH, "overfitting").when(gap > OVERFIT_MODERATE, "slight overfitting")
             .otherwise("ok"))


def model_comparison(scored: DataFrame, part: str = "part") -> DataFrame:
    """Per model: test metrics, train accuracy, gap = train - test accuracy,
    its band, and whether the model has the best test F1 (ties by name)."""
    m = model_metrics(scored.where(F.col(part) == "test"))
    tr = binary_metrics(scored.where(F.col(part) == "train"), ["model"]).select(
        "model", F.col("accuracy").alias("train_accuracy"))
    j = m.join(tr, "model", "left")
    gap = F.col("train_accuracy") - F.col("accuracy")
    best = j.agg(F.min_by("model", F.struct(-F.col("f1"), F.col("model")))).scalar()
    return j.select("model", "accuracy", "precision", "recall", "f1", "roc_auc", "train_accuracy",
                    gap.alias("gap"), overfit_band(gap).alias("overfit"), (F.col("model") == best).alias("best"))


def model_ranking(comparison: DataFrame, top: int = 3) -> DataFrame:
    """Models by test F1 (ties by name), the first ``top`` of them.  The
    comparison table has one row per model."""
    ranked = comparison.orderBy(F.desc("f1"), "model").limit(top)
    from pyspark.sql import Window
    w = Window.orderBy(F.desc("f1"), "model")
    return ranked.select("model", "f1", "accuracy", F.row_number().over(w).alias("rank"))


def model_diagnosis(metrics: DataFrame) -> DataFrame:
    acc, f1 = F.col("accuracy"), F.col("f1")
    verdict = (F.when(acc == 1.0, "perfect accuracy: check for leakage")
                .when(acc > SUSPICIOUS_ACC, "very high accuracy: verify")
                .when(f1 > F1_EXCELLENT, "excellent")
                .when(f1 > F1_GOOD, "good")
                .otherwise("needs improvement"))
    return metrics.withColumn("diagnosis", verdict)


def model_recommendation(comparison: DataFrame) -> DataFrame:
    f1, gap = F.col("f1"), F.col("gap")
    rec = (F.when((f1 > F1_READY) & (gap < GAP_READY), "ready for production")
            .when(gap > OVERFIT_HIGH, "overfitting: regularise or simplify")
            .otherwise("good, can be improved"))
    return comparison.select("model", "f1", "gap", rec.alias("recommendation"))


def union_scored(parts: dict) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts.values())
