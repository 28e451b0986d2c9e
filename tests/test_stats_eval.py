"""Invariants and cross-checks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brokerlens.operators import evaluate as EV
from brokerlens.operators import leakage as L
from brokerlens.operators import profile as P
from brokerlens.operators import stats as ST
from brokerlens.operators.basic import dense_codes, histogram, running_sums
from brokerlens.operators.cleaning import (align_columns, constant_columns, count_infinite, fit_medians,
                                           impute_median, replace_infinite)
from tests.helpers import frame, msg


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(7)
    n = 3000
    y = rng.integers(0, 2, n)
    s = np.round(rng.random(n) * 0.6 + y * 0.3, 2)     # ties on purpose
    rows = [(int(i), int(y[i]), int(s[i] > 0.5), float(s[i])) for i in range(n)]
    return spark.createDataFrame(rows, "mqtt_message_id long, label int, prediction int, probability double"), y, s


def _auc_numpy(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return gt / (len(pos) * len(neg))


def test_auc_matches_brute_force_and_mllib(spark, scored):
    df, y, s = scored
    auc = EV.roc_auc(df).first()["roc_auc"]
    assert abs(auc - _auc_numpy(y, s)) < 1e-12
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    ev = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="label", numBins=0)
    raw = df.select(F.col("label").cast("double").alias("label"),
                    array_to_vector(F.array(-F.col("probability"), F.col("probability"))).alias("raw"))
    assert abs(ev.evaluate(raw) - auc) < 1e-9
    flipped = df.withColumn("probability", -F.col("probability"))
    assert abs(EV.roc_auc(flipped).first()["roc_auc"] + auc - 1.0) < 1e-12


def test_auc_one_class_is_null(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (0, 0, 0.2)], "label int, prediction int, probability double")
    assert EV.roc_auc(df).first()["roc_auc"] is None
    m = EV.binary_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1"]) == (0.0, 0.0, 0.0) and m["accuracy"] == 1.0


def test_confusion_sums_to_n_and_report(spark, scored):
    df, y, s = scored
    cm = EV.confusion_matrix(df).collect()
    assert sum(r["count"] for r in cm) == len(y)
    pct = EV.confusion_percent(df).collect()
    for lab in (0, 1):
        assert abs(sum(r["percent"] for r in pct if r["label"] == lab) - 100.0) < 1e-9
    rep = {r["class"]: r for r in EV.classification_report(df).collect()}
    assert rep["accuracy"]["support"] == len(y)
    assert rep["0"]["support"] + rep["1"]["support"] == len(y)


def test_roc_curve_monotone(spark, scored):
    df, _, _ = scored
    pts = [(r["fpr"], r["tpr"]) for r in EV.roc_curve(df).orderBy(F.desc("threshold")).collect()]
    assert all(a[0] <= b[0] and a[1] <= b[1] for a, b in zip(pts, pts[1:]))
    assert pts[-1] == (1.0, 1.0)


def test_running_sums_and_dense_codes(spark):
    rows = [(g, float(v), 1) for g in ("a", "b") for v in range(1, 101)] + [("a", 50.0, 1)]
    df = spark.createDataFrame(rows, "g string, v double, w int")
    got = {(r["g"], r["v"]): r["cum_w"] for r in running_sums(df, ["g"], "v", ["w"], parts=7).collect()}
    assert got[("a", 50.0)] == 51 and got[("a", 49.0)] == 49 and got[("b", 100.0)] == 100
    vals = spark.createDataFrame([(x,) for x in ["b", "a", "B", "a", None, "c"]], "v string")
    codes = {r["v"]: r["code"] for r in dense_codes(vals, "v").collect()}
    assert codes == {"B": 0, "a": 1, "b": 2, "c": 3}


def test_histogram_counts_sum_to_n_and_constant_range(spark):
    df = spark.createDataFrame([(float(x),) for x in range(101)], "x double")
    h = histogram(df, "x", 10).orderBy("bin").collect()
    assert sum(r["count"] for r in h) == 101 and h[-1]["count"] == 11       # last bin closed
    c = spark.createDataFrame([(5.0,)] * 4, "x double")
    hc = histogram(c, "x", 3).orderBy("bin").collect()
    assert [r["count"] for r in hc] == [0, 4, 0] and hc[0]["bin_lo"] == 4.5


def test_correlation_matches_numpy_and_constant_is_null(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=500)
    b = a * 0.5 + rng.normal(size=500)
    c = np.where(np.arange(500) % 7 == 0, np.nan, rng.normal(size=500) + a)
    rows = [(float(a[i]), float(b[i]), None if np.isnan(c[i]) else float(c[i]), 1.0) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    cm = {(r["feature_x"], r["feature_y"]): r["corr"] for r in ST.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    m = ~np.isnan(c)
    assert abs(cm[("a", "b")] - np.corrcoef(a, b)[0, 1]) < 1e-10
    assert abs(cm[("a", "c")] - np.corrcoef(a[m], c[m])[0, 1]) < 1e-10        # pairwise complete
    assert cm[("a", "k")] is None and cm[("k", "k")] is None and abs(cm[("a", "a")] - 1) < 1e-12
    assert cm[("b", "a")] == cm[("a", "b")]


def test_anova_matches_formula(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    x = rng.normal(size=400) + y
    df = spark.createDataFrame([(float(x[i]), int(y[i])) for i in range(400)], "x double, is_ddos int")
    f = ST.anova_f(df, ["x"]).first()["f_score"]
    g = [x[y == k] for k in (0, 1)]
    ssb = sum(len(v) * (v.mean() - x.mean()) ** 2 for v in g)
    ssw = sum(((v - v.mean()) ** 2).sum() for v in g)
    assert abs(f - (ssb / 1) / (ssw / (400 - 2))) < 1e-8 and f >= 0


def test_encoding_unseen_maps_to_missing(spark):
    tr = spark.createDataFrame([("x",), ("y",), ("x",)], "c string")
    te = spark.createDataFrame([("y",), ("zz",), (None,)], "c string")
    emap = ST.encoding_map(tr, ["c"])
    codes = {r["value"]: r["code"] for r in emap.collect()}
    assert codes == {"MISSING": 0, "x": 1, "y": 2}
    out = [r["c_encoded"] for r in ST.label_encode_apply(te, emap, ["c"]).orderBy("c_encoded").collect()]
    assert sorted(out) == [0, 0, 2]


def test_booleans_encode_like_pandas_text(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "b boolean")
    codes = {r["value"]: r["code"] for r in ST.encoding_map(df, ["b"]).collect()}
    assert codes == {"False": 0, "MISSING": 1, "True": 2}


def test_nonfinite_cleaning(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (None,), (3.0,)], "x double")
    assert count_infinite(df).first()[0] == 2
    clean = replace_infinite(df)
    med = fit_medians(clean, ["x"])
    assert med == {"x": 2.0}
    assert sorted(r[0] for r in impute_median(clean, med).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_constant_and_align(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 5, None)], "a int, k int, n int")
    const = {r["column"]: r["constant"] for r in constant_columns(df).collect()}
    assert const == {"a": False, "k": True, "n": True}
    assert align_columns(df.select("a"), ["k", "a"]).columns == ["k", "a"]


def test_leakage_flags(spark):
    rows = [(float(i % 2), float(i % 2), float(i % 3), 7.0, i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "leak double, leak2 double, noise double, const double, is_ddos int")
    feats = ["leak", "leak2", "noise", "const"]
    rep = {(r["check"], r["feature"]) for r in L.leak_report(df, df, feats).collect()}
    assert ("high_correlation", "leak") in rep and ("perfect_predictor", "leak") in rep
    assert ("zero_variance", "const") in rep and ("same_distribution", "noise") in rep
    assert ("perfect_predictor", "const") not in rep
    assert L.leaky_features(L.leak_report(df, df, feats)) == ["const", "leak", "leak2"]


def test_profile_describe_matches_numpy(spark):
    x = np.array([1.0, 2.0, 4.0, 8.0, 16.0, 3.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    d = P.describe_numeric(df, ["x"]).first()
    assert abs(d["std"] - x.std(ddof=1)) < 1e-12
    assert abs(d["q25"] - np.percentile(x, 25)) < 1e-12 and d["q50"] == np.median(x)
    b = P.boxplot_stats(df, ["x"]).first()
    assert b["outliers"] == 1 and b["upper_whisker"] == 8.0


def test_exact_quantiles_match_numpy_and_repeat(spark):
    from brokerlens.operators.basic import exact_quantiles
    rng = np.random.default_rng(1)
    rows = [("a", float(v)) for v in rng.integers(0, 5000, 20001)] + [("b", float(v)) for v in rng.normal(size=10)]
    rows += [("c", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.25, 0.5, 0.75, 1.0]
    first = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["g"], "x", qs).collect()}
    again = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["g"], "x", qs).collect()}
    assert first == again
    for g in "abc":
        xs = np.array([v for gg, v in rows if gg == g])
        for q in qs:
            assert abs(first[(g, q)] - np.percentile(xs, q * 100)) < 1e-9
    glob = exact_quantiles(df, [], "x", [0.5]).first()["value"]
    assert abs(glob - np.median([v for _, v in rows])) < 1e-9
