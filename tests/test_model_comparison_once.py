"""The comparison searches neighbours once and scores every row once; the svm fits equal rows once, with their number."""

import numpy as np
from pyspark.sql import functions as F

from brokerlens.operators import knn
from brokerlens.operators import models as M


def table(spark, n, seed, copies=1):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 2)).round(2)
    y = (X[:, 0] + rng.normal(0, 0.3, n) > 0.2).astype(int)
    rows = [(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate([*zip(X, y)] * copies)]
    return spark.createDataFrame(rows, "mqtt_message_id long, a double, b double, is_ddos int")


def test_neighbours_are_searched_once_for_every_k_and_part(spark, monkeypatch):
    tr, te = table(spark, 400, 1), table(spark, 90, 2)
    want = {k: [{r[0]: r.probability for r in M.knn_predict(tr, d, ["a", "b"], k).collect()} for d in (te, tr)] for k in (3, 10)}
    searches, real = [], knn.neighbour_counts
    monkeypatch.setattr(knn, "neighbour_counts", lambda *a: searches.append(a[2]) or real(*a))
    got = M.knn_predict_each(tr, [te, tr], ["a", "b"], [3, 10])
    assert {k: [{r[0]: r.probability for r in d.collect()} for d in v] for k, v in got.items()} == want
    rows = {r.model: r for r in M.compare_models(tr, te, ["a", "b"], ["knn_3", "naive_bayes", "knn_10"]).collect()}
    assert searches == [10, 10]
    for k in (3, 10):
        right = np.mean([(want[k][0][r[0]] > 0.5) == r.is_ddos for r in te.collect()])
        assert abs(rows[f"knn_{k}"].accuracy - right) < 1e-12


def test_scores_are_computed_once(spark):
    tr, te = table(spark, 300, 1), table(spark, 80, 2)
    calls = spark.sparkContext.accumulator(0)

    class Counted(M.Fitted):
        def score(self, df, keys=("mqtt_message_id",)):
            @F.udf("double")
            def counted(x):
                calls.add(1)
                return x
            return super().score(df, keys).withColumn("probability", counted("probability"))
    old, M.Fitted = M.Fitted, Counted
    try:
        M.compare_models(tr, te, ["a", "b"], ["logistic"]).collect()
    finally:
        M.Fitted = old
    assert calls.value == 380


def test_svm_fits_equal_rows_once(spark, monkeypatch):
    one, many = table(spark, 300, 4), table(spark, 300, 4, copies=15)
    seen, real = [], M.LinearSVC.fit
    monkeypatch.setattr(M.LinearSVC, "fit", lambda self, d: seen.append((d.count(), d.agg(F.sum("weight")).first()[0])) or real(self, d))
    te = table(spark, 200, 5)
    a, b = ({r[0]: r.probability for r in M.fit(d, ["a", "b"], "svm").score(te).collect()} for d in (one, many))
    assert seen[1][0] == seen[0][0] <= 300 and [w for _, w in seen] == [300.0, 4500.0]
    assert np.mean([abs(a[i] - b[i]) for i in a]) < 0.05 and np.mean([(a[i] > 0.5) == (b[i] > 0.5) for i in a]) > 0.95      # 100 steps, other paths
    assert np.mean([(a[r[0]] > 0.5) == r.is_ddos for r in te.collect()]) > 0.8
