"""Forest: splits by brute force, subtrees grown in one task or over all, equal rows added up, agreement with MLlib's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brokerlens.operators import forest as FO
from brokerlens.operators import models as M

COLS = ["a", "b", "c"]


def table(spark, n=4000, seed=3):
    """Class 1 in a corner of a and b, with some noise; b has few values, c says nothing."""
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 6, n), rng.random(n)
    y = ((a > 0.3) & (b > 2)) ^ (rng.random(n) < 0.03)
    rows = [(i, float(x), float(z), float(u), int(t)) for i, (x, z, u, t) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(rows, "mqtt_message_id long, a double, b double, c double, is_ddos int")


def test_best_split_by_brute_force():
    rng = np.random.default_rng(0)
    X, W = rng.integers(0, FO.BINS, (300, 3)).astype(np.uint8), rng.poisson(1.0, (300, 2)).astype(float)
    W[X[:, 1] > 11, 0] *= 0.2
    slot, chosen = rng.integers(0, 2, 300), np.array([[0, 1], [2, 1]])
    good, j, cut, left = FO.best_splits(FO.histograms(X, W, slot, 2, chosen), 5)

    def gini(w):
        return 1 - ((w / w.sum()) ** 2).sum()
    for s in range(2):
        x, w, found = X[slot == s], W[slot == s], []
        for k, f in enumerate(chosen[s]):
            for at in range(FO.BINS - 1):
                lo, hi = w[x[:, f] <= at].sum(axis=0), w[x[:, f] > at].sum(axis=0)
                if lo.sum() >= 5 and hi.sum() >= 5:
                    found.append((gini(lo + hi) - (lo.sum() * gini(lo) + hi.sum() * gini(hi)) / w.sum(), k, at))
        best = max(found)
        assert good[s] and (j[s], cut[s]) == best[1:]
        assert left[s] == pytest.approx(w[x[:, chosen[s][j[s]]] <= cut[s]].sum(axis=0))


def test_bins_are_middles_or_quantiles_and_missing_is_last(spark):
    df = table(spark)
    a, b = FO.cut_points(df, ["a", "b"])
    assert b.tolist() == [0.5, 1.5, 2.5, 3.5, 4.5] and len(a) == FO.BINS - 1
    assert FO.to_bins([np.array([0.0, 0.5, 0.6, 5.0, np.nan])], [b]).ravel().tolist() == [0, 0, 1, 5, 5]
    share = np.bincount(FO.to_bins([np.array([r.a for r in df.select("a").collect()])], [a]).ravel()) / 4000
    assert share.min() > 0.02 and share.max() < 0.045


def test_equal_rows_are_one_and_every_row_counts(spark):
    df = table(spark, 500)
    many = df.crossJoin(spark.range(20)).select(*COLS, F.col("is_ddos").cast("double").alias("y"))
    cuts = FO.cut_points(many, COLS)
    one, all_rows = (FO.weighted_rows(d, COLS, cuts).agg(F.count("x").alias("m"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).first()
                     for d in (df.withColumn("y", F.col("is_ddos").cast("double")), many))
    assert all_rows.m == one.m <= 500 and (all_rows.n0, all_rows.n1) == (20 * one.n0, 20 * one.n1) and one.n0 + one.n1 == 500


@pytest.mark.parametrize("local_rows, part_rows", [(10**6, 10**6), (300, 500)])
def test_agrees_with_mllib(spark, local_rows, part_rows):
    """Subtrees grown by one task from the root, and only below nodes split over all tasks."""
    df, other = table(spark), table(spark, 1500, 8)
    own = FO.train_forest(df, COLS, "is_ddos", 40, 8, local_rows=local_rows, part_rows=part_rows)
    assert len(own.trees) == 40 and own.classes == 2
    for t in own.trees:
        inner = t[t["feature"] >= 0]
        for c in ("c0", "c1"):       # every sampled row went to one side
            assert np.array_equal(inner[c], t[c][inner["left"]] + t[c][inner["left"] + 1])
        assert (t["c0"] + t["c1"])[t["feature"] < 0].min() >= FO.MIN_ROWS and abs(t["c0"][0] + t["c1"][0] - 4000) < 400
    x = F.array(*COLS)
    got = {r.mqtt_message_id: r.p for r in other.select("mqtt_message_id", own.probability(x).alias("p")).collect()}
    tr, _ = M.assemble(df.withColumn("label", F.col("is_ddos").cast("double")), COLS, False)
    te, _ = M.assemble(other.withColumn("label", F.col("is_ddos").cast("double")), COLS, False)
    mllib = M.estimator("rf_50", 3).setNumTrees(40).setMaxDepth(8).fit(tr)
    want = {r.mqtt_message_id: r.probability[1] for r in mllib.transform(te).collect()}
    off = np.array([got[i] - want[i] for i in want])
    assert np.sqrt((off ** 2).mean()) < 0.06 and abs(off.mean()) < 0.01
    assert own.importances()[0] == pytest.approx(mllib.featureImportances.toArray(), abs=0.06)
    assert own.nodes == pytest.approx(mllib.totalNumNodes, rel=0.2)


def test_same_forest_whatever_the_partitions(spark):
    df = table(spark)
    fits = [FO.train_forest(d, COLS, "is_ddos", 5, 6, local_rows=n, part_rows=700) for n in (900, 10**6) for d in (df.coalesce(1), df.repartition(9, "c"))]
    for a, b in (fits[:2], fits[2:]):
        assert all(np.array_equal(s, t) for s, t in zip(a.trees, b.trees))


def test_one_class_missing_values_and_null_labels(spark):
    df = table(spark, 200).withColumn("a", F.when(F.col("mqtt_message_id") % 3 > 0, F.col("a")))
    got = M.fit(df, COLS, "rf_50").score(df).collect()
    assert len(got) == 200 and all(0 <= r.probability <= 1 and r.prediction == int(r.probability > 0.5) for r in got)
    none = M.fit(df.withColumn("is_ddos", F.lit(0)), COLS, "rf_50")
    assert none.model.classes == 1 and {(r.prediction, r.probability) for r in none.score(df).collect()} == {(0, 0.0)}
    assert M.forest_details(spark, none.model, "rf_50").first().total_nodes == 50
    with pytest.raises(ValueError):
        M.fit(df.withColumn("is_ddos", F.expr("IF(mqtt_message_id = 3, NULL, is_ddos)")), COLS, "rf_50")
