"""Perceptron and batched logistic regressions: gradients, learning, early stop, agreement with single fits."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from brokerlens.operators import models as M
from brokerlens.operators import perceptron as MLP
from brokerlens.operators.blocks import matrix_blocks, sum_over_tasks, unpacked
from brokerlens.operators.newton import nested_logistic
from brokerlens.operators.split import with_folds


def ring(spark, n=3000, seed=0):
    """Class 1 inside a circle: no linear model tells it."""
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, 2))
    rows = [(i, float(a), float(b), int(a * a + b * b < 1.0)) for i, (a, b) in enumerate(X)]
    return spark.createDataFrame(rows, "mqtt_message_id long, a double, b double, is_ddos int")


@pytest.mark.parametrize("hidden", M.MLP_LAYERS)
def test_gradient_by_differences(hidden):
    rng = np.random.default_rng(1)
    layers = [4, *(h // 10 for h in hidden), 1]
    w, X, y = MLP.start_weights(layers, 3), rng.normal(size=(30, 4)), rng.integers(0, 2, 30).astype(float)
    loss, g = MLP.loss_and_gradient(w, layers, X, y, penalty=0.1)
    assert len(g) == len(w) and loss > 0
    for i in rng.choice(len(w), 60):
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = (MLP.loss_and_gradient(w + s, layers, X, y, penalty=0.1)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_blocks_hold_every_row_once_and_sums_add_up(spark):
    df = spark.range(0, 20_000, 1, 7).select(F.col("id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"))
    blocks = matrix_blocks(df, F.col("v"), F.array(F.col("id") % 2.0), F.lit(1), 25)

    def total(batches):
        got = None
        for batch in batches:
            for _, X, Y in unpacked(batch, 2):
                part = np.array([X[:, 0].sum(), X[:, 1].sum(), Y.sum()])
                got = part if got is None else got + part
        return got
    assert sum_over_tasks(blocks, total, 25).tolist() == [20_000 * 19_999 / 2, 20_000, 10_000]
    assert sum_over_tasks(blocks.where("false"), total, 25) is None
    blocks.unpersist()


@pytest.mark.parametrize("partition_rows, batch", [(10_000, 200), (800, 25)])
def test_learns_what_is_not_linear(spark, partition_rows, batch):
    """One partition, and several whose weights are averaged (about as many steps an epoch)."""
    df = ring(spark)
    f = M.fit(df, ["a", "b"], "mlp", max_iter=40, partition_rows=partition_rows, batch=batch)
    m = f.model
    assert m.losses[-1] < 0.5 * m.losses[0] and len(m.losses) == len(m.scores)
    scored = f.score(ring(spark, 500, 9))
    assert scored.where("prediction = label").count() > 450
    again = M.fit(df, ["a", "b"], "mlp", max_iter=40, partition_rows=partition_rows, batch=batch).model
    assert np.array_equal(m.weights, again.weights)


def test_stops_early_and_keeps_the_best(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), int(a > 0)) for i, a in enumerate(rng.normal(size=1500))]
    df = spark.createDataFrame(rows, "mqtt_message_id long, a double, is_ddos int")
    f = M.fit(df, ["a"], "mlp", max_iter=200)
    m = f.model
    assert len(m.losses) < 200
    last_rise = max(i for i, s in enumerate(m.scores) if s > max(m.scores[:i], default=-1) + MLP.TOL)
    assert len(m.scores) - 1 - last_rise == MLP.PATIENCE
    assert [r.validation_accuracy for r in M.loss_curve(spark, m).orderBy("iteration").collect()] == m.scores


def test_missing_values_and_one_class(spark):
    df = spark.createDataFrame([(i, None if i % 3 else float(i), 0) for i in range(40)], "mqtt_message_id long, a double, is_ddos int")
    got = M.fit(df, ["a"], "mlp", max_iter=3).score(df).collect()
    assert len(got) == 40 and all(0 <= r.probability <= 1 for r in got)


def test_batched_fits_agree_with_single_fits(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(1200, 4))
    y = (X @ [1.5, -1.0, 0.6, 0.0] + rng.logistic(size=1200) > 0.4).astype(int)
    cols = [f"f{k}" for k in range(4)]
    df = spark.createDataFrame([(i, *map(float, x), int(t)) for i, (x, t) in enumerate(zip(X, y))],
                               "mqtt_message_id long, " + ", ".join(f"{c} double" for c in cols) + ", is_ddos int")
    base = with_folds(df, 3, 42, label="is_ddos")
    blocks = matrix_blocks(base, F.array(*cols), F.array(F.col("is_ddos").cast("double"), F.col("fold").cast("double")), F.lit(1), 4)
    got = nested_logistic(blocks, 4, 3, 4)
    blocks.unpersist()
    vec = base.withColumn("label", F.col("is_ddos").cast("double"))
    for k, f in [(1, 0), (2, 1), (4, 2)]:
        d = VectorAssembler(inputCols=cols[:k], outputCol="features").transform(vec)
        m = LogisticRegression(maxIter=1000, tol=1e-10).fit(d.where(F.col("fold") != f))
        acc = m.transform(d.where(F.col("fold") == f)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
        assert got[k, f][1] == pytest.approx([m.intercept, *m.coefficients], abs=1e-3)
        assert got[k, f][0] == pytest.approx(acc)
    rows = M.elbow_k(df, cols, folds=3).collect()
    assert [r.k for r in rows] == [1, 2, 3, 4] and sum(r.best for r in rows) == 1
    assert rows[3].cv_accuracy == pytest.approx(np.mean([got[4, f][0] for f in range(3)]))


def test_elbow_on_separable_repeated_and_no_features(spark):
    df = spark.createDataFrame([(i, float(i), float(i), int(i > 50)) for i in range(100)], "mqtt_message_id long, a double, b double, is_ddos int")
    rows = M.elbow_k(df, ["a", "b"], folds=4).collect()
    assert all(r.cv_accuracy > 0.95 for r in rows) and [r.best for r in rows] == [True, False]
    assert M.elbow_k(df, []).collect() == []


def test_elbow_passes_are_few(spark, monkeypatch):
    from brokerlens.operators import newton
    seen = []
    real = newton.sum_over_tasks
    monkeypatch.setattr(newton, "sum_over_tasks", lambda *a: seen.append(1) or real(*a))
    M.elbow_k(ring(spark, 400), ["a", "b"], folds=5)
    assert 2 <= len(seen) <= 15


def test_models_are_held_out_by_class_not_by_a_date(spark):
    """The default split keeps the class shares and needs no date of the data."""
    from brokerlens.plans.training import prepared_parts
    from tests.helpers import frame, msg
    rows = [msg(i, ip=f"ip{i % 9}") for i in range(1000)]
    df = frame(spark, rows).withColumn("is_ddos", (F.col("mqtt_message_id") % 10 == 0).cast("int")).withColumn("hour", F.lit(1))
    tr, te, feats = prepared_parts(df)
    size = lambda d: {r.is_ddos: r["count"] for r in d.groupBy("is_ddos").count().collect()}
    assert size(te) == {0: 180, 1: 20} and size(tr) == {0: 720, 1: 80} and "mqtt_qos" in feats
    tr, te, _ = prepared_parts(df, cutoff="2024-01-01 00:10:00")
    assert tr.count() == 600 and te.count() == 400
