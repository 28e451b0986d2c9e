"""A comparison reads, deals and scores its rows once; the helpers it shares give the rows they gave."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brokerlens.operators import evaluate as EV
from brokerlens.operators import knn, perceptron
from brokerlens.operators import models as M


def table(spark, n, seed):
    rng = np.random.default_rng(seed)
    X = rng.integers(0, 12, size=(n, 2)) / 4.0          # many equal rows
    y = (X[:, 0] + rng.normal(0, 0.4, n) > 1.4).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(t)) for i, ((a, b), t) in enumerate(zip(X, y))],
                                 "mqtt_message_id long, a double, b double, is_ddos int")


def test_comparison_deals_once_and_scores_both_parts_at_once(spark, monkeypatch):
    tr, te = table(spark, 500, 1), table(spark, 120, 2)
    names = ["tree_simple", "naive_bayes"]
    dealt, scored, real, score = [], [], M.spread, M.Fitted.score
    monkeypatch.setattr(M, "spread", lambda df: dealt.append(df) or real(df))
    monkeypatch.setattr(M.Fitted, "score", lambda self, *a, **k: scored.append(self.name) or score(self, *a, **k))
    got = {r.model: r for r in M.compare_models(tr, te, ["a", "b"], names).collect()}
    assert len(dealt) == 2 and scored == names
    monkeypatch.undo()
    for name in names:
        f = M.fit(tr, ["a", "b"], name)
        s_te, s_tr = f.score(te), f.score(tr)
        m, r = EV.binary_metrics(s_te).first(), got[name]
        assert (r.accuracy, r.precision, r.recall, r.f1) == pytest.approx((m.accuracy, m.precision, m.recall, m.f1), abs=1e-12)
        assert r.roc_auc == pytest.approx(EV.roc_auc(s_te).first().roc_auc, abs=1e-9)
        assert r.train_accuracy == pytest.approx(EV.binary_metrics(s_tr).first().accuracy, abs=1e-12)


def test_part_without_rows_and_models_of_one_class(spark):
    tr, te = table(spark, 200, 1), table(spark, 10, 2).where("a < 0")
    r = M.compare_models(tr, te, ["a", "b"], ["knn_3", "tree_simple"]).collect()
    assert [(x.model, x.accuracy, x.f1, x.roc_auc) for x in r] == [("knn_3", 0.0, 0.0, None), ("tree_simple", 0.0, 0.0, None)]
    assert all(x.train_accuracy > 0.5 for x in r)


def test_weights_stand_for_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), int(b), float(c), int(n)) for a, b, c, n in zip(rng.integers(0, 2, 60), rng.integers(0, 2, 60), rng.integers(0, 9, 60) / 8, rng.integers(0, 5, 60))]
    one = spark.createDataFrame(rows + [(None, 1, 0.5, 7)], "label int, prediction int, probability double, n int")
    each = one.select("label", "prediction", "probability", F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(1), "n"))))
    assert EV.binary_metrics(one, weight="n").first() == EV.binary_metrics(each).first()
    assert EV.roc_auc(one, weight="n").first().roc_auc == pytest.approx(EV.roc_auc(each).first().roc_auc, abs=1e-12)


def test_votes_for_several_k_are_those_for_each(spark):
    rng = np.random.default_rng(4)
    rows = [([float(v)], float(d), int(n), int(rng.integers(0, n + 1))) for v in range(20) for d, n in zip(rng.integers(0, 4, 6) / 2, rng.integers(1, 5, 6))]
    found = spark.createDataFrame(rows, knn.FOUND)
    many = {tuple(r.vec): r for r in knn.votes(found, [3, 5, 10]).collect()}
    for k in (3, 5, 10):
        one = {tuple(r.vec): r.probability for r in knn.vote(found, k).collect()}
        assert one.keys() == many.keys() and all(one[v] == pytest.approx(many[v][f"p{k}"], abs=1e-12) for v in one)


def test_scratch_arrays_change_no_number():
    rng = np.random.default_rng(5)
    for layers in ([4, 30, 1], [4, 30, 20, 1]):
        w, X, y = perceptron.start_weights(layers, 1), rng.normal(size=(200, 4)), (rng.random(200) < 0.4).astype(float)
        scratch = perceptron.Scratch(layers, 200)
        for n in (200, 57, 200):
            (a, g), (b, h) = perceptron.loss_and_gradient(w, layers, X[:n], y[:n]), perceptron.loss_and_gradient(w, layers, X[:n], y[:n], scratch=scratch)
            assert a == b and np.array_equal(g, h)
            z = perceptron.forward(w, layers, X[:n])[-1][:, 0]
            assert a == pytest.approx(np.mean(np.logaddexp(0.0, z) - y[:n] * z) + 0.5 * perceptron.PENALTY * sum((p ** 2).sum() for p in perceptron.unflat(w, layers)[::2]) / n)
