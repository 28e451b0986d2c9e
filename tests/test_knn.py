"""The kNN join against numpy over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brokerlens.operators import knn
from brokerlens.operators import models as M


def expected(A, y, B, k):
    """Probabilities by all distances; rows equally far at the k-th place share it."""
    out = []
    for at in range(0, len(B), 64):
        D = np.round(np.sqrt(((B[at:at + 64, None, :] - A[None]) ** 2).sum(-1)), knn.TIE)
        for d in D:
            kth = np.partition(d, min(k, len(d)) - 1)[min(k, len(d)) - 1]
            if d.min() == 0:
                out.append(y[d == 0].mean())
                continue
            near, tied = d < kth, d == kth
            places = min(k, len(d)) - near.sum()
            w = near / d + tied / d * (places / tied.sum())
            out.append((w * y).sum() / w.sum())
    return np.array(out)


def frames(spark, A, y, B):
    p = A.shape[1]
    schema = "mqtt_message_id long, " + ", ".join(f"f{i} double" for i in range(p)) + ", is_ddos int"
    rows = lambda X, y, at: spark.createDataFrame([(at + i, *map(float, x), int(v)) for i, (x, v) in enumerate(zip(X, y))], schema)
    return rows(A, y, 0), rows(B, np.zeros(len(B)), 10 ** 6), [f"f{i}" for i in range(p)]


def check(spark, A, y, B, k):
    tr, te, feats = frames(spark, A, y, B)
    got = {r["mqtt_message_id"] - 10 ** 6: r["probability"] for r in M.knn_predict(tr, te, feats, k).collect()}
    mean, scale = A.mean(0), np.where(A.std(0) == 0, 1, A.std(0))
    want = expected((A - mean) / scale, y, (B - mean) / scale, k)
    assert len(got) == len(B)
    assert max(abs(got[i] - w) for i, w in enumerate(want)) < 1e-6


def test_fifty_thousand_training_rows(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 6)) * 4
    A = centres[rng.integers(0, 30, 50_000)] + rng.normal(size=(50_000, 6)) * rng.choice([0.1, 1.0], (50_000, 1))
    B = np.concatenate([centres[rng.integers(0, 30, 300)] + rng.normal(size=(300, 6)), rng.normal(size=(50, 6)) * 20, A[:50]])
    y = (A[:, 0] + rng.normal(size=50_000) > 0).astype(int)
    check(spark, A, y, B, 5)


@pytest.mark.parametrize("k", [1, 3, 10])
def test_small_parts_many_ties_and_a_hot_point(spark, monkeypatch, k):
    """A grid of few values: most distances tie; a third of the rows are one point; parts of a few points, dealt queries."""
    monkeypatch.setattr(knn, "PART_POINTS", 20)
    monkeypatch.setattr(knn, "QUERY_ROWS", 7)
    rng = np.random.default_rng(k)
    A = rng.integers(0, 6, (1500, 4)).astype(float)
    A[:500] = A[0]
    y = rng.integers(0, 2, 1500)
    B = np.concatenate([rng.integers(0, 7, (200, 4)) + rng.choice([0.0, 0.5], (200, 4)), A[:20]])
    check(spark, A, y, B, k)


def test_fewer_rows_than_neighbours_and_missing_values(spark):
    tr = spark.createDataFrame([(1, 1.0, None, 1), (2, float("nan"), 2.0, 0), (3, 3.0, 4.0, None)], "mqtt_message_id long, a double, b double, is_ddos int")
    te = spark.createDataFrame([(9, 1.0, None, 1), (9, 1.0, None, 1), (10, None, None, 0)], "mqtt_message_id long, a double, b double, is_ddos int")
    got = M.knn_predict(tr, te, ["a", "b"], 10).collect()
    assert len(got) == 3 and all(r.probability == 1.0 for r in got if r["mqtt_message_id"] == 9)
    assert M.knn_predict(tr.limit(0), te, ["a", "b"], 3).where("probability IS NULL").count() == 3
    assert M.knn_predict(tr, te.limit(0), ["a", "b"], 3).collect() == []


def test_bounds_skip_parts(spark):
    """Queries visit few of the parts, and none that could hold a neighbour is skipped."""
    rng = np.random.default_rng(4)
    X = rng.normal(size=(20_000, 3))
    points = spark.createDataFrame([(x.tolist(), 1, 0) for x in X], "vec array<double>, n long, pos long")
    old, knn.PART_POINTS = knn.PART_POINTS, 200
    try:
        placed, parts = knn._partition(points, 3)
    finally:
        knn.PART_POINTS = old
    where = {tuple(r.vec): r.part for r in placed.collect()}
    assert len(where) == len(X) and set(where.values()) == set(parts.id.tolist()) and len(parts.id) >= 100
    Q = rng.normal(size=(100, 3))
    D = knn._distances(Q, parts.pivots)
    kth = np.sort(knn._distances(Q, X), axis=1)[:, 4]
    hit = parts.within(D, kth)
    assert hit.mean() < 0.2
    for q, row in enumerate(knn._distances(Q, X)):
        for i in np.flatnonzero(row <= kth[q]):
            assert hit[q, np.flatnonzero(parts.id == where[tuple(X[i])])[0]]
    assert (parts.bound(D, 5) >= kth).all()
