"""PCA vs numpy, exact kNN vs brute force, splits, streaming."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from brokerlens.operators import models as M
from brokerlens.operators import pca as PC
from brokerlens.operators import split as SP
from brokerlens.streaming.rate_limit import rate_limit_alerts, rate_limit_stream
from tests.conftest import SF001
from tests.helpers import MSG, frame, msg


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in X], "a double, b double, c double, d double")
    fit = PC.fit_pca(df, ["a", "b", "c", "d"])
    Z = (X - X.mean(0)) / X.std(0, ddof=1)
    ev = np.sort(np.linalg.eigvalsh(np.cov(Z.T)))[::-1]
    assert np.allclose(fit.ratios, ev / ev.sum(), atol=1e-9)
    assert abs(fit.ratios.sum() - 1) < 1e-9
    assert np.allclose(fit.eigenvalues, ev, atol=1e-8)
    proj = np.array([[r["PC1"], r["PC2"]] for r in PC.pca_project(df.withColumn("mqtt_message_id", F.lit(1)), fit, 2,
                                                                   keep=()).collect()])
    assert abs(np.var(proj[:, 0], ddof=1) - ev[0]) < 1e-6


def test_knn_exact_against_brute_force(spark):
    rng = np.random.default_rng(2)
    n_tr, n_te = 300, 60
    Xtr, Xte = rng.normal(size=(n_tr, 3)), rng.normal(size=(n_te, 3))
    Xte[0] = Xtr[5]                                          # an exact match takes all the weight
    ytr = (Xtr[:, 0] + 0.3 * rng.normal(size=n_tr) > 0).astype(int)
    tr = spark.createDataFrame([(i, *map(float, Xtr[i]), int(ytr[i])) for i in range(n_tr)],
                               "mqtt_message_id long, a double, b double, c double, is_ddos int")
    te = spark.createDataFrame([(1000 + i, *map(float, Xte[i]), 0) for i in range(n_te)],
                               "mqtt_message_id long, a double, b double, c double, is_ddos int")
    got = {r["mqtt_message_id"]: r["probability"] for r in M.knn_predict(tr, te, ["a", "b", "c"], 5).collect()}
    mu, sd = Xtr.mean(0), Xtr.std(0)
    A, B = (Xtr - mu) / sd, (Xte - mu) / sd
    for i in range(n_te):
        d = np.sqrt(((A - B[i]) ** 2).sum(1))
        nn = np.argsort(d, kind="stable")[:5]
        if d[nn[0]] == 0:
            z = nn[d[nn] == 0]
            expect = ytr[z].mean()
        else:
            w = 1 / d[nn]
            expect = (w * ytr[nn]).sum() / w.sum()
        assert abs(got[1000 + i] - expect) < 1e-9
    assert got[1000] == ytr[5]


def test_splits_disjoint_complete_stratified(spark):
    rows = [msg(i, ip=f"ip{i % 50}") for i in range(4000)]
    df = frame(spark, rows).withColumn("is_ddos", (F.col("mqtt_message_id") % 5 == 0).cast("int"))
    tr, te = SP.stratified_split(df, "is_ddos", 0.2, 42)
    a = {r[0] for r in tr.select("mqtt_message_id").collect()}
    b = {r[0] for r in te.select("mqtt_message_id").collect()}
    assert not (a & b) and len(a | b) == 4000
    for cls in (0, 1):
        n_cls = df.where(F.col("is_ddos") == cls).count()
        share = te.where(F.col("is_ddos") == cls).count() / n_cls
        assert abs(share - 0.2) < 0.05
    tr2, te2 = SP.stratified_split(df, "is_ddos", 0.2, 42)
    assert {r[0] for r in te2.select("mqtt_message_id").collect()} == b     # repeatable


def test_stream_equals_batch_and_drops_late(spark):
    from brokerlens.operators.detect import rate_limit
    d = tempfile.mkdtemp(prefix="stream-src-", dir="/tmp")
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows1 = [msg(i, ip="a", ts=base + dt.timedelta(seconds=i)) for i in range(6)]
    rows1 += [msg(100 + i, ip="b", ts=base + dt.timedelta(minutes=30, seconds=i)) for i in range(3)]
    frame(spark, rows1).coalesce(1).write.parquet(f"{d}/f1")
    # second file: far later (moves the watermark), then a late file for the first window
    frame(spark, [msg(200 + i, ip="c", ts=base + dt.timedelta(hours=5, seconds=i)) for i in range(6)]).coalesce(1).write.parquet(f"{d}/f2")
    stream = spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).parquet(f"{d}/f*")
    out_dir = tempfile.mkdtemp(prefix="stream-out-", dir="/tmp")
    got = rate_limit_alerts(spark, stream, out_dir, limit=4, window="1 minute", watermark="10 minutes")
    batch = rate_limit(spark.read.parquet(f"{d}/f1", f"{d}/f2"), 4, "1 minute")
    key = ["general_ip", "window_start", "messages"]
    assert sorted(tuple(r) for r in got.select(key).collect()) == sorted(tuple(r) for r in batch.select(key).collect())
    # the late file for ip 'a' (old window) arrives after the watermark moved: dropped
    frame(spark, [msg(300 + i, ip="late", ts=base + dt.timedelta(seconds=i)) for i in range(6)]).coalesce(1).write.parquet(f"{d}/f3")
    stream2 = spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).parquet(f"{d}/f*")
    got2 = rate_limit_alerts(spark, stream2, tempfile.mkdtemp(prefix="stream-out-", dir="/tmp"), 4, "1 minute",
                             "10 minutes")
    assert "late" not in {r["general_ip"] for r in got2.collect()}


@pytest.mark.parametrize("name", ["logistic", "tree_simple", "naive_bayes", "mlp", "knn_3"])
def test_models_train_and_score(spark, name):
    from brokerlens.plans.q_models import parts
    tr, te, feats = parts(spark, "/root/testdata/sf0.001")
    sc, _, _ = M.fit_predict(tr, te, feats, name)
    rows = sc.collect()
    assert len(rows) == te.count()
    assert all(r["prediction"] in (0, 1) and 0.0 <= r["probability"] <= 1.0 for r in rows)


def test_svm_needs_two_classes(spark):
    from brokerlens.plans.q_models import parts
    tr, te, feats = parts(spark, "/root/testdata/sf0.001")      # no attack at sf0.001
    with pytest.raises(ValueError):
        M.fit(tr, feats, "svm")


def test_compare_models_reports_failures(spark):
    from brokerlens.plans.q_models import parts
    tr, te, feats = parts(spark, "/root/testdata/sf0.001")
    rows = {r["model"]: r for r in M.compare_models(tr, te, feats, ["naive_bayes", "svm"]).collect()}
    assert rows["svm"]["error"] and rows["svm"]["f1"] is None
    assert rows["naive_bayes"]["error"] is None and rows["naive_bayes"]["accuracy"] is not None


def test_deduplicate_stream_drops_replays(spark):
    from brokerlens.operators.detect import with_full_id
    from brokerlens.streaming.rate_limit import deduplicate_stream
    d = tempfile.mkdtemp(prefix="dedup-src-", dir="/tmp")
    base = dt.datetime(2024, 1, 1, 12, 0, 0)
    rows = [msg(1, value="p", ts=base), msg(2, value="p", ts=base + dt.timedelta(seconds=5)),
            msg(3, value="q", ts=base + dt.timedelta(seconds=6))]
    frame(spark, rows).coalesce(1).write.parquet(f"{d}/f1")
    stream = with_full_id(spark.readStream.schema(MSG).parquet(f"{d}/f*"))
    out = tempfile.mkdtemp(prefix="dedup-out-", dir="/tmp")
    q = (deduplicate_stream(stream, watermark="1 minute").writeStream.format("parquet")
         .option("checkpointLocation", f"{out}/ckpt").trigger(availableNow=True).start(f"{out}/data"))
    q.awaitTermination()
    got = sorted(r["mqtt_message_value"] for r in spark.read.parquet(f"{out}/data").collect())
    assert got == ["p", "q"]
