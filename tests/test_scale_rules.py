"""Rows are kept, hot keys are split, and results do not depend on optimizer settings."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from brokerlens.operators import basic as B
from brokerlens.operators import detect as D
from brokerlens.operators import ip_features as IP
from brokerlens.operators import models as M
from brokerlens.operators import pca as PC
from brokerlens.operators import profile as P
from brokerlens.operators import stats as ST
from brokerlens.operators.cleaning import replace_infinite
from brokerlens.plans.training import time_split
from brokerlens.sources.readers import read_messages
from brokerlens.sources.schema import MESSAGE_SCHEMA
from brokerlens.streaming.rate_limit import rate_limit_alerts
from tests.helpers import T0, frame, msg


@pytest.fixture
def conf(spark):
    old = {}

    def put(**kw):
        for k, v in kw.items():
            k = "spark.sql." + k.replace("_", ".")
            old.setdefault(k, spark.conf.get(k, None))
            spark.conf.set(k, v)
    yield put
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    out = df.groupBy().count()
    out.collect()
    return out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", ["features", "blocked"])
def test_hot_ip_is_split(spark, conf, query):
    conf(autoBroadcastJoinThreshold="-1", adaptive_autoBroadcastJoinThreshold="-1", shuffle_partitions="32",
         adaptive_skewJoin_skewedPartitionThresholdInBytes="64k", adaptive_advisoryPartitionSizeInBytes="64k",
         adaptive_skewJoin_skewedPartitionFactor="2")
    ip = F.when(F.col("id") % 2 == 0, F.lit("10.0.0.1")).otherwise(F.concat(F.lit("10.1."), (F.col("id") % 5000).cast("string")))
    rows = spark.range(0, 400_000, 1, 8).select(
        F.col("id").alias("mqtt_message_id"), ip.alias("general_ip"), (F.col("id") % 50).cast("string").alias("mqtt_topic"),
        (F.col("id") % 3).cast("int").alias("mqtt_qos"), (F.col("id") % 7 == 0).alias("mqtt_duplicate"), (F.col("id") % 5 == 0).alias("mqtt_retained"))
    if query == "features":
        df = IP.with_ip_features(rows).groupBy("mqtt_topic").agg(F.sum("requests_per_ip"))
    else:
        blocked = rows.where("general_ip LIKE '10.1.%7'").groupBy("general_ip").count()
        df = D.filter_blocked(rows, blocked).groupBy("mqtt_topic").agg(F.max("mqtt_message_id"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan


def test_split_join_equals_join(spark):
    left = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("", 4)], "k string, v int")
    right = spark.createDataFrame([("a", 10), ("", 30), ("c", 40)], "k string, w int")
    for how in ("left", "left_anti", "left_semi", "inner"):
        assert sorted(map(str, B.split_join(left, right, "k", how).collect())) == sorted(
            map(str, left.join(right, "k", how).select(*(["k", "v"] + ["w"] * (how in ("left", "inner")))).collect()))


def test_dense_codes_do_not_need_exchange_reuse(spark, conf):
    conf(exchange_reuse="false", execution_reuseSubquery="false")
    values = spark.range(0, 300_000, 1, 8).select(F.concat(F.lit("v"), F.xxhash64("id").cast("string")).alias("v"))
    got = B.dense_codes(values, "v")
    n, distinct, top = got.agg(F.count(F.lit(1)), F.countDistinct("code"), F.max("code")).first()
    assert n == distinct == 300_000 and top == 299_999


def test_running_sums_match_a_window(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(int(g), float(x), 1) for g, x in zip(rng.integers(0, 3, 3000), rng.integers(0, 200, 3000))], "g int, x double, c int")
    for desc in (False, True):
        got = {(r.g, r.x): r.cum_c for r in B.running_sums(df, ["g"], "x", ["c"], descending=desc, parts=37).collect()}
        pdf = df.toPandas()
        for (g, x), cum in got.items():
            side = pdf.x >= x if desc else pdf.x <= x
            assert cum == int((side & (pdf.g == g)).sum())


def test_split_keeps_messages_without_a_time(spark):
    rows = [msg(1), msg(2, ts=dt.datetime(2024, 1, 28))]
    df = frame(spark, rows).union(frame(spark, [msg(3)]).withColumn("ts", F.lit(None).cast("timestamp")).select(*frame(spark, rows).columns))
    tr, te = time_split(df, "2024-01-25 00:00:00")
    assert sorted(r.mqtt_message_id for r in tr.collect()) == [1, 3] and [r.mqtt_message_id for r in te.collect()] == [2]


def test_dedup_keeps_devices_without_an_ip(spark):
    rows = [msg(i, ip=None, mac=f"m{i}", ts=T0) for i in range(5)] + [msg(10, ts=T0), msg(11, ts=T0)] + [msg(20, ip=None, mac="m0", ts=T0)]
    got = sorted(r.mqtt_message_id for r in D.deduplicate_messages(frame(spark, rows)).collect())
    assert got == [0, 1, 2, 3, 4, 10]


def test_pca_scores_every_row(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b), 0) for i, (a, b) in enumerate(rng.normal(size=(50, 2)))] + [(100, None, 1.0, 0), (101, float("nan"), 2.0, 1)]
    df = spark.createDataFrame(rows, "mqtt_message_id long, a double, b double, is_ddos int")
    got = PC.pca_project(df, PC.fit_pca(df, ["a", "b"])).collect()
    assert len(got) == 52 and all(math.isfinite(r.PC1) and math.isfinite(r.PC2) for r in got)


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (5.0,), (float("inf"),)], "x double")
    assert [r.x for r in replace_infinite(df).collect()] == [1.0, 3.0, None, 5.0, None]
    finite = df.where(F.abs("x") < 100).union(spark.createDataFrame([(float("nan"),)], "x double"))
    for exact in (True, False):
        r = P.describe_numeric(finite, ["x"], exact=exact).first()
        assert (r["count"], r["mean"], r["max"], r["q50"]) == (3, 3.0, 5.0, 3.0) and r["std"] == pytest.approx(2.0)


def test_kde_is_the_whole_kernel(spark):
    x = np.array([0.0, 0.0, 1.0, 50.0])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    bw = x.std(ddof=1) * len(x) ** -0.2
    for r in P.kde_curve(df, "x", grid=20).collect():
        want = np.exp(-0.5 * ((r.x - x) / bw) ** 2).sum() / (len(x) * bw * math.sqrt(2 * math.pi))
        assert r.density == pytest.approx(want, rel=1e-9)


def test_one_class_has_null_scores(spark):
    df = spark.createDataFrame([(float(i), float(i % 3), 0) for i in range(20)], "a double, b double, is_ddos int")
    scores = ST.anova_f(df, ["a", "b"])
    assert {r.feature: r.f_score for r in scores.collect()} == {"a": None, "b": None}
    best = ST.select_k_best(scores, 2)
    assert best.count() == 0 and ST.feature_importance_percent(best).count() == 0 and ST.f_score_tier(scores).count() == 0


ONE_CLASS_KEYS = ["anova_f", "select_k_best", "feature_importance_percent", "f_score_tier", "write_feature_list", "standardize",
                  "label_distribution", "imbalance_ratio", "binary_metrics", "roc_auc"]


@pytest.mark.parametrize("key", ONE_CLASS_KEYS)
def test_label_free_traffic_matches_the_oracle(spark, key):
    """sf0.001 has no attack at the fixture thresholds."""
    import __spark_entry__ as E
    from tools.check_oracle import TABLES, rows_of
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{t}.parquet')")
    df = E.queries()[key](spark, "/root/testdata/sf0.001")
    rel = con.sql(E.oracle_sql()[key])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(rel.columns, rel.fetchall())


def test_correlation_of_70_columns(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(60, 70))
    X[:, 1] = X[:, 0] * 2 + 0.1 * X[:, 1]
    rows = [[None if (i + j) % 17 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(X)]
    cols = [f"c{j}" for j in range(70)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols))
    pairs = [("c0", "c1"), ("c0", "c69"), ("c68", "c69"), ("c5", "c5")] + [("c2", c) for c in cols[3:]]
    got = {(r.feature_x, r.feature_y): r["corr"] for r in ST.pearson_pairs(df, pairs).collect()}
    assert len(got) == len(pairs)
    full = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for (a, b), r in got.items():
        x, y = full[:, int(a[1:])], full[:, int(b[1:])]
        ok = ~np.isnan(x) & ~np.isnan(y)
        assert r == pytest.approx(np.corrcoef(x[ok], y[ok])[0, 1], abs=1e-9)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "m.csv").write_text('general_ip,@timestamp,mqtt_topic,mqtt_qos,other\n10.0.0.1,2026-01-10T14:30:00Z,"a,b",1,x\n')
    df = read_messages(spark, str(tmp_path / "m.csv"))
    assert df.columns == [f.name for f in MESSAGE_SCHEMA.fields]
    r = df.first()
    assert (r["general_ip"], r["@timestamp"], r["mqtt_topic"], r["mqtt_qos"], r["mqtt_message_id"]) == (
        "10.0.0.1", "2026-01-10T14:30:00Z", "a,b", 1, None)


def test_csv_values_over_several_lines(spark, tmp_path):
    (tmp_path / "m.csv").write_text('mqtt_message_id,mqtt_message_value,mqtt_qos\n1,"line one\nline two",2\n2,"say ""hi""",0\n')
    got = {r.mqtt_message_id: (r.mqtt_message_value, r.mqtt_qos) for r in read_messages(spark, str(tmp_path / "m.csv"), multiline=True).collect()}
    assert got == {1: ("line one\nline two", 2), 2: ('say "hi"', 0)}


def test_csv_files_with_other_headers_fail(spark, tmp_path):
    (tmp_path / "a.csv").write_text("mqtt_message_id,mqtt_qos\n1,2\n")
    (tmp_path / "b.csv").write_text("mqtt_qos,mqtt_message_id\n2,1\n")
    with pytest.raises(Exception):
        read_messages(spark, str(tmp_path)).collect()


def test_broken_alert_store_is_an_error(spark, monkeypatch, tmp_path):
    from brokerlens.streaming import rate_limit as R
    from brokerlens.sources.fixture import mqtt_messages

    def broken(*_):
        raise AnalysisException("storage is gone", errorClass="CANNOT_READ")
    monkeypatch.setattr(R, "read_alerts", broken)
    src = str(tmp_path / "src")
    m = mqtt_messages(spark, "/root/testdata/sf0.001")
    m.write.parquet(src)
    with pytest.raises(AnalysisException):
        rate_limit_alerts(spark, spark.readStream.schema(m.schema).parquet(src), str(tmp_path), 7, "1 day")


def test_knn_scores_every_row_from_bounded_training_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), int(a > 0.8)) for i, (a, b) in enumerate(rng.normal(size=(2000, 2)))]
    df = spark.createDataFrame(rows, "mqtt_message_id long, a double, b double, is_ddos int")
    X, y = M.knn_train_rows(df, ["a", "b"], "is_ddos", 300)
    assert 295 <= len(y) <= 300 and abs(y.mean() - np.mean([r[3] for r in rows])) < 0.01
    got = M.knn_predict(df, df, ["a", "b"], 5, max_train=300)
    assert got.count() == 2000
    assert got.where("prediction = label").count() > 1850


def test_one_class_model_is_reported_other_errors_raise(spark):
    df = spark.createDataFrame([(i, float(i), 0) for i in range(30)], "mqtt_message_id long, a double, is_ddos int")
    row = M.compare_models(df, df, ["a"], names=["svm"]).first()
    assert row.error and row.accuracy is None
    with pytest.raises(Exception, match="no_such_column"):
        M.compare_models(df, df, ["no_such_column"], names=["svm"])


def test_stratified_parts_have_exact_sizes(spark):
    from brokerlens.operators.split import stratified_split, with_folds
    df = spark.range(0, 5000, 1, 7).select(F.col("id").alias("mqtt_message_id"), (F.col("id") % 10 == 0).cast("int").alias("is_ddos"))
    tr, te = stratified_split(df, test_size=0.3)
    size = {r.is_ddos: r["count"] for r in te.groupBy("is_ddos").count().collect()}
    assert size == {0: 1350, 1: 150} and tr.count() == 3500 and tr.join(te, "mqtt_message_id").count() == 0
    folds = {(r.is_ddos, r.fold): r["count"] for r in with_folds(df, 5, label="is_ddos").groupBy("is_ddos", "fold").count().collect()}
    assert folds == {(c, f): n for c, n in ((0, 900), (1, 100)) for f in range(5)}


def test_comparison_has_the_cross_validated_gap(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(a), int(a + 0.3 * e > 0.5)) for i, (a, e) in enumerate(rng.normal(size=(400, 2)))]
    df = spark.createDataFrame(rows, "mqtt_message_id long, a double, is_ddos int")
    cv = M.cross_validate(df, ["a"], "tree_simple", 3).collect()
    mean = [r for r in cv if r.fold is None][0]
    assert len(cv) == 4 and mean.gap == pytest.approx(np.mean([r.gap for r in cv if r.fold is not None]))
    r = M.compare_models(df, df, ["a"], names=["tree_simple"], folds=3).first()
    assert r.gap == pytest.approx(r.cv_train_accuracy - r.cv_test_accuracy) and r.gap == pytest.approx(mean.gap)


def test_perceptron_takes_the_references_layers(spark):
    for hidden in M.MLP_LAYERS:
        est = M.estimator("mlp", 7, hidden=hidden, max_iter=100)
        assert list(est.getLayers()) == [7, *hidden, 2] and est.getMaxIter() == 100


def test_shared_folder_is_asked_for_on_a_cluster():
    from brokerlens.session import ensure_checkpoint_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_bracketed_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    wide = rng.normal(size=60_000)
    tied = rng.integers(0, 5, 60_000).astype(float)
    few = np.array([3.0, 1.0, 2.0, 10.0])
    rows = [("wide", float(v)) for v in wide] + [("tied", float(v)) for v in tied] + [("few", float(v)) for v in few] + [("few", None), ("few", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double")
    qs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {(r.g, r.q): r.value for r in B.exact_quantiles(df, ["g"], "x", qs, accuracy=1000).collect()}
    for g, v in (("wide", wide), ("tied", tied), ("few", few)):
        for q in qs:
            assert got[g, q] == pytest.approx(np.quantile(v, q), abs=1e-12)
    assert B.exact_quantiles(df.where("g = 'few'"), [], "x", [0.5]).first().value == 2.5
    assert B.exact_quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0
