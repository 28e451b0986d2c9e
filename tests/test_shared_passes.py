"""Distinct values, density curves, topic tries, daily state, splits and replays against plain Python."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brokerlens.functions.topics import matches_topic_filter
from brokerlens.operators import distinct as DI
from brokerlens.operators import evaluate as EV
from brokerlens.operators import ip_features as IP
from brokerlens.operators import ip_state as IS
from brokerlens.operators import leakage as L
from brokerlens.operators import profile as P
from brokerlens.operators import split as SP
from brokerlens.operators import stats as ST
from brokerlens.operators.topic_trie import match_topic_filters
from brokerlens.streaming.replay import replay_alerts
from tests.helpers import MSG, T0, frame, msg


def test_distinct_counts(spark, monkeypatch):
    df = spark.range(0, 5000, 1, 6).select(F.col("id"), (F.col("id") % 20).alias("twenty"), (F.col("id") % 21).cast("string").alias("more"),
                                           F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 2 == 0, 0.0).otherwise(-0.0).alias("zero"),
                                           F.when(F.col("id") % 3 == 0, float("nan")).alias("nan"), F.timestamp_seconds(F.col("id") % 4).alias("t"))
    want = {"id": 5000, "twenty": 20, "more": 21, "none": 0, "zero": 1, "nan": 1, "t": 4}
    assert {r["column"]: r.nunique for r in DI.distinct_counts(df).collect()} == want
    monkeypatch.setattr(DI, "HELD", 10)
    assert {r["column"]: r.nunique for r in DI.distinct_counts(df).collect()} == want
    got = {r["column"]: (r.nunique, r.more) for r in DI.bounded_cardinality(df).collect()}
    assert got == {c: (min(n, 21), n > 20) for c, n in want.items()}
    assert {r.nunique for r in DI.distinct_counts(df.limit(0)).collect()} == {0}
    plan = P.categorical_summary(df, ["more", "none"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan


def test_bounded_sets_pass_on_few_values(spark):
    df = spark.range(0, 100_000, 1, 4).select("id", (F.col("id") % 7).alias("k"))
    assert DI._values(df, ["id", "k"], 21).count() <= 4 * (21 + 7)


@pytest.mark.parametrize("fine", [1, 8, 256])
def test_density_curve_within_its_bound(spark, fine):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, 4000), rng.exponential(3, 2000), [50.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    rows = P.kde_curve(df, "x", grid=100, fine=fine).orderBy("point").collect()
    bw = x.std(ddof=1) * len(x) ** -0.2
    g = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 100)
    exact = np.exp(-0.5 * ((g[:, None] - x[None]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert [r.x for r in rows] == pytest.approx(list(g))
    off = max(abs(r.density - e) for r, e in zip(rows, exact))
    assert off <= P.kde_error_bound(bw, g[1] - g[0], fine) + 1e-14


def test_density_of_one_value_and_none(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert {(r.x, r.density) for r in P.kde_curve(df, "x", grid=5).collect()} == {(2.0, None)}
    assert len(P.kde_curve(df.limit(0), "x", grid=5).collect()) == 5


def test_trie_matches_as_one_regex_per_filter_does(spark):
    rng = np.random.default_rng(1)
    levels = ["a", "b", "", "c.d", "$SYS", "+", "#"]
    topics = {"/".join(rng.choice(levels, rng.integers(1, 5))) for _ in range(300)} | {"a", "a/b", "", "/", "$SYS/x"}
    filters = {"/".join(rng.choice(["a", "b", "", "+", "c.d", "$SYS"], rng.integers(1, 5))) for _ in range(120)}
    filters |= {f + "/#" for f in list(filters)[:40]} | {"#", "+", "/#", "+/#", "$SYS/#"}
    t = spark.createDataFrame([(x,) for x in topics] * 2 + [(None,)], "mqtt_topic string")
    f = spark.createDataFrame([(x,) for x in filters] * 2 + [(None,)], "filter string")
    want = {(r.mqtt_topic, x) for x in filters for r in t.distinct().where(matches_topic_filter(x)).collect()} if len(filters) < 40 else None
    import re
    from brokerlens.functions.topics import topic_filter_regex
    want = {(x, y) for y in filters for x in topics if re.fullmatch(topic_filter_regex(y), x) and not (y[0:1] in ("+", "#") and x.startswith("$"))}
    rows = match_topic_filters(t, f).collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_trie_edges(spark):
    t = spark.createDataFrame([("a/b",)], "mqtt_topic string")
    with pytest.raises(ValueError):
        match_topic_filters(t, spark.createDataFrame([("a/#/b",)], "filter string"))
    with pytest.raises(ValueError):
        match_topic_filters(t, spark.createDataFrame([("a+",)], "filter string"))
    assert match_topic_filters(t, spark.createDataFrame([], "filter string")).collect() == []


def days(spark):
    rows = [msg(i, ip=f"10.0.0.{i % 7}", topic=f"t/{i % 11}", dup=i % 3 == 0, ts=T0 + dt.timedelta(hours=i), qos=i % 3) for i in range(200)]
    rows += [msg(900, ip=None), msg(901, ip="10.0.0.1", topic=None, ts=T0 + dt.timedelta(days=2))]
    no_time = frame(spark, [msg(902, ip="10.0.0.2")]).withColumn("ts", F.lit(None).cast("timestamp"))
    return frame(spark, rows).unionByName(no_time)


def test_daily_state_adds_up_and_new_days_leave_old_ones(spark, tmp_path):
    m, base = days(spark), str(tmp_path / "state")
    cut = T0 + dt.timedelta(days=4)
    early = F.coalesce(F.col("ts") < F.lit(cut), F.lit(True))
    IS.write_days(m.where(early), base)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("day=*/*.parquet")}
    IS.write_days(m.where(~early), base)
    after = {p: p.stat().st_mtime_ns for p in (tmp_path / "state").rglob("day=*/*.parquet")}
    assert before and before.items() <= after.items() and len(after) > len(before)
    key = lambda df: sorted(tuple(r) for r in df.select("general_ip", *IP.IP_FEATURES).collect())
    assert key(IS.roll_up(spark, base)) == key(IP.per_ip_stats(m))
    first = ("2024-01-01", "2024-01-02")
    span = m.where(F.date_format("ts", "yyyy-MM-dd").between(*first))
    assert key(IS.roll_up(spark, base, first)) == key(IP.per_ip_stats(span))
    IS.write_days(m.where(early), base)          # the same days again: nothing counts twice
    assert key(IS.roll_up(spark, base)) == key(IP.per_ip_stats(m))
    IS.release(spark, base)
    assert not (tmp_path / "state").exists()


def test_splits_of_exact_size(spark):
    df = spark.range(0, 1003, 1, 5).select(F.col("id").alias("mqtt_message_id"), F.lit(1).alias("x"))
    train, test = SP.random_split(df, 0.2, 42, exact=True)
    ids = {r[0] for r in test.select("mqtt_message_id").collect()}
    assert len(ids) == test.count() == math.ceil(1003 * 0.2) and train.count() == 1003 - len(ids) and train.columns == df.columns
    assert ids == {r[0] for r in SP.random_split(df.repartition(3), 0.2, 42, exact=True)[1].select("mqtt_message_id").collect()}


def test_cells_of_a_split_do_not_grow_with_the_table(spark):
    assert SP.cell_bits(10 ** 7) == 12 and SP.cell_bits(0) == 12
    for rows in (10 ** 10, 10 ** 12):
        assert rows / 2 ** SP.cell_bits(rows) <= SP.CELL_ROWS
    df = spark.range(0, 10 ** 7, 1, 8).select(F.col("id").alias("mqtt_message_id"), (F.col("id") % 4 == 0).cast("int").alias("is_ddos"))
    ranked = SP.with_class_rank(df, "is_ddos", 42)
    worst = ranked.groupBy("_size").agg(F.countDistinct("_rank").alias("n"), F.max("_rank").alias("m")).collect()
    assert {(r._size, r.n, r.m) for r in worst} == {(7_500_000, 7_500_000, 7_499_999), (2_500_000, 2_500_000, 2_499_999)}


def test_roc_starts_at_the_origin(spark):
    df = spark.createDataFrame([(1, 0.9, "a"), (0, 0.9, "a"), (1, 0.1, "a"), (0, 0.1, "a"), (1, 0.5, "b")], "label int, probability double, m string")
    got = sorted(tuple(r) for r in EV.roc_curve(df.where("m = 'a'")).collect())
    assert got == [(0.1, 1.0, 1.0), (0.9, 0.5, 0.5), (float("inf"), 0.0, 0.0)]
    assert EV.roc_curve(df, by=["m"]).where(F.col("threshold") == float("inf")).count() == 2
    assert EV.roc_curve(df.limit(0)).collect() == []


def test_condemned_features_go_and_the_rest_is_standardised_anew(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(y), float(a), 3.0, int(y)) for i, (y, a) in enumerate(zip(rng.integers(0, 2, 300), rng.normal(5, 2, 300)))]
    df = spark.createDataFrame(rows, "mqtt_message_id long, leak double, a double, same double, is_ddos int")
    report = L.leak_report(df, df, ["leak", "a", "same"])
    assert {(r.check, r.feature) for r in report.collect()} >= {("high_correlation", "leak"), ("perfect_predictor", "leak"), ("zero_variance", "same")}
    train, test, kept = L.remove_and_standardize(df, df, ["leak", "a", "same"], report)
    assert kept == ["a"] and "leak" not in test.columns
    m, s = train.agg(F.avg("a"), F.stddev_pop("a")).first()
    assert m == pytest.approx(0, abs=1e-9) and s == pytest.approx(1)
    r = ST.feature_reduction(df.limit(3), 12).first()
    assert (r.n_features, r.n_selected, r.reduction_pct) == (12, 3, 75.0)


def streamed(spark, path, batches):
    """Each batch a file, read one file a micro-batch in the order of writing."""
    for k, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(f"{path}/b{k}")
        import os
        import glob
        for f in glob.glob(f"{path}/b{k}/*.parquet"):
            os.utime(f, (1_700_000_000 + 100 * k,) * 2)
    return spark.readStream.schema(MSG).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def test_replays_expire_and_late_messages_are_ignored(spark, tmp_path):
    at = lambda h, i, v="x", ip="10.0.0.1": msg(i, ip=ip, value=v, ts=T0 + dt.timedelta(hours=h))
    batches = [
        [at(0, 1), at(0.1, 2), at(0.2, 3, v="other")],             # a replay in one batch
        [at(0.5, 4), at(0.6, 5, ip=None), at(0.7, 6, v=None)],      # the third of its key; no key
        [at(9, 7, v="far")],                                        # moves the watermark, the first key expires
        [at(9.2, 8), at(0.3, 9, v="other")],                        # the expired key starts anew; a late row
        [at(9.4, 10)],
        [at(9.5, 11, v="far")],
    ]
    stream = streamed(spark, str(tmp_path / "in"), batches)
    got = {(r.general_full_id.split("_")[1], r.mqtt_message_value): r["count"]
           for r in replay_alerts(spark, stream, str(tmp_path), keep_seconds=3600, watermark="30 minutes").collect()}
    assert got == {("10.0.0.1", "x"): 3, ("10.0.0.1", "far"): 2}
    empty = streamed(spark, str(tmp_path / "in2"), [[at(0, 1, v="a"), at(0, 2, v="b")]])
    assert replay_alerts(spark, empty, str(tmp_path)).collect() == []
