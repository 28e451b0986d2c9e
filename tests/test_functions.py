"""Scalar helpers: timestamps, MQTT wildcards, payloads."""

import pytest
from pyspark.sql import functions as F

from brokerlens.functions.temporal import parse_timestamp
from brokerlens.functions.topics import matches_topic_filter, topic_filter_regex
from brokerlens.operators import detect as D
from tests.helpers import frame, msg


def test_parse_timestamp_bad_text_is_null(spark):
    df = spark.createDataFrame([("2026-01-10T14:30:00Z",), ("garbage",), (None,)], ["@timestamp"])
    got = [r[0] for r in df.select(parse_timestamp("@timestamp")).collect()]
    assert got[0].isoformat() == "2026-01-10T14:30:00" and got[1] is None and got[2] is None


@pytest.mark.parametrize("flt,topic,ok", [
    ("home/+/temperature", "home/a/temperature", True),
    ("home/+/temperature", "home/a/b/temperature", False),
    ("home/#", "home", True),
    ("home/#", "home/a/b/temperature", True),
    ("home/#", "homeX/a", False),
    ("#", "home/a", True),
    ("#", "$SYS/broker", False),
    ("+/a", "$SYS/a", False),
    ("home/+", "home/", True),
    ("a.b/c", "aXb/c", False),
])
def test_topic_filters(spark, flt, topic, ok):
    df = spark.createDataFrame([(topic,)], ["mqtt_topic"])
    assert df.select(matches_topic_filter(flt)).first()[0] is ok


def test_bad_filters_rejected():
    with pytest.raises(ValueError):
        topic_filter_regex("a/#/b")
    with pytest.raises(ValueError):
        topic_filter_regex("a/b+")


def test_replay_and_dedup(spark):
    rows = [msg(1, value="p"), msg(2, value="p"), msg(3, value="q"), msg(4, ip=None, value="p")]
    df = frame(spark, rows)
    rep = D.replay_candidates(df).collect()
    assert [(r["general_full_id"], r["mqtt_message_value"], r["count"]) for r in rep] == [("m1_10.0.0.1_a/b", "p", 2)]
    same_ts = frame(spark, [msg(5, ts=rows[0][1]), msg(1), msg(7, ts=rows[0][1])])
    dd = D.deduplicate_messages(same_ts).collect()
    assert sorted(r["mqtt_message_id"] for r in dd) == [1]


def test_rate_limit_windows(spark):
    import datetime as dt
    base = dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [msg(i, ts=base + dt.timedelta(seconds=i)) for i in range(5)]        # 5 in one minute
    rows += [msg(10 + i, ts=base + dt.timedelta(minutes=2, seconds=i)) for i in range(2)]
    out = D.rate_limit(frame(spark, rows), limit=4, window="1 minute").collect()
    assert [(r["window_start"], r["messages"]) for r in out] == [(base, 5)]


def test_empty_table_operators(spark):
    from brokerlens.operators import profile as P
    from brokerlens.operators.basic import histogram, value_counts
    empty = frame(spark, [])
    assert value_counts(empty, "general_ip", 5).collect() == []
    h = histogram(empty, "mqtt_qos", 4).collect()
    assert sum(r["count"] for r in h) == 0
    assert P.missing_total(empty).first()[0] == 0
    assert D.connect_flood(empty).first()["connect_share"] is None
