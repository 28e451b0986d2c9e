"""Per-IP features and the threshold label: strict edges, null IPs, skew."""

from brokerlens.functions.temporal import temporal_features
from brokerlens.operators import ip_features as ipf
from brokerlens.plans.prepare import labelled_messages
from tests.helpers import frame, msg


def _ip_block(start, n, ip, topics, dup_every=None):
    return [msg(start + i, ip=ip, topic=f"t/{i % topics}", dup=bool(dup_every and i % dup_every == 0))
            for i in range(n)]


def test_threshold_edges_are_strict(spark):
    rows = (_ip_block(0, 200, "ip200", 2)            # 200 msgs, few topics -> not > 200
            + _ip_block(1000, 201, "ip201", 2)       # 201 msgs, 2 topics -> attack
            + _ip_block(2000, 201, "ip201t5", 5)     # 5 topics, no dup -> not < 5
            + _ip_block(3000, 201, "ip201t4", 4))    # 4 topics -> attack
    lab = labelled_messages(frame(spark, rows))
    got = {r["general_ip"]: r["is_ddos"] for r in lab.select("general_ip", "is_ddos").distinct().collect()}
    assert got == {"ip200": 0, "ip201": 1, "ip201t5": 0, "ip201t4": 1}


def test_duplicate_rate_edge(spark):
    # 300 msgs, 10 topics, 90 duplicates = exactly 0.3 -> not > 0.3
    rows = [msg(i, ip="a", topic=f"t{i % 10}", dup=i < 90) for i in range(300)]
    rows += [msg(1000 + i, ip="b", topic=f"t{i % 10}", dup=i < 91) for i in range(300)]
    lab = labelled_messages(frame(spark, rows))
    got = {r["general_ip"]: r["is_ddos"] for r in lab.select("general_ip", "is_ddos").distinct().collect()}
    assert got == {"a": 0, "b": 1}


def test_null_ip_is_label_zero_and_not_a_group(spark):
    rows = [msg(i, ip=None, topic="t") for i in range(250)] + [msg(500 + i, ip="z") for i in range(3)]
    df = frame(spark, rows)
    stats = ipf.per_ip_stats(df).collect()
    assert [r["general_ip"] for r in stats] == ["z"]
    lab = labelled_messages(df)
    assert lab.where("general_ip IS NULL").agg({"is_ddos": "max"}).first()[0] == 0
    assert lab.where("general_ip IS NULL").select("requests_per_ip").distinct().collect()[0][0] is None


def test_hot_ip_third_of_rows(spark):
    """One IP owns a third of all rows; features stay exact."""
    rows = [msg(i, ip="hot", topic=f"t{i % 3}", dup=i % 2 == 0) for i in range(3000)]
    rows += [msg(10000 + i, ip=f"ip{i % 200}", topic=f"t{i % 50}") for i in range(6000)]
    stats = {r["general_ip"]: r for r in ipf.per_ip_stats(frame(spark, rows)).collect()}
    assert stats["hot"]["requests_per_ip"] == 3000
    assert stats["hot"]["unique_topics_per_ip"] == 3
    assert abs(stats["hot"]["duplicate_rate_per_ip"] - 0.5) < 1e-12
    assert stats["ip7"]["requests_per_ip"] == 30


def test_label_distribution_and_imbalance_one_class(spark):
    df = labelled_messages(frame(spark, [msg(i, ip="a") for i in range(10)]))
    dist = ipf.label_distribution(df).collect()
    assert [(r["is_ddos"], r["count"], r["percent"]) for r in dist] == [(0, 10, 100.0)]
    imb = ipf.imbalance_ratio(df).first()
    assert imb["imbalance_ratio"] is None and imb["imbalance_band"] is None


def test_suspicion_score_ties_and_formula(spark):
    rows = [msg(i, ip="b", topic=f"t{i % 2}", dup=i % 2 == 0) for i in range(4)]
    rows += [msg(100 + i, ip="a", topic="t") for i in range(4)]
    rows += [msg(200 + i, ip="c", topic="t") for i in range(2)]
    out = ipf.suspicion_score(frame(spark, rows), top_n=2, k=10).collect()
    assert [r["general_ip"] for r in out] == ["b", "a"]   # tie on count broken by IP, c not in top 2
    assert abs(out[0]["suspicion_score"] - (1.0 + 0.5) / 2) < 1e-12
    assert out[0]["unique_topics"] == 2


def test_temporal_features_monday_zero(spark):
    import datetime as dt
    rows = [msg(1, ts=dt.datetime(2024, 1, 1, 23, 0)), msg(2, ts=dt.datetime(2024, 1, 7, 5, 0))]
    r = temporal_features(frame(spark, rows)).orderBy("mqtt_message_id").collect()
    assert [(x["day_of_week"], x["day_name"], x["hour"]) for x in r] == [(0, "Monday", 23), (6, "Sunday", 5)]
