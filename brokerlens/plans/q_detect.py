"""Queries: detection recipes, with the fixture thresholds of FIXTURES.md."""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens.functions.temporal import temporal_features
from brokerlens.operators import detect as D
from brokerlens.operators.ip_features import FIXTURE_THRESHOLDS as FT
from brokerlens.plans.prepare import fixture_labelled
from brokerlens.plans.registry import oq, register
from brokerlens.sources.fixture import mqtt_messages

KNOWN_TOPICS = [f"iiot/{e}/{i}" for e in ("signup", "view") for i in range(10)]
FULL_ID = "general_mac || '_' || general_ip || '_' || mqtt_topic"


def msgs(spark, sf):
    return mqtt_messages(spark, sf)


def labelled(spark, sf):
    return fixture_labelled(spark, sf, FT)


@register("hourly_spikes", oq("""
, h AS (SELECT hour, count(*) AS count FROM labelled WHERE hour IS NOT NULL GROUP BY 1),
t AS (SELECT avg(count) + 1.5 * stddev_samp(count) AS threshold FROM h)
SELECT hour, count, threshold FROM h, t WHERE count > threshold"""), dbl=("threshold",))
def q_hourly_spikes(spark, sf):
    return D.hourly_spikes(temporal_features(msgs(spark, sf)), 1.5)


@register("high_volume_ips", oq("""
SELECT general_ip, count(*) AS messages FROM mqtt WHERE general_ip IS NOT NULL GROUP BY 1 HAVING count(*) > 66"""))
def q_high_volume(spark, sf):
    return D.high_volume_ips(msgs(spark, sf), 66)


@register("subnet_sources", oq("""
SELECT nullif(regexp_extract(general_ip, '^(\\d+\\.\\d+\\.\\d+)\\.\\d+$', 1), '') AS subnet,
       count(DISTINCT general_ip) AS n_ips, count(*) AS messages
FROM mqtt WHERE general_ip IS NOT NULL AND subnet IS NOT NULL GROUP BY 1"""))
def q_subnets(spark, sf):
    return D.subnet_sources(msgs(spark, sf))


BLOCK_SQL = """
, block AS (SELECT general_ip, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS messages
            FROM labelled WHERE general_ip IS NOT NULL AND is_ddos = 1 GROUP BY 1)"""


@register("blocklist", oq(BLOCK_SQL + " SELECT * FROM block"))
def q_blocklist(spark, sf):
    return D.blocklist(labelled(spark, sf))


@register("filter_blocked", oq(BLOCK_SQL + """
SELECT mqtt_message_id, general_ip, mqtt_topic, ts FROM mqtt m
WHERE NOT EXISTS (SELECT 1 FROM block b WHERE b.general_ip = m.general_ip)"""))
def q_filter_blocked(spark, sf):
    lab = labelled(spark, sf)
    return D.filter_blocked(msgs(spark, sf), D.blocklist(lab)).select(
        "mqtt_message_id", "general_ip", "mqtt_topic", "ts")


@register("rate_limit", oq("""
SELECT general_ip, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       count(*) AS messages
FROM mqtt WHERE general_ip IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 7"""))
def q_rate_limit(spark, sf):
    return D.rate_limit(msgs(spark, sf), 7, "1 day")


@register("compromised_devices", oq("""
SELECT mqtt_message_id, general_mac, general_ip, is_ddos FROM labelled l
WHERE general_mac IN (SELECT general_mac FROM labelled WHERE is_ddos = 1 AND general_mac IS NOT NULL)"""))
def q_compromised(spark, sf):
    return D.compromised_devices(labelled(spark, sf)).select("mqtt_message_id", "general_mac", "general_ip", "is_ddos")


@register("ip_mac_mismatch", oq("""
SELECT general_mac, count(DISTINCT general_ip) AS n_ips FROM mqtt WHERE general_mac IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT general_ip) > 1"""))
def q_ip_mac(spark, sf):
    return D.ip_mac_mismatch(msgs(spark, sf))


@register("vulnerable_devices", oq("""
SELECT general_device_name, avg(CAST(is_ddos AS DOUBLE)) AS attack_rate, count(*) AS messages FROM labelled
WHERE general_device_name IS NOT NULL GROUP BY 1 HAVING avg(CAST(is_ddos AS DOUBLE)) > 0.15"""), dbl=("attack_rate",))
def q_vulnerable(spark, sf):
    return D.vulnerable_devices(labelled(spark, sf), 0.15)


@register("build_full_id", oq(f"SELECT mqtt_message_id, {FULL_ID} AS general_full_id FROM mqtt"))
def q_full_id(spark, sf):
    return msgs(spark, sf).select("mqtt_message_id", D.build_full_id().alias("general_full_id"))


@register("deduplicate_messages", oq(f"""
, f AS (SELECT *, {FULL_ID} AS general_full_id FROM mqtt)
SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY general_full_id, ts ORDER BY
  mqtt_message_id NULLS FIRST, general_ip NULLS FIRST, general_mac NULLS FIRST, general_device_name NULLS FIRST,
  mqtt_topic NULLS FIRST, mqtt_message_type NULLS FIRST, mqtt_message_value NULLS FIRST, mqtt_qos NULLS FIRST,
  mqtt_duplicate NULLS FIRST, mqtt_retained NULLS FIRST, value NULLS FIRST) = 1"""), dbl=("value",))
def q_dedup(spark, sf):
    return D.deduplicate_messages(msgs(spark, sf))


@register("replay_candidates", oq(f"""
SELECT {FULL_ID} AS general_full_id, mqtt_message_value, count(*) AS count FROM mqtt
WHERE general_ip IS NOT NULL AND mqtt_message_value IS NOT NULL AND {FULL_ID} IS NOT NULL
GROUP BY 1, 2 HAVING count(*) > 1"""))
def q_replay(spark, sf):
    return D.replay_candidates(msgs(spark, sf))


@register("topic_levels", oq("""
SELECT DISTINCT mqtt_topic, string_split(mqtt_topic, '/') AS levels,
       CAST(len(string_split(mqtt_topic, '/')) AS INTEGER) AS depth, string_split(mqtt_topic, '/')[1] AS root
FROM mqtt WHERE mqtt_topic IS NOT NULL"""))
def q_topic_levels(spark, sf):
    return D.topic_structure(msgs(spark, sf))


@register("match_topic_filter", oq("""
SELECT mqtt_message_id, mqtt_topic FROM mqtt WHERE regexp_full_match(mqtt_topic, 'iiot/[^/]*/3')"""))
def q_match_filter(spark, sf):
    return D.match_topic_filter(msgs(spark, sf), "iiot/+/3").select("mqtt_message_id", "mqtt_topic")


FILTERS = [f"iiot/{kind}/{level}" for kind in ("+", "view", "click", "error", "purchase") for level in ("+", "#", *range(10))] + ["#", "+/+", "iiot/#", "$SYS/#"]


@register("match_topic_filters", oq("""
, filters AS (SELECT unnest([""" + ", ".join(f"'{f}'" for f in FILTERS) + """]) AS filter),
patterns AS (SELECT filter, CASE WHEN filter = '#' THEN '.*' ELSE replace(replace(replace(filter, '$', '[$]'), '/#', '(/.*)?'), '+', '[^/]*') END AS p FROM filters),
topics AS (SELECT DISTINCT mqtt_topic FROM mqtt WHERE mqtt_topic IS NOT NULL)
SELECT mqtt_topic, filter FROM topics JOIN patterns ON regexp_full_match(mqtt_topic, p)"""))
def q_match_filters(spark, sf):
    """Every topic with all the filters of a table that it matches."""
    from brokerlens.operators.topic_trie import match_topic_filters
    return match_topic_filters(msgs(spark, sf), spark.createDataFrame([(f,) for f in FILTERS], "filter string"))


@register("flooded_topics", oq("""
SELECT mqtt_topic, count(*) AS attack_messages FROM labelled WHERE is_ddos = 1 AND mqtt_topic IS NOT NULL
GROUP BY 1 HAVING count(*) > 15"""))
def q_flooded(spark, sf):
    return D.flooded_topics(labelled(spark, sf), 15)


@register("new_topics", oq("SELECT mqtt_topic, count(*) AS messages FROM mqtt WHERE mqtt_topic IS NOT NULL AND mqtt_topic NOT IN ("
                           + ", ".join(f"'{t}'" for t in KNOWN_TOPICS) + ") GROUP BY 1"))
def q_new_topics(spark, sf):
    return D.new_topics(msgs(spark, sf), KNOWN_TOPICS)


@register("low_topic_diversity", oq("""
SELECT general_ip, count(DISTINCT mqtt_topic) AS unique_topics FROM mqtt WHERE general_ip IS NOT NULL
GROUP BY 1 HAVING count(DISTINCT mqtt_topic) < 33"""))
def q_low_div(spark, sf):
    return D.low_topic_diversity(msgs(spark, sf), 33)


@register("connect_flood", oq("""
SELECT count(*) FILTER (WHERE mqtt_message_type = 'CONNECT') AS connect_messages,
       CAST(count(*) FILTER (WHERE mqtt_message_type = 'CONNECT') AS DOUBLE) / count(*) AS connect_share,
       CAST(count(*) FILTER (WHERE mqtt_message_type = 'CONNECT') AS DOUBLE) / count(*) > 0.2 AS connect_flood
FROM mqtt"""), dbl=("connect_share",))
def q_connect_flood(spark, sf):
    return D.connect_flood(msgs(spark, sf), 0.2)


@register("wildcard_subscribers", oq("""
SELECT general_ip, count(*) FILTER (WHERE mqtt_message_type = 'SUBSCRIBE') AS subscribes,
       count(*) FILTER (WHERE mqtt_message_type = 'SUBSCRIBE' AND contains(mqtt_topic, '#')) AS wildcard_subscribes
FROM mqtt WHERE general_ip IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (WHERE mqtt_message_type = 'SUBSCRIBE') > 0"""))
def q_wildcard(spark, sf):
    return D.wildcard_subscribers(msgs(spark, sf))


@register("large_payloads", oq("""
SELECT mqtt_message_id, general_ip, CAST(length(mqtt_message_value) AS INTEGER) AS payload_length
FROM mqtt WHERE length(mqtt_message_value) > 35"""))
def q_large_payloads(spark, sf):
    return D.large_payloads(msgs(spark, sf), 35).select("mqtt_message_id", "general_ip", "payload_length")


@register("repeated_payloads", oq("""
SELECT general_ip, mqtt_message_value, count(*) AS count FROM mqtt
WHERE general_ip IS NOT NULL AND mqtt_message_value IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""))
def q_repeated(spark, sf):
    return D.repeated_payloads(msgs(spark, sf))


@register("empty_payloads", oq("""
SELECT general_ip, count(*) FILTER (WHERE mqtt_message_value IS NULL OR mqtt_message_value = '') AS empty_payloads,
       count(*) AS messages FROM mqtt WHERE general_ip IS NOT NULL GROUP BY 1
HAVING count(*) FILTER (WHERE mqtt_message_value IS NULL OR mqtt_message_value = '') > 0"""))
def q_empty(spark, sf):
    return D.empty_payloads(msgs(spark, sf))


@register("qos2_abuse", oq("""
SELECT count(*) FILTER (WHERE mqtt_qos = 2) AS qos2_messages,
       CAST(count(*) FILTER (WHERE mqtt_qos = 2) AS DOUBLE) / count(*) AS qos2_share,
       CAST(count(*) FILTER (WHERE mqtt_qos = 2) AS DOUBLE) / count(*) > 0.3 AS qos2_abuse FROM mqtt"""),
          dbl=("qos2_share",))
def q_qos2(spark, sf):
    return D.qos2_abuse(msgs(spark, sf), 0.3)


@register("qos_by_ip", oq("""
SELECT general_ip, avg(CAST(mqtt_qos AS DOUBLE)) AS avg_qos FROM mqtt WHERE general_ip IS NOT NULL
GROUP BY 1 HAVING avg(CAST(mqtt_qos AS DOUBLE)) > 1.15"""), dbl=("avg_qos",))
def q_qos_by_ip(spark, sf):
    return D.qos_by_ip(msgs(spark, sf), 1.15)


@register("qos_volume_mix", oq("""
SELECT general_ip, avg(CAST(mqtt_qos AS DOUBLE)) AS avg_qos, count(*) AS messages FROM mqtt
WHERE general_ip IS NOT NULL GROUP BY 1 HAVING avg(CAST(mqtt_qos AS DOUBLE)) > 1.05 AND count(*) > 60"""),
          dbl=("avg_qos",))
def q_qos_volume(spark, sf):
    return D.qos_volume_mix(msgs(spark, sf), 1.05, 60)
