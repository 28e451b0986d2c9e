"""Queries: time, network, protocol and class-conditional reports."""

from __future__ import annotations

from brokerlens.functions.temporal import temporal_features
from brokerlens.operators import reports as R
from brokerlens.operators.basic import value_counts
from brokerlens.plans.oracle_sql import hist, vc
from brokerlens.plans.prepare import fixture_labelled
from brokerlens.plans.registry import oq, register
from brokerlens.operators.ip_features import FIXTURE_THRESHOLDS as FT
from brokerlens.sources.fixture import mqtt_messages

HB = ("bin_lo", "bin_hi")


def msgs(spark, sf):
    return mqtt_messages(spark, sf)


def timed(spark, sf):
    return temporal_features(mqtt_messages(spark, sf))


def labelled(spark, sf):
    return fixture_labelled(spark, sf, FT)


@register("messages_by_hour", oq("SELECT hour, count(*) AS count FROM labelled WHERE hour IS NOT NULL GROUP BY hour"))
def q_by_hour(spark, sf):
    return R.messages_by_hour(timed(spark, sf))


@register("messages_by_weekday", oq("""
SELECT day_of_week, day_name, count(*) AS count FROM labelled WHERE day_of_week IS NOT NULL GROUP BY ALL"""))
def q_by_weekday(spark, sf):
    return R.messages_by_weekday(timed(spark, sf))


@register("daily_timeline", oq("SELECT CAST(ts AS DATE) AS date, count(*) AS count FROM mqtt WHERE ts IS NOT NULL GROUP BY 1"))
def q_daily(spark, sf):
    return R.daily_timeline(msgs(spark, sf))


@register("weekday_hour_heatmap", oq(
    "SELECT day_of_week, day_name, "
    + ", ".join(f"count(*) FILTER (WHERE hour = {h}) AS h{h}" for h in range(24))
    + " FROM labelled WHERE day_of_week IS NOT NULL GROUP BY ALL"))
def q_heatmap(spark, sf):
    return R.weekday_hour_heatmap(timed(spark, sf))


@register("time_span", oq("""
SELECT min(ts) AS first_seen, max(ts) AS last_seen,
       CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000) AS BIGINT) AS span_days FROM mqtt"""))
def q_time_span(spark, sf):
    return R.time_span(msgs(spark, sf))


@register("network_cardinality", oq("""
SELECT count(DISTINCT general_ip) AS n_ips, count(DISTINCT general_mac) AS n_macs,
       count(DISTINCT general_device_name) AS n_devices FROM mqtt"""))
def q_net_card(spark, sf):
    return R.network_cardinality(msgs(spark, sf))


@register("top_ips", oq(vc("general_ip", "mqtt", 15)))
def q_top_ips(spark, sf):
    return value_counts(msgs(spark, sf), "general_ip", 15)


@register("top_macs", oq(vc("general_mac", "mqtt", 15)))
def q_top_macs(spark, sf):
    return value_counts(msgs(spark, sf), "general_mac", 15)


@register("top_devices", oq(vc("general_device_name", "mqtt", 15)))
def q_top_devices(spark, sf):
    return value_counts(msgs(spark, sf), "general_device_name", 15)


@register("requests_per_ip_hist",
          oq(", per_ip AS (SELECT general_ip, count(*) AS messages FROM mqtt WHERE general_ip IS NOT NULL GROUP BY 1)"
             + hist("messages", "per_ip", 30)), dbl=HB)
def q_req_hist(spark, sf):
    return R.requests_per_ip_hist(msgs(spark, sf), 30)


@register("ip_activity_summary", oq("""
, per_ip AS (SELECT general_ip, count(*) AS messages FROM mqtt WHERE general_ip IS NOT NULL GROUP BY 1)
SELECT (SELECT avg(messages) FROM per_ip) AS mean_messages_per_ip, general_ip AS top_ip, messages AS top_ip_messages
FROM per_ip ORDER BY messages DESC, general_ip LIMIT 1"""), dbl=("mean_messages_per_ip",))
def q_ip_activity(spark, sf):
    return R.ip_activity_summary(msgs(spark, sf))


@register("mqtt_cardinality", oq("""
SELECT count(DISTINCT mqtt_topic) AS n_topics, count(DISTINCT mqtt_message_type) AS n_message_types,
       array_agg(DISTINCT mqtt_message_type ORDER BY mqtt_message_type)
         FILTER (WHERE mqtt_message_type IS NOT NULL) AS message_types FROM mqtt"""))
def q_mqtt_card(spark, sf):
    return R.mqtt_cardinality(msgs(spark, sf))


@register("duplicate_retained_rate", oq("""
SELECT CAST(sum(CAST(mqtt_duplicate AS BIGINT)) AS DOUBLE) * 100 / count(*) AS duplicate_rate_pct,
       CAST(sum(CAST(mqtt_retained AS BIGINT)) AS DOUBLE) * 100 / count(*) AS retained_rate_pct FROM mqtt"""),
          dbl=("duplicate_rate_pct", "retained_rate_pct"))
def q_flag_rates(spark, sf):
    return R.flag_rates(msgs(spark, sf))


@register("message_type_distribution", oq(vc("mqtt_message_type", "mqtt", percent=True)), dbl=("percent",))
def q_type_dist(spark, sf):
    return value_counts(msgs(spark, sf), "mqtt_message_type", percent=True)


@register("top_topics", oq(vc("mqtt_topic", "mqtt", 20)))
def q_top_topics(spark, sf):
    return value_counts(msgs(spark, sf), "mqtt_topic", 20)


@register("duplicate_distribution", oq(vc("mqtt_duplicate", "mqtt", percent=True)), dbl=("percent",))
def q_dup_dist(spark, sf):
    return value_counts(msgs(spark, sf), "mqtt_duplicate", percent=True)


@register("retained_distribution", oq(vc("mqtt_retained", "mqtt", percent=True)), dbl=("percent",))
def q_ret_dist(spark, sf):
    return value_counts(msgs(spark, sf), "mqtt_retained", percent=True)


@register("message_length_stats", oq("""
SELECT avg(length(mqtt_message_value)) AS mean_length,
       CAST(median(length(mqtt_message_value)) AS DOUBLE) AS median_length,
       CAST(max(length(mqtt_message_value)) AS INTEGER) AS max_length,
       count(*) FILTER (WHERE mqtt_message_value IS NULL) AS null_payloads FROM mqtt"""),
          dbl=("mean_length", "median_length"))
def q_len_stats(spark, sf):
    return R.message_length_stats(msgs(spark, sf))


@register("message_length_hist", oq(hist("length(mqtt_message_value)", "mqtt", 50)), dbl=HB)
def q_len_hist(spark, sf):
    return R.message_length_hist(msgs(spark, sf), 50)


@register("message_presence", oq("""
SELECT count(mqtt_message_value) AS with_payload, count(*) - count(mqtt_message_value) AS without_payload,
       CAST(count(mqtt_message_value) AS DOUBLE) * 100 / count(*) AS with_payload_pct,
       CAST(count(*) - count(mqtt_message_value) AS DOUBLE) * 100 / count(*) AS without_payload_pct FROM mqtt"""),
          dbl=("with_payload_pct", "without_payload_pct"))
def q_presence(spark, sf):
    return R.message_presence(msgs(spark, sf))


@register("top_duplicate_ips", oq("""
SELECT general_ip, avg(CAST(mqtt_duplicate AS DOUBLE)) AS duplicate_rate FROM mqtt
WHERE general_ip IS NOT NULL GROUP BY 1 ORDER BY duplicate_rate DESC NULLS LAST, general_ip LIMIT 10"""),
          dbl=("duplicate_rate",))
def q_top_dup_ips(spark, sf):
    return R.top_duplicate_ips(msgs(spark, sf), 10)


@register("top_active_ips", oq(vc("general_ip", "mqtt", 10)))
def q_top_active(spark, sf):
    return value_counts(msgs(spark, sf), "general_ip", 10)


@register("top_target_topics", oq(vc("mqtt_topic", "mqtt", 10)))
def q_top_target(spark, sf):
    return value_counts(msgs(spark, sf), "mqtt_topic", 10)


# ---- class-conditional -------------------------------------------------------
@register("crosstab_count", oq("""
SELECT mqtt_message_type, count(*) FILTER (WHERE is_ddos = 0) AS normal, count(*) FILTER (WHERE is_ddos = 1) AS ddos
FROM labelled WHERE mqtt_message_type IS NOT NULL GROUP BY 1"""))
def q_crosstab_count(spark, sf):
    return R.crosstab_count(labelled(spark, sf), "mqtt_message_type")


@register("crosstab_percent", oq("""
SELECT mqtt_message_type,
       CAST(count(*) FILTER (WHERE is_ddos = 0) AS DOUBLE) * 100 / count(*) AS normal_pct,
       CAST(count(*) FILTER (WHERE is_ddos = 1) AS DOUBLE) * 100 / count(*) AS ddos_pct
FROM labelled WHERE mqtt_message_type IS NOT NULL GROUP BY 1"""), dbl=("normal_pct", "ddos_pct"))
def q_crosstab_pct(spark, sf):
    return R.crosstab_percent(labelled(spark, sf), "mqtt_message_type")


@register("hourly_by_class", oq("""
SELECT hour, count(*) FILTER (WHERE is_ddos = 0) AS normal, count(*) FILTER (WHERE is_ddos = 1) AS ddos
FROM labelled WHERE hour IS NOT NULL GROUP BY 1"""))
def q_hourly_class(spark, sf):
    return R.hourly_by_class(labelled(spark, sf))


@register("weekday_by_class", oq("""
SELECT day_of_week, day_name, count(*) FILTER (WHERE is_ddos = 0) AS normal,
       count(*) FILTER (WHERE is_ddos = 1) AS ddos
FROM labelled WHERE day_of_week IS NOT NULL GROUP BY ALL"""))
def q_weekday_class(spark, sf):
    return R.weekday_by_class(labelled(spark, sf))


DUR_SQL = """
, dur AS (SELECT general_ip, min(ts) AS first_seen, max(ts) AS last_seen,
                 (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS duration_s
          FROM labelled WHERE is_ddos = 1 AND general_ip IS NOT NULL GROUP BY 1),
dlong AS (SELECT general_ip, 's' AS unit, duration_s AS duration FROM dur
          UNION ALL SELECT general_ip, 'min', duration_s / 60.0 FROM dur
          UNION ALL SELECT general_ip, 'h', duration_s / 3600.0 FROM dur)"""


@register("attack_duration", oq(DUR_SQL + """
SELECT general_ip, first_seen, last_seen, duration_s, duration_s / 60.0 AS duration_min,
       duration_s / 3600.0 AS duration_h FROM dur"""), dbl=("duration_s", "duration_min", "duration_h"))
def q_attack_duration(spark, sf):
    return R.attack_duration(labelled(spark, sf))


@register("attack_duration_summary", oq(DUR_SQL + """
SELECT unit, avg(duration) AS mean, median(duration) AS median, min(duration) AS min, max(duration) AS max,
       count(*) AS n_ips FROM dlong GROUP BY unit"""), dbl=("mean", "median", "min", "max"))
def q_attack_duration_summary(spark, sf):
    return R.attack_duration_summary(labelled(spark, sf))


@register("attack_duration_hist", oq(DUR_SQL + hist("duration", "dlong", 50, by="unit")), dbl=HB)
def q_attack_duration_hist(spark, sf):
    return R.attack_duration_hist(labelled(spark, sf), 50)


@register("duplicate_rate", oq("""
SELECT CAST(sum(CAST(mqtt_duplicate AS BIGINT)) AS DOUBLE) * 100 / count(*) AS duplicate_rate_pct FROM mqtt"""),
          dbl=("duplicate_rate_pct",))
def q_dup_rate(spark, sf):
    return R.flag_rates(msgs(spark, sf)).select("duplicate_rate_pct")


@register("retained_rate", oq("""
SELECT CAST(sum(CAST(mqtt_retained AS BIGINT)) AS DOUBLE) * 100 / count(*) AS retained_rate_pct FROM mqtt"""),
          dbl=("retained_rate_pct",))
def q_ret_rate(spark, sf):
    return R.flag_rates(msgs(spark, sf)).select("retained_rate_pct")
