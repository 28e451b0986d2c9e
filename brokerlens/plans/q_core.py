"""Queries: label, per-IP features, flagship."""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens.operators import ip_features as ipf
from brokerlens.plans.prepare import fixture_labelled
from brokerlens.plans.registry import oq, register
from brokerlens.sources.fixture import mqtt_messages

FT = ipf.FIXTURE_THRESHOLDS


def labelled(spark, sf):
    return fixture_labelled(spark, sf, FT)


@register("suspicion_score", oq("""
, per_ip AS (SELECT general_ip, count(*) AS messages, count(mqtt_message_id) AS request_count,
                    avg(CAST(mqtt_duplicate AS DOUBLE)) AS duplicate_rate,
                    count(DISTINCT mqtt_topic) AS unique_topics
             FROM mqtt WHERE general_ip IS NOT NULL GROUP BY general_ip),
top20 AS (SELECT * FROM per_ip ORDER BY messages DESC, general_ip LIMIT 20),
scored AS (SELECT general_ip, request_count, duplicate_rate, unique_topics,
                  (request_count / max(request_count) OVER () + duplicate_rate) / 2 AS suspicion_score
           FROM top20)
SELECT * FROM scored ORDER BY suspicion_score DESC, general_ip LIMIT 10"""),
          dbl=("duplicate_rate", "suspicion_score"))
def q_suspicion_score(spark, sf):
    return ipf.suspicion_score(mqtt_messages(spark, sf))


@register("label_ddos", oq("""
SELECT mqtt_message_id, general_ip, requests_per_ip, duplicate_rate_per_ip, unique_topics_per_ip, is_ddos
FROM labelled"""), dbl=("duplicate_rate_per_ip",))
def q_label_ddos(spark, sf):
    return labelled(spark, sf).select("mqtt_message_id", "general_ip", "requests_per_ip",
                                      "duplicate_rate_per_ip", "unique_topics_per_ip", "is_ddos")


@register("requests_per_ip", oq("SELECT mqtt_message_id, general_ip, requests_per_ip FROM labelled"))
def q_requests_per_ip(spark, sf):
    return ipf.with_ip_features(mqtt_messages(spark, sf), features=["requests_per_ip"]) \
              .select("mqtt_message_id", "general_ip", "requests_per_ip")


@register("duplicate_rate_per_ip",
          oq("SELECT mqtt_message_id, general_ip, duplicate_rate_per_ip FROM labelled"),
          dbl=("duplicate_rate_per_ip",))
def q_duplicate_rate_per_ip(spark, sf):
    return ipf.with_ip_features(mqtt_messages(spark, sf), features=["duplicate_rate_per_ip"]) \
              .select("mqtt_message_id", "general_ip", "duplicate_rate_per_ip")


@register("unique_topics_per_ip",
          oq("SELECT mqtt_message_id, general_ip, unique_topics_per_ip FROM labelled"))
def q_unique_topics_per_ip(spark, sf):
    return ipf.with_ip_features(mqtt_messages(spark, sf), features=["unique_topics_per_ip"]) \
              .select("mqtt_message_id", "general_ip", "unique_topics_per_ip")


@register("avg_qos_retained_per_ip", oq("""
SELECT general_ip, avg_qos_per_ip, retained_rate_per_ip FROM ipf"""),
          dbl=("avg_qos_per_ip", "retained_rate_per_ip"))
def q_avg_qos_retained(spark, sf):
    return ipf.per_ip_stats(mqtt_messages(spark, sf)).select(
        "general_ip", "avg_qos_per_ip", "retained_rate_per_ip")


@register("per_ip_features", oq("SELECT * FROM ipf"),
          dbl=("duplicate_rate_per_ip", "avg_qos_per_ip", "retained_rate_per_ip"))
def q_per_ip_features(spark, sf):
    return ipf.per_ip_stats(mqtt_messages(spark, sf))


@register("attacking_ips", oq(f"""
SELECT * FROM ipf WHERE requests_per_ip > {FT.requests}
  AND (duplicate_rate_per_ip > {FT.duplicate_rate} OR unique_topics_per_ip < {FT.topics})"""),
          dbl=("duplicate_rate_per_ip", "avg_qos_per_ip", "retained_rate_per_ip"))
def q_attacking_ips(spark, sf):
    return ipf.attacking_ips(mqtt_messages(spark, sf), t=FT)


@register("label_distribution", oq("""
SELECT is_ddos, count(*) AS count, count(*) * 100.0 / (SELECT count(*) FROM labelled) AS percent
FROM labelled GROUP BY is_ddos"""), dbl=("percent",))
def q_label_distribution(spark, sf):
    return ipf.label_distribution(labelled(spark, sf))


@register("imbalance_ratio", oq("""
SELECT count(*) FILTER (WHERE is_ddos = 0) AS n_normal, count(*) FILTER (WHERE is_ddos = 1) AS n_ddos,
       CAST(count(*) FILTER (WHERE is_ddos = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE is_ddos = 1), 0) AS imbalance_ratio,
       CASE WHEN count(*) FILTER (WHERE is_ddos = 1) = 0 THEN NULL
            WHEN CAST(count(*) FILTER (WHERE is_ddos = 0) AS DOUBLE) / count(*) FILTER (WHERE is_ddos = 1) > 5 THEN 'extreme'
            WHEN CAST(count(*) FILTER (WHERE is_ddos = 0) AS DOUBLE) / count(*) FILTER (WHERE is_ddos = 1) > 2 THEN 'resample'
            ELSE 'balanced' END AS imbalance_band
FROM labelled"""), dbl=("imbalance_ratio",))
def q_imbalance_ratio(spark, sf):
    return ipf.imbalance_ratio(labelled(spark, sf))


@register("avg_qos_per_ip", oq("SELECT mqtt_message_id, general_ip, avg_qos_per_ip FROM labelled"),
          dbl=("avg_qos_per_ip",))
def q_avg_qos_per_ip(spark, sf):
    return ipf.with_ip_features(mqtt_messages(spark, sf), features=["avg_qos_per_ip"]) \
              .select("mqtt_message_id", "general_ip", "avg_qos_per_ip")


@register("retained_rate_per_ip", oq("SELECT mqtt_message_id, general_ip, retained_rate_per_ip FROM labelled"),
          dbl=("retained_rate_per_ip",))
def q_retained_rate_per_ip(spark, sf):
    return ipf.with_ip_features(mqtt_messages(spark, sf), features=["retained_rate_per_ip"]) \
              .select("mqtt_message_id", "general_ip", "retained_rate_per_ip")
