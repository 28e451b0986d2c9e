"""Queries: sources, sinks, catalog and the streaming rate limit."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import functions as F

from brokerlens.operators.cleaning import MODEL_FEATURES
from brokerlens.operators.ip_features import FIXTURE_THRESHOLDS as FT
from brokerlens.plans.prepare import fixture_labelled
from brokerlens.plans.q_stats import ANOVA
from brokerlens.plans.registry import oq, register
from brokerlens.session import ensure_checkpoint_dir
from brokerlens.sources import sinks as SK
from brokerlens.sources.fixture import MQTT_FIXTURE_SQL, mqtt_messages
from brokerlens.sources.readers import cached_messages, read_messages
from brokerlens.sources.schema import MESSAGE_SCHEMA
from brokerlens.streaming.rate_limit import rate_limit_alerts


def shared_dir(spark):
    """A fresh folder under the session's shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/out-{uuid.uuid4().hex}"


def raw_csv(spark, sf):
    """Write the fixture messages as CSV with the reference's column names
    (``@timestamp`` text, ``general_full_id``) so the CSV reader is
    exercised on the real input format."""
    m = mqtt_messages(spark, sf)
    out = shared_dir(spark) + "/messages_csv"
    m.select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("@timestamp"), "general_ip", "general_mac",
             "general_device_name",
             F.concat_ws("_", "general_mac", "general_ip", "mqtt_topic").alias("general_full_id"), "mqtt_topic",
             "mqtt_message_type", "mqtt_message_value", "mqtt_message_id", "mqtt_qos", "mqtt_duplicate",
             "mqtt_retained").write.option("header", True).csv(out)
    return out


@register("read_messages", oq("""
SELECT mqtt_message_id, ts AS timestamp_parsed, general_ip, mqtt_topic, mqtt_qos, mqtt_duplicate FROM mqtt"""))
def q_read_messages(spark, sf):
    """Round trip through CSV with the explicit message schema, then parse
    the timestamp text."""
    from brokerlens.functions.temporal import parse_timestamp
    df = read_messages(spark, raw_csv(spark, sf), "csv", MESSAGE_SCHEMA)
    return df.select("mqtt_message_id", parse_timestamp("@timestamp").alias("timestamp_parsed"), "general_ip",
                     "mqtt_topic", "mqtt_qos", "mqtt_duplicate")


@register("cached_messages", oq("""
SELECT CAST(is_ddos AS VARCHAR) AS key, count(*) AS count FROM labelled GROUP BY 1
UNION ALL SELECT CAST(hour AS VARCHAR), count(*) FROM labelled GROUP BY 1"""))
def q_cached(spark, sf):
    """Persisted labelled table (memory and disk), reused by two reports and freed after them."""
    from brokerlens.operators.basic import materialize
    lab = cached_messages(fixture_labelled(spark, sf, FT))
    a = lab.groupBy("is_ddos").count()
    b = lab.groupBy("hour").count()
    out = materialize(a.select(F.col("is_ddos").cast("string").alias("key"), "count").unionByName(
        b.select(F.col("hour").cast("string").alias("key"), "count")))      # a row per class and hour
    lab.unpersist()
    return out


@register("write_selected_features", oq("SELECT " + ", ".join(MODEL_FEATURES) + ", is_ddos FROM labelled"),
          dbl=("duplicate_rate_per_ip",))
def q_write_selected(spark, sf):
    """Write the ten model features with the label, read them back."""
    out = shared_dir(spark) + "/selected"
    SK.write_selected_features(fixture_labelled(spark, sf, FT), MODEL_FEATURES, out, fmt="parquet")
    return spark.read.parquet(out)


@register("write_feature_list", oq(ANOVA + " SELECT feature AS value FROM fs WHERE f_score IS NOT NULL "
                                            "ORDER BY f_score DESC, feature LIMIT 5"))
def q_write_feature_list(spark, sf):
    """Features with the top ANOVA F scores written one per line, read back."""
    from brokerlens.operators.stats import anova_f, select_k_best
    from brokerlens.plans.training import CUTOFF, prepared_parts
    tr, _, feats = prepared_parts(fixture_labelled(spark, sf, FT), cutoff=CUTOFF)
    names = [r["feature"] for r in select_k_best(anova_f(tr, feats), 5).collect()]
    out = shared_dir(spark) + "/features"
    SK.write_feature_list(spark, names, out)
    return spark.read.text(out)


CATALOG_ROWS = []
_seen = set()
for _g, _fs in SK.FEATURE_GROUPS:
    for _f in _fs:
        if _f not in _seen:
            _seen.add(_f)
            CATALOG_ROWS.append((_f, _g))
LABELLED_COLS = {"mqtt_qos", "mqtt_duplicate", "mqtt_retained", "requests_per_ip", "duplicate_rate_per_ip",
                 "unique_topics_per_ip", "hour", "day_of_week", "day", "month", "avg_qos_per_ip",
                 "retained_rate_per_ip"}


@register("feature_catalog", oq("\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, '{g}' AS \"group\", {'true' if f in LABELLED_COLS else 'false'} AS available, "
    + (f"count({f}) AS non_null FROM labelled" if f in LABELLED_COLS else "CAST(NULL AS BIGINT) AS non_null")
    for f, g in CATALOG_ROWS)))
def q_feature_catalog(spark, sf):
    return SK.feature_catalog(fixture_labelled(spark, sf, FT))


@register("rate_limit_stream", oq("""
SELECT general_ip, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       count(*) AS messages
FROM mqtt WHERE general_ip IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 7"""))
def q_rate_limit_stream(spark, sf):
    """Streaming rate limit over the events file (7 messages per IP-day),
    run to completion with an availableNow trigger; equals batch
    ``rate_limit``."""
    events = (spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema)
                   .option("basePath", sf).parquet(f"{sf}/events.parque[t]"))
    events.createOrReplaceTempView("events_stream")
    stream = spark.sql(MQTT_FIXTURE_SQL.replace("FROM events) e", "FROM events_stream) e"))
    return rate_limit_alerts(spark, stream, shared_dir(spark), 7, "1 day", "1 hour")


@register("daily_ip_state", oq("SELECT * FROM ipf"), dbl=("duplicate_rate_per_ip", "avg_qos_per_ip", "retained_rate_per_ip"))
def q_daily_ip_state(spark, sf):
    """Per-IP features added up from a state of one folder a day, written in two loads."""
    from brokerlens.operators import ip_state as IS
    from brokerlens.operators.basic import materialize
    m = mqtt_messages(spark, sf)
    base = shared_dir(spark) + "/ip_state"
    early = F.col("ts") < F.to_timestamp(F.lit("2024-01-16"))
    for part in (m.where(early), m.where(~early | F.col("ts").isNull())):
        IS.write_days(part, base)
    out = materialize(IS.roll_up(spark, base))       # one row per IP
    IS.release(spark, base)
    return out


@register("replay_stream", oq("""
SELECT general_mac || '_' || general_ip || '_' || mqtt_topic AS general_full_id, mqtt_message_value, count(*) AS count FROM mqtt
WHERE general_ip IS NOT NULL AND mqtt_message_value IS NOT NULL AND mqtt_topic IS NOT NULL AND ts IS NOT NULL
GROUP BY 1, 2 HAVING count(*) > 1"""))
def q_replay_stream(spark, sf):
    """Replays counted on the stream of events by keyed state that is kept for 60 days after a key's last message;
    equals batch ``replay_candidates``."""
    from brokerlens.streaming.replay import replay_alerts
    events = (spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema)
                   .option("basePath", sf).parquet(f"{sf}/events.parque[t]"))
    events.createOrReplaceTempView("events_stream")
    stream = spark.sql(MQTT_FIXTURE_SQL.replace("FROM events) e", "FROM events_stream) e"))
    return replay_alerts(spark, stream, shared_dir(spark), keep_seconds=60 * 86_400, watermark="60 days")
