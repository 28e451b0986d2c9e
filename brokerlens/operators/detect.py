"""Traffic detection queries: floods, spoofing, rate limits, replay,
wildcards, payload and QoS abuse.

Defaults are the reference's fixed values; every threshold is a parameter.
Joins against derived IP/MAC/topic lists are left to AQE, which broadcasts
a list only when its measured size is under the threshold; lists given as
parameters are bounded by the caller and broadcast explicitly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.functions.scalar import message_length, ratio
from brokerlens.functions.topics import matches_topic_filter, topic_levels
from brokerlens.operators.basic import split_join

# Fixed values of the reference
HOURLY_SPIKE_STD = 3.0
HIGH_VOLUME = 200
RATE_LIMIT_PER_MINUTE = 100
FLOODED_TOPIC = 1000
LOW_TOPICS = 5
CONNECT_SHARE = 0.3
LARGE_PAYLOAD = 10000
QOS2_SHARE = 0.5
QOS_MEAN = 1.5
VULNERABLE_RATE = 0.5


def _ip(df):
    return df.where(F.col("general_ip").isNotNull())


def hourly_spikes(df: DataFrame, multiplier: float = HOURLY_SPIKE_STD) -> DataFrame:
    """Hours of the day whose message count exceeds mean + m * std (n-1)
    of the hourly counts.  The statistics are over <= 24 rows."""
    hourly = df.where(F.col("hour").isNotNull()).groupBy("hour").agg(F.count(F.lit(1)).alias("count"))
    thr = hourly.agg(F.avg("count") + F.lit(float(multiplier)) * F.stddev_samp("count")).scalar()
    return hourly.where(F.col("count") > thr).withColumn("threshold", thr)


def high_volume_ips(df: DataFrame, threshold: int = HIGH_VOLUME) -> DataFrame:
    return (_ip(df).groupBy("general_ip").agg(F.count(F.lit(1)).alias("messages"))
                   .where(F.col("messages") > threshold))


def ipv4_subnet24(col: str = "general_ip"):
    return F.nullif(F.regexp_extract(F.col(col), r"^(\d+\.\d+\.\d+)\.\d+$", 1), F.lit(""))


def subnet_sources(df: DataFrame) -> DataFrame:
    """Distinct IPs and messages per IPv4 /24 (coordinated sources)."""
    return (_ip(df).withColumn("subnet", ipv4_subnet24()).where(F.col("subnet").isNotNull())
                   .groupBy("subnet").agg(F.countDistinct("general_ip").alias("n_ips"),
                                          F.count(F.lit(1)).alias("messages")))


def blocklist(df: DataFrame, label: str = "is_ddos", ts: str = "ts") -> DataFrame:
    """Distinct attacking IPs with first and last attack message."""
    return (_ip(df).where(F.col(label) == 1).groupBy("general_ip")
                   .agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"),
                        F.count(F.lit(1)).alias("messages")))


def filter_blocked(df: DataFrame, blocked: DataFrame) -> DataFrame:
    """Messages whose IP is not on the block list (null IPs are kept)."""
    return split_join(df, blocked.select("general_ip"), "general_ip", "left_anti")


def rate_limit(df: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE, window: str = "1 minute",
               ts: str = "ts") -> DataFrame:
    """(IP, tumbling window) pairs with more than ``limit`` messages."""
    return (_ip(df).where(F.col(ts).isNotNull())
                   .groupBy("general_ip", F.window(ts, window).alias("w"))
                   .agg(F.count(F.lit(1)).alias("messages"))
                   .where(F.col("messages") > limit)
                   .select("general_ip", F.col("w.start").alias("window_start"),
                           F.col("w.end").alias("window_end"), "messages"))


def compromised_devices(df: DataFrame, label: str = "is_ddos") -> DataFrame:
    """All messages of the MACs that took part in an attack (semi join)."""
    macs = df.where((F.col(label) == 1) & F.col("general_mac").isNotNull()).select("general_mac").distinct()
    return split_join(df, macs, "general_mac", "left_semi")


def ip_mac_mismatch(df: DataFrame, min_ips: int = 1) -> DataFrame:
    """MACs seen with more than ``min_ips`` IPs (spoofing sign)."""
    return (df.where(F.col("general_mac").isNotNull())
              .groupBy("general_mac").agg(F.countDistinct("general_ip").alias("n_ips"))
              .where(F.col("n_ips") > min_ips))


def vulnerable_devices(df: DataFrame, threshold: float = VULNERABLE_RATE, label: str = "is_ddos") -> DataFrame:
    return (df.where(F.col("general_device_name").isNotNull()).groupBy("general_device_name")
              .agg(F.avg(F.col(label).cast("double")).alias("attack_rate"),
                   F.count(F.lit(1)).alias("messages"))
              .where(F.col("attack_rate") > threshold))


def build_full_id(mac: str = "general_mac", ip: str = "general_ip", topic: str = "mqtt_topic"):
    """MAC_IP_topic; null when any part is null."""
    return F.concat(F.col(mac), F.lit("_"), F.col(ip), F.lit("_"), F.col(topic))


def with_full_id(df: DataFrame) -> DataFrame:
    if "general_full_id" in df.columns:
        return df
    return df.withColumn("general_full_id", build_full_id())


def deduplicate_messages(df: DataFrame, keys=("general_full_id", "ts"),
                         order: str = "mqtt_message_id") -> DataFrame:
    """One message per key: the one with the smallest ``order`` value
    (null first), further ties by the remaining columns.

    A full id is null when one of its parts is; such messages are told apart by
    the parts themselves (MAC, IP, topic), so that messages of several devices
    are not taken for copies of one another.

    An aggregate ``min(struct)`` instead of ``row_number``: the partial
    aggregation collapses a hot group of copies on the map side, where a
    window would sort the whole group in one task."""
    df = with_full_id(df)
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys and c != order]
    best = F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("m")
    parts = []
    if "general_full_id" in keys:
        have = [c for c in ("general_mac", "general_ip", "mqtt_topic") if c in df.columns]
        parts = [F.when(F.col("general_full_id").isNull(), F.col(c)).alias(f"_part_{c}") for c in have]
    return df.groupBy(*keys, *parts).agg(best).select(*keys, "m.*").select(*df.columns)


def replay_candidates(df: DataFrame, min_count: int = 1) -> DataFrame:
    """Same full id and same payload seen more than ``min_count`` times."""
    df = with_full_id(df)
    return (df.where(F.col("general_ip").isNotNull() & F.col("mqtt_message_value").isNotNull()
                     & F.col("general_full_id").isNotNull())
              .groupBy("general_full_id", "mqtt_message_value").agg(F.count(F.lit(1)).alias("count"))
              .where(F.col("count") > min_count))


def topic_structure(df: DataFrame) -> DataFrame:
    """Distinct topics with their levels, depth and root level."""
    lv = topic_levels("mqtt_topic")
    return (df.where(F.col("mqtt_topic").isNotNull()).select("mqtt_topic").distinct()
              .select("mqtt_topic", lv.alias("levels"), F.size(lv).alias("depth"),
                      lv.getItem(0).alias("root")))


def match_topic_filter(df: DataFrame, topic_filter: str) -> DataFrame:
    """Messages whose topic matches an MQTT subscription filter (+, #)."""
    return df.where(matches_topic_filter(topic_filter))


def flooded_topics(df: DataFrame, threshold: int = FLOODED_TOPIC, label: str = "is_ddos") -> DataFrame:
    return (df.where((F.col(label) == 1) & F.col("mqtt_topic").isNotNull()).groupBy("mqtt_topic")
              .agg(F.count(F.lit(1)).alias("attack_messages"))
              .where(F.col("attack_messages") > threshold))


def new_topics(df: DataFrame, known) -> DataFrame:
    """Topics (with message counts) absent from ``known``: a DataFrame with
    a ``mqtt_topic`` column, or a list of topics given by the caller."""
    if not isinstance(known, DataFrame):
        spark = SparkSession.getActiveSession()
        known = F.broadcast(spark.createDataFrame([(t,) for t in known],
                                                  T.StructType([T.StructField("mqtt_topic", T.StringType())])))
    counts = (df.where(F.col("mqtt_topic").isNotNull()).groupBy("mqtt_topic")
                .agg(F.count(F.lit(1)).alias("messages")))
    return counts.join(known.select("mqtt_topic"), on="mqtt_topic", how="left_anti")


def low_topic_diversity(df: DataFrame, threshold: int = LOW_TOPICS) -> DataFrame:
    return (_ip(df).groupBy("general_ip").agg(F.countDistinct("mqtt_topic").alias("unique_topics"))
                   .where(F.col("unique_topics") < threshold))


def connect_flood(df: DataFrame, threshold: float = CONNECT_SHARE) -> DataFrame:
    """Share of CONNECT packets among all messages, and the alert."""
    n_conn = F.count(F.when(F.col("mqtt_message_type") == "CONNECT", 1))
    share = ratio(n_conn, F.count(F.lit(1)))
    return df.agg(n_conn.alias("connect_messages"), share.alias("connect_share"),
                  (share > F.lit(threshold)).alias("connect_flood"))


def wildcard_subscribers(df: DataFrame) -> DataFrame:
    """Per IP: SUBSCRIBE packets and those whose topic uses a '#' wildcard."""
    sub = F.col("mqtt_message_type") == "SUBSCRIBE"
    return (_ip(df).groupBy("general_ip")
                   .agg(F.count(F.when(sub, 1)).alias("subscribes"),
                        F.count(F.when(sub & F.col("mqtt_topic").contains("#"), 1)).alias("wildcard_subscribes"))
                   .where(F.col("subscribes") > 0))


def large_payloads(df: DataFrame, threshold: int = LARGE_PAYLOAD) -> DataFrame:
    return (df.withColumn("payload_length", message_length())
              .where(F.col("payload_length") > threshold))


def repeated_payloads(df: DataFrame, min_count: int = 1) -> DataFrame:
    return (_ip(df).where(F.col("mqtt_message_value").isNotNull())
                   .groupBy("general_ip", "mqtt_message_value").agg(F.count(F.lit(1)).alias("count"))
                   .where(F.col("count") > min_count))


def empty_payloads(df: DataFrame) -> DataFrame:
    """Null or empty payloads per IP (IPs with at least one)."""
    empty = F.col("mqtt_message_value").isNull() | (F.col("mqtt_message_value") == "")
    return (_ip(df).groupBy("general_ip").agg(F.count(F.when(empty, 1)).alias("empty_payloads"),
                                              F.count(F.lit(1)).alias("messages"))
                   .where(F.col("empty_payloads") > 0))


def qos2_abuse(df: DataFrame, threshold: float = QOS2_SHARE) -> DataFrame:
    n2 = F.count(F.when(F.col("mqtt_qos") == 2, 1))
    share = ratio(n2, F.count(F.lit(1)))
    return df.agg(n2.alias("qos2_messages"), share.alias("qos2_share"), (share > F.lit(threshold)).alias("qos2_abuse"))


def qos_by_ip(df: DataFrame, threshold: float = QOS_MEAN) -> DataFrame:
    return (_ip(df).groupBy("general_ip").agg(F.avg(F.col("mqtt_qos").cast("double")).alias("avg_qos"))
                   .where(F.col("avg_qos") > threshold))


def qos_volume_mix(df: DataFrame, qos_threshold: float = QOS_MEAN, volume: int = HIGH_VOLUME) -> DataFrame:
    """IPs that send many messages and use a high mean QoS (costly at the broker)."""
    return (_ip(df).groupBy("general_ip").agg(F.avg(F.col("mqtt_qos").cast("double")).alias("avg_qos"),
                                              F.count(F.lit(1)).alias("messages"))
                   .where((F.col("avg_qos") > qos_threshold) & (F.col("messages") > volume)))
