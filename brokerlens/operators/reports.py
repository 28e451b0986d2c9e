"""Time, network, protocol and class-conditional reports (one action each)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.functions.scalar import message_length, pct, ratio
from brokerlens.operators.basic import class_counts, histogram, materialize, value_counts
from brokerlens.operators.quantiles import wide_quantiles

HOURS = list(range(24))


# ---- time ------------------------------------------------------------------
def messages_by_hour(df: DataFrame) -> DataFrame:
    return df.where(F.col("hour").isNotNull()).groupBy("hour").agg(F.count(F.lit(1)).alias("count"))


def messages_by_weekday(df: DataFrame) -> DataFrame:
    """Counts per day name; ``day_of_week`` (Monday = 0) gives the week order."""
    return (df.where(F.col("day_of_week").isNotNull())
              .groupBy("day_of_week", "day_name").agg(F.count(F.lit(1)).alias("count")))


def daily_timeline(df: DataFrame, ts: str = "ts") -> DataFrame:
    return (df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("date"))
              .agg(F.count(F.lit(1)).alias("count")))


def weekday_hour_heatmap(df: DataFrame) -> DataFrame:
    """Weekday x hour message counts, wide (``h0`` .. ``h23``), 0 filled.

    The pivot values are fixed (0..23), so Spark does not run a job to
    discover them."""
    piv = (df.where(F.col("day_of_week").isNotNull())
             .groupBy("day_of_week", "day_name").pivot("hour", HOURS).count())
    return piv.select("day_of_week", "day_name",
                      *[F.coalesce(F.col(str(h)), F.lit(0).cast("long")).alias(f"h{h}") for h in HOURS])


def time_span(df: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last message and the whole days between them."""
    return (df.agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
              .withColumn("span_days", F.floor((F.unix_micros("last_seen") - F.unix_micros("first_seen"))
                                               / F.lit(86_400_000_000))))


# ---- network ---------------------------------------------------------------
def network_cardinality(df: DataFrame, exact: bool = True) -> DataFrame:
    """Distinct IPs, MACs and devices.  ``exact=False`` uses HyperLogLog++
    (one pass, no distinct shuffle) for very large tables."""
    cd = F.countDistinct if exact else F.approx_count_distinct
    return df.agg(cd("general_ip").alias("n_ips"), cd("general_mac").alias("n_macs"),
                  cd("general_device_name").alias("n_devices"))


def requests_per_ip_hist(df: DataFrame, bins: int = 30) -> DataFrame:
    per_ip = value_counts(df, "general_ip", count_name="messages")
    return histogram(per_ip, "messages", bins)


def ip_activity_summary(df: DataFrame) -> DataFrame:
    """Mean messages per IP; the most active IP (ties: smallest IP) and its count."""
    per_ip = (df.where(F.col("general_ip").isNotNull()).groupBy("general_ip")
                .agg(F.count(F.lit(1)).alias("messages")))
    top = F.min_by(F.struct(F.col("general_ip"), F.col("messages")),
                   F.struct(-F.col("messages"), F.col("general_ip")))
    return (per_ip.agg(F.avg("messages").alias("mean_messages_per_ip"), top.alias("t"))
                  .select("mean_messages_per_ip", F.col("t.general_ip").alias("top_ip"),
                          F.col("t.messages").alias("top_ip_messages")))


# ---- protocol --------------------------------------------------------------
def mqtt_cardinality(df: DataFrame) -> DataFrame:
    """Distinct topics and message types, with the sorted list of types
    (the list is bounded by the handful of MQTT control packet types)."""
    return df.agg(F.countDistinct("mqtt_topic").alias("n_topics"),
                  F.countDistinct("mqtt_message_type").alias("n_message_types"),
                  F.array_sort(F.collect_set("mqtt_message_type")).alias("message_types"))


def flag_rates(df: DataFrame) -> DataFrame:
    """Percent of all rows with the DUP flag and with the retained flag."""
    n = F.count(F.lit(1))
    return df.agg(pct(F.sum(F.col("mqtt_duplicate").cast("long")), n).alias("duplicate_rate_pct"),
                  pct(F.sum(F.col("mqtt_retained").cast("long")), n).alias("retained_rate_pct"))


def message_length_stats(df: DataFrame, col: str = "mqtt_message_value") -> DataFrame:
    ln = message_length(col)
    return df.agg(F.avg(ln).alias("mean_length"), F.median(ln).alias("median_length"),
                  F.max(ln).alias("max_length"),
                  F.count(F.when(F.col(col).isNull(), 1)).alias("null_payloads"))


def message_length_hist(df: DataFrame, bins: int = 50, col: str = "mqtt_message_value") -> DataFrame:
    return histogram(df.select(message_length(col).alias("message_length")), "message_length", bins)


def message_presence(df: DataFrame, col: str = "mqtt_message_value") -> DataFrame:
    n = F.count(F.lit(1))
    with_msg = F.count(F.when(F.col(col).isNotNull(), 1))
    without = F.count(F.when(F.col(col).isNull(), 1))
    return df.agg(with_msg.alias("with_payload"), without.alias("without_payload"),
                  pct(with_msg, n).alias("with_payload_pct"), pct(without, n).alias("without_payload_pct"))


def top_duplicate_ips(df: DataFrame, n: int = 10) -> DataFrame:
    per_ip = (df.where(F.col("general_ip").isNotNull()).groupBy("general_ip")
                .agg(F.avg(F.col("mqtt_duplicate").cast("double")).alias("duplicate_rate")))
    return per_ip.orderBy(F.desc_nulls_last("duplicate_rate"), F.asc("general_ip")).limit(n)


# ---- class-conditional -----------------------------------------------------
def crosstab_count(df: DataFrame, cat: str, label: str = "is_ddos") -> DataFrame:
    return class_counts(df.where(F.col(cat).isNotNull()), [cat], label)


def crosstab_percent(df: DataFrame, cat: str, label: str = "is_ddos") -> DataFrame:
    c = crosstab_count(df, cat, label)
    tot = F.col("normal") + F.col("ddos")
    return c.select(cat, ratio(F.col("normal") * F.lit(100.0), tot).alias("normal_pct"),
                    ratio(F.col("ddos") * F.lit(100.0), tot).alias("ddos_pct"))


def hourly_by_class(df: DataFrame, label: str = "is_ddos") -> DataFrame:
    return class_counts(df.where(F.col("hour").isNotNull()), ["hour"], label)


def weekday_by_class(df: DataFrame, label: str = "is_ddos") -> DataFrame:
    return class_counts(df.where(F.col("day_of_week").isNotNull()), ["day_of_week", "day_name"], label)


def attack_duration(df: DataFrame, label: str = "is_ddos", ts: str = "ts") -> DataFrame:
    """Per attacking IP: first and last attack message and the duration."""
    secs = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / F.lit(1e6)
    return (df.where((F.col(label) == 1) & F.col("general_ip").isNotNull())
              .groupBy("general_ip").agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))
              .select("general_ip", "first_seen", "last_seen", secs.alias("duration_s"),
                      (secs / F.lit(60.0)).alias("duration_min"), (secs / F.lit(3600.0)).alias("duration_h")))


def _duration_long(dur: DataFrame) -> DataFrame:
    return dur.select("general_ip", F.explode(F.array(
        F.struct(F.lit("s").alias("unit"), F.col("duration_s").alias("duration")),
        F.struct(F.lit("min").alias("unit"), F.col("duration_min").alias("duration")),
        F.struct(F.lit("h").alias("unit"), F.col("duration_h").alias("duration")))).alias("d")
    ).select("general_ip", "d.unit", "d.duration")


def attack_duration_summary(df: DataFrame, label: str = "is_ddos") -> DataFrame:
    """Mean, median, min, max attack duration in seconds, minutes, hours; no rows without an attacker."""
    dur = materialize(attack_duration(df, label))      # one row per attacker
    units = {"s": "duration_s", "min": "duration_min", "h": "duration_h"}
    median = wide_quantiles(dur, list(units.values()), [0.5])
    rows = F.array(*[F.struct(F.lit(u).alias("unit"), F.avg(c).alias("mean"), F.lit(median[c][0]).cast("double").alias("median"),
                              F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n_ips")) for u, c in units.items()])
    return dur.agg(rows.alias("r")).select(F.explode("r").alias("r")).select("r.*").where("n_ips > 0")


def attack_duration_hist(df: DataFrame, bins: int = 50, label: str = "is_ddos") -> DataFrame:
    return histogram(_duration_long(attack_duration(df, label)), "duration", bins, by=["unit"])
