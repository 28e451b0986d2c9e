"""Daily per-IP state that adds up to the per-IP features.

Counts and sums per (day, IP), and the topics per (day, IP) as rows, are written in one folder a
day.  A new day writes its own folders only; the features of any span of days are sums
over small tables instead of an aggregate over all messages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlens.functions.scalar import ratio

COUNTS = ["messages", "duplicates", "with_duplicate", "qos", "with_qos", "retained", "with_retained"]
NO_DAY = "none"      # folder of messages without a time


def daily_counts(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """(general_ip, messages, sums and counts of the flags, day) of messages with an IP."""
    def total(c):
        return F.sum(F.col(c).cast("double")), F.count(c)
    dup, n_dup = total("mqtt_duplicate")
    qos, n_qos = total("mqtt_qos")
    ret, n_ret = total("mqtt_retained")
    return with_day(messages, ts).groupBy("general_ip", "day").agg(
        F.count(F.lit(1)).alias("messages"), dup.alias("duplicates"), n_dup.alias("with_duplicate"), qos.alias("qos"),
        n_qos.alias("with_qos"), ret.alias("retained"), n_ret.alias("with_retained"))


def daily_topics(messages: DataFrame, ts: str = "ts") -> DataFrame:
    """(general_ip, mqtt_topic, day), once each."""
    return with_day(messages, ts).where("mqtt_topic IS NOT NULL").select("general_ip", "mqtt_topic", "day").distinct()


def with_day(messages: DataFrame, ts: str) -> DataFrame:
    day = F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(NO_DAY))
    return messages.where("general_ip IS NOT NULL").withColumn("day", day)


def write_days(messages: DataFrame, base: str, ts: str = "ts") -> None:
    """Write (or write anew) the state of the days that ``messages`` hold; other days' folders are not touched.

    ``messages`` must hold a day whole."""
    for name, rows in (("counts", daily_counts(messages, ts)), ("topics", daily_topics(messages, ts))):
        rows.write.partitionBy("day").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{base.rstrip('/')}/{name}")


def roll_up(spark: SparkSession, base: str, days: tuple[str, str] | None = None) -> DataFrame:
    """The per-IP features of ``ip_features.per_ip_stats`` from the state, of all days or of ``days`` (first, last)."""
    base = base.rstrip("/")
    counts = spark.read.schema("general_ip string, messages long, duplicates double, with_duplicate long, qos double, with_qos long, "
                               "retained double, with_retained long, day string").parquet(f"{base}/counts")
    topics = spark.read.schema("general_ip string, mqtt_topic string, day string").parquet(f"{base}/topics")
    if days is not None:
        counts, topics = (t.where(F.col("day").between(*days)) for t in (counts, topics))
    per_ip = counts.groupBy("general_ip").agg(*[F.sum(c).alias(c) for c in COUNTS])
    n_topics = topics.select("general_ip", "mqtt_topic").distinct().groupBy("general_ip").agg(F.count(F.lit(1)).alias("n"))
    rate = lambda a, b: ratio(F.col(a), F.col(b))
    return per_ip.join(n_topics, "general_ip", "left").select(
        "general_ip", F.col("messages").alias("requests_per_ip"), rate("duplicates", "with_duplicate").alias("duplicate_rate_per_ip"),
        F.coalesce("n", F.lit(0).cast("long")).alias("unique_topics_per_ip"), rate("qos", "with_qos").alias("avg_qos_per_ip"),
        rate("retained", "with_retained").alias("retained_rate_per_ip"))


def release(spark: SparkSession, base: str) -> None:
    """Delete a state that is no longer needed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(base)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
