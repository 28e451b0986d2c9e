"""Per-source-IP behaviour features and the threshold DDoS label.

One aggregate per IP, joined back to the messages (the pandas
``groupby().transform`` of the reference).  Skew note: an attacking IP can
own a large share of all rows.  The aggregate has a map-side partial
stage, and its single distinct column (topic) is planned as a
(ip, topic) pre-aggregate, so a hot IP is spread over tasks by topic
before the final per-IP merge.  The join back is planned by AQE: the
per-IP side becomes a broadcast when its measured size is small,
otherwise a sort-merge join whose skewed partitions AQE splits
(``basic.split_join`` gives the per-IP side the exchange that needs).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.functions.scalar import ratio
from brokerlens.operators.basic import split_join

IP_FEATURES = ["requests_per_ip", "duplicate_rate_per_ip", "unique_topics_per_ip",
               "avg_qos_per_ip", "retained_rate_per_ip"]


@dataclass(frozen=True)
class LabelThresholds:
    """``is_ddos = requests > r AND (duplicate rate > d OR topics < t)``.

    Fixed values of the reference: 200 requests, 0.3 duplicate rate, 5 topics.
    """
    requests: float = 200
    duplicate_rate: float = 0.3
    topics: float = 5


FIXTURE_THRESHOLDS = LabelThresholds(66, 0.25, 33)


def per_ip_stats(df: DataFrame, ip: str = "general_ip") -> DataFrame:
    """One row per non-null IP with the five behaviour features.

    A null IP forms no group (pandas drops null keys)."""
    return (df.where(F.col(ip).isNotNull())
              .groupBy(ip)
              .agg(F.count(F.lit(1)).alias("requests_per_ip"),
                   F.avg(F.col("mqtt_duplicate").cast("double")).alias("duplicate_rate_per_ip"),
                   F.countDistinct("mqtt_topic").alias("unique_topics_per_ip"),
                   F.avg(F.col("mqtt_qos").cast("double")).alias("avg_qos_per_ip"),
                   F.avg(F.col("mqtt_retained").cast("double")).alias("retained_rate_per_ip")))


def with_ip_features(df: DataFrame, ip: str = "general_ip",
                     features: list[str] | None = None) -> DataFrame:
    """Attach per-IP features to every message (null IP -> null features)."""
    stats = per_ip_stats(df, ip)
    features = features or IP_FEATURES
    stats = stats.select(ip, *features)
    return split_join(df, stats, ip, "left").select(*[F.col(f"`{c}`") for c in df.columns], *features)


def ddos_condition(t: LabelThresholds = LabelThresholds()):
    cond = (F.col("requests_per_ip") > F.lit(t.requests)) & (
        (F.col("duplicate_rate_per_ip") > F.lit(t.duplicate_rate))
        | (F.col("unique_topics_per_ip") < F.lit(t.topics)))
    return F.coalesce(cond, F.lit(False))


def label_ddos(df: DataFrame, t: LabelThresholds = LabelThresholds()) -> DataFrame:
    """Add ``is_ddos`` (int 0/1) from the joined per-IP features.

    Strict inequalities; a row whose features are null (null IP) is 0."""
    return df.withColumn("is_ddos", ddos_condition(t).cast("int"))


def attacking_ips(df: DataFrame, ip: str = "general_ip",
                  t: LabelThresholds = LabelThresholds()) -> DataFrame:
    """The IPs the rule labels DDoS, with their features (no join back)."""
    return per_ip_stats(df, ip).where(ddos_condition(t))


def label_distribution(df: DataFrame, label: str = "is_ddos") -> DataFrame:
    """Count and percent of rows per class."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
              .withColumn("percent", ratio(F.col("count"), total) * F.lit(100.0)))


def imbalance_ratio(df: DataFrame, label: str = "is_ddos",
                    extreme: float = 5.0, moderate: float = 2.0) -> DataFrame:
    """normal / ddos ratio with its band; the ratio is null with one class."""
    counts = df.agg(F.count(F.when(F.col(label) == 0, 1)).alias("n_normal"),
                    F.count(F.when(F.col(label) == 1, 1)).alias("n_ddos"))
    r = ratio(F.col("n_normal"), F.col("n_ddos"))
    return counts.select("n_normal", "n_ddos", r.alias("imbalance_ratio"),
                         F.when(r > extreme, "extreme")
                          .when(r > moderate, "resample")
                          .when(r.isNotNull(), "balanced").alias("imbalance_band"))


def suspicion_score(df: DataFrame, top_n: int = 20, k: int = 10, ip: str = "general_ip") -> DataFrame:
    """Score the ``top_n`` busiest IPs and keep the ``k`` most suspicious.

    request_count = non-null message ids, duplicate_rate = mean DUP flag,
    unique_topics = distinct topics, suspicion_score =
    (request_count / max(request_count) + duplicate_rate) / 2.

    One scan and one grouped aggregate over all IPs; the busiest IPs are
    chosen from that aggregate (ties by IP), so no second scan or join
    is needed.  Only ``top_n`` rows reach the final scoring window.
    """
    per_ip = (df.where(F.col(ip).isNotNull()).groupBy(ip)
                .agg(F.count(F.lit(1)).alias("messages"),
                     F.count("mqtt_message_id").alias("request_count"),
                     F.avg(F.col("mqtt_duplicate").cast("double")).alias("duplicate_rate"),
                     F.countDistinct("mqtt_topic").alias("unique_topics")))
    busiest = per_ip.orderBy(F.desc("messages"), F.asc(ip)).limit(top_n)
    # window over at most top_n rows
    from pyspark.sql import Window
    w = Window.partitionBy()
    scored = busiest.withColumn(
        "suspicion_score",
        (ratio(F.col("request_count"), F.max("request_count").over(w)) + F.col("duplicate_rate")) / F.lit(2.0))
    return (scored.orderBy(F.desc("suspicion_score"), F.asc(ip)).limit(k)
                  .select(ip, "request_count", "duplicate_rate", "unique_topics", "suspicion_score"))
