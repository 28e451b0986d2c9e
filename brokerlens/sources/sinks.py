"""Sinks: selected features, feature lists and the feature catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the reference: declared feature groups, in order.
FEATURE_GROUPS = [
    ("numeric", ["mqtt_qos", "mqtt_duplicate", "mqtt_retained", "requests_per_ip", "duplicate_rate_per_ip",
                 "unique_topics_per_ip"]),
    ("temporal", ["hour", "day_of_week", "day", "month"]),
    ("encoded_categorical", ["general_device_name_encoded", "mqtt_topic_encoded", "general_mac_encoded"]),
    ("ip_aggregation", ["requests_per_ip", "duplicate_rate_per_ip", "unique_topics_per_ip", "avg_qos_per_ip",
                        "retained_rate_per_ip"]),
]


def write_selected_features(df: DataFrame, features: list[str], path: str, label: str = "is_ddos",
                            fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Selected features and the label, without any index column."""
    w = df.select(*features, label).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def write_feature_list(spark: SparkSession, features: list[str], path: str) -> None:
    """One feature name per line (a single small text file)."""
    spark.createDataFrame([(f,) for f in features], "feature string").coalesce(1).write.mode("overwrite").text(path)


def feature_catalog(df: DataFrame, groups=FEATURE_GROUPS) -> DataFrame:
    """(feature, group, available, non_null): the declared features, each
    under the first group naming it, with its presence in ``df`` and, when
    present, its non-null count (one aggregate pass)."""
    seen, rows = set(), []
    for g, feats in groups:
        for f in feats:
            if f not in seen:
                seen.add(f)
                rows.append((f, g, f in df.columns))
    present = [f for f, _, a in rows if a]
    counts = df.agg(*[F.count(F.col(f)).alias(f) for f in present]) if present else None
    items = [F.struct(F.lit(f).alias("feature"), F.lit(g).alias("group"), F.lit(a).alias("available"),
                      (F.col(f) if a else F.lit(None).cast("long")).alias("non_null")) for f, g, a in rows]
    if counts is None:
        return df.sparkSession.createDataFrame([(f, g, a, None) for f, g, a in rows],
                                               "feature string, group string, available boolean, non_null bigint")
    return counts.select(F.explode(F.array(*items)).alias("r")).select("r.*")


def export_catalog(catalog: DataFrame, path: str) -> None:
    catalog.coalesce(1).write.mode("overwrite").json(path)
