"""The message table: one row per MQTT message seen at the broker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType([
    T.StructField("@timestamp", T.StringType()),
    T.StructField("general_ip", T.StringType()),
    T.StructField("general_mac", T.StringType()),
    T.StructField("general_device_name", T.StringType()),
    T.StructField("general_full_id", T.StringType()),
    T.StructField("mqtt_topic", T.StringType()),
    T.StructField("mqtt_message_type", T.StringType()),
    T.StructField("mqtt_message_value", T.StringType()),
    T.StructField("mqtt_message_id", T.LongType()),
    T.StructField("mqtt_qos", T.IntegerType()),
    T.StructField("mqtt_duplicate", T.BooleanType()),
    T.StructField("mqtt_retained", T.BooleanType()),
])

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)


def available_columns(df: DataFrame, wanted) -> list[str]:
    """Requested columns that exist, in the requested order (``select_available``)."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def require_columns(df: DataFrame, wanted) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def columns_by_type(df: DataFrame, timestamp_like=("@timestamp", "timestamp_parsed", "ts")):
    """Numeric and categorical column names from the schema.

    Numeric: integral and floating types.  Categorical: strings and
    booleans, minus the timestamp columns.
    """
    numeric, categorical = [], []
    for f in df.schema.fields:
        if isinstance(f.dataType, NUMERIC_TYPES):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)) and f.name not in timestamp_like:
            categorical.append(f.name)
    return numeric, categorical
