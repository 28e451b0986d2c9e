"""Timestamp parsing and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_timestamp(col: str = "@timestamp") -> Column:
    """ISO-8601 text to timestamp; unreadable text becomes null."""
    return F.try_to_timestamp(F.col(f"`{col}`"))


def parse_timestamp_strict(col: str = "@timestamp") -> Column:
    """Same, but unreadable text fails the query (ANSI mode)."""
    return F.to_timestamp(F.col(f"`{col}`"))


def calendar_date(col: str = "ts") -> Column:
    return F.to_date(F.col(col))


def temporal_features(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Add hour (0-23), day_of_week (Monday = 0), day, month and day_name."""
    ts = F.col(ts_col)
    return df.select("*",
                     F.hour(ts).alias("hour"),
                     F.weekday(ts).alias("day_of_week"),
                     F.dayofmonth(ts).alias("day"),
                     F.month(ts).alias("month"),
                     F.date_format(ts, "EEEE").alias("day_name"))


def expand_datetime(df: DataFrame) -> DataFrame:
    """Every timestamp/date column -> _year, _month, _day, _hour, _dayofweek; source dropped."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out += [F.year(c).alias(f"{f.name}_year"), F.month(c).alias(f"{f.name}_month"),
                    F.dayofmonth(c).alias(f"{f.name}_day"), F.hour(c).alias(f"{f.name}_hour"),
                    F.weekday(c).alias(f"{f.name}_dayofweek")]
        else:
            out.append(c)
    return df.select(*out)
