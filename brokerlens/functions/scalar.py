"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(num, den) -> Column:
    """``num / den`` as a double; null when ``den`` is 0 or null (ANSI-safe)."""
    return F.try_divide(F.col(num).cast("double") if isinstance(num, str) else num.cast("double"),
                        F.col(den).cast("double") if isinstance(den, str) else den.cast("double"))


def pct(num, den) -> Column:
    """Percentage ``100 * num / den`` (double), null on a zero denominator."""
    return ratio(num, den) * F.lit(100.0)


def message_length(col: str = "mqtt_message_value") -> Column:
    """Payload length in characters; a null payload stays null."""
    return F.length(F.col(col))


def has_message(col: str = "mqtt_message_value") -> Column:
    return F.col(col).isNotNull()


def class_name(label: str = "is_ddos") -> Column:
    return F.when(F.col(label) == 1, F.lit("DDoS")).when(F.col(label) == 0, F.lit("Normal"))


def bin_index(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width bin 1..n over [lo, hi]; the last bin is closed.

    When ``lo == hi`` the range is widened to [lo - .5, hi + .5], as numpy
    does, so the single value lands in the middle bin.
    """
    same = lo == hi
    lo2 = F.when(same, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(same, hi + F.lit(0.5)).otherwise(hi)
    return F.least(F.width_bucket(x.cast("double"), lo2.cast("double"), hi2.cast("double"),
                                  F.lit(n).cast("long")), F.lit(n).cast("long"))


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    """Round every double column (used only to present oracle comparisons)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, places).alias(f.name)
        cols.append(c)
    return df.select(*cols)
