"""Column selection and cleaning.

Column-level decisions (too many nulls, constant) come from one aggregate
pass that yields a small decision table; the drop itself is a projection.
Fitted statistics (medians) are one small row -- the "model" of the fit --
applied as literals, as MLlib's Imputer does.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.operators.profile import _long, null_counts
from brokerlens.sources.schema import NUMERIC_TYPES

# Fixed values of the reference
EXCLUDED = ["is_ddos", "@timestamp", "timestamp_parsed", "general_ip", "general_mac", "general_full_id",
            "general_device_name", "mqtt_message_value", "mqtt_topic"]
MODEL_FEATURES = ["mqtt_qos", "mqtt_duplicate", "mqtt_retained", "requests_per_ip", "duplicate_rate_per_ip",
                  "unique_topics_per_ip", "hour", "day_of_week", "day", "month"]
MAX_NULLS = 50
MISSING = "MISSING"


def q(c: str):
    return F.col(f"`{c}`")


def select_available(df: DataFrame, wanted) -> DataFrame:
    have = set(df.columns)
    return df.select(*[q(c) for c in wanted if c in have])


def drop_excluded(df: DataFrame, excluded=EXCLUDED) -> DataFrame:
    return df.drop(*[c for c in excluded if c in df.columns])


def filter_class(df: DataFrame, value: int, label: str = "is_ddos") -> DataFrame:
    return df.where(F.col(label) == value)


def sparse_columns(df: DataFrame, max_nulls: int = MAX_NULLS) -> DataFrame:
    """(column, nulls, drop): drop when a column has MORE than ``max_nulls``
    nulls (an absolute count, as the reference)."""
    return null_counts(df).select("column", "nulls", (F.col("nulls") > max_nulls).alias("drop"))


def drop_sparse_columns(df: DataFrame, max_nulls: int = MAX_NULLS) -> DataFrame:
    drop = [r["column"] for r in sparse_columns(df, max_nulls).where("drop").collect()]
    return df.drop(*drop)


def constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, constant): a column is constant when it has at most one
    distinct non-null value; ``min = max`` decides it in one pass, which
    is cheaper than counting distinct values."""
    cols = cols or df.columns
    items = [F.struct(F.lit(c).alias("column"),
                      F.coalesce(F.min(q(c)) == F.max(q(c)), F.lit(True)).alias("constant")) for c in cols]
    return _long(df, items)


def drop_constant_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    drop = [r["column"] for r in constant_columns(df, cols).where("constant").collect()]
    return df.drop(*drop)


def fill_missing_category(df: DataFrame, cols: list[str] | None = None, token: str = MISSING) -> DataFrame:
    """Null -> 'MISSING' in string columns (booleans are encoded separately)."""
    cols = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    s = set(cols)
    return df.select(*[F.coalesce(q(c), F.lit(token)).alias(c) if c in s else q(c) for c in df.columns])


def replace_infinite(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """+-inf and NaN -> null in floating columns (before any median is taken)."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    s = set(cols or fl) & set(fl)
    gone = [float("inf"), float("-inf"), float("nan")]
    return df.select(*[F.when(q(c).isin(gone), F.lit(None).cast("double")).otherwise(q(c)).alias(c)
                       if c in s else q(c) for c in df.columns])


def count_infinite(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cols = [c for c in (cols or fl) if c in fl]
    terms = [F.count(F.when(F.abs(q(c)) == F.lit(float("inf")), 1)) for c in cols]
    total = sum(terms[1:], terms[0]) if terms else F.lit(0).cast("long")
    return df.agg(total.alias("n_infinite"))


def fit_medians(df: DataFrame, cols: list[str]) -> dict:
    """Exact median per column (nulls skipped), all columns side by side."""
    from brokerlens.operators.quantiles import wide_quantiles
    return {c: v[0] for c, v in wide_quantiles(df, cols, [0.5]).items()}


def impute_median(df: DataFrame, medians: dict) -> DataFrame:
    """Null -> the fitted median; imputed columns become double."""
    return df.select(*[F.coalesce(q(c).cast("double"), F.lit(medians[c])).alias(c)
                       if c in medians and medians[c] is not None and not math.isnan(medians[c]) else q(c)
                       for c in df.columns])


def clean_numeric(train: DataFrame, cols: list[str], others: list[DataFrame] = ()):
    """inf -> null, then null -> median fitted on ``train``; applied to
    ``train`` and every frame in ``others``."""
    t = replace_infinite(train, cols)
    med = fit_medians(t, cols)
    return [impute_median(t, med)] + [impute_median(replace_infinite(o, cols), med) for o in others]


def align_columns(test: DataFrame, train_columns: list[str]) -> DataFrame:
    """The test frame gets the train frame's columns in its order; absent
    ones are 0, extra ones dropped."""
    have = set(test.columns)
    return test.select(*[q(c) if c in have else F.lit(0).alias(c) for c in train_columns])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]
