"""Distinct values of many columns in one pass.

A count of distinct values per column, asked of Spark column by column, copies
every row once per column.  Here each task looks at its rows column by column and passes
on only what it has not passed on yet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD = 100_000       # values of a column that a task remembers; then it may pass one on again


def _text(df: DataFrame, c: str) -> Column:
    """The value as text, equal for equal values."""
    x = F.col(f"`{c}`")
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        x = x + F.lit(0.0).cast(df.schema[c].dataType)          # 0.0 and -0.0 are equal
    return x.cast("string")


def _values(df: DataFrame, cols: list[str], most: int | None) -> DataFrame:
    """(col, value): every distinct non-null value of each column once per task or more; with ``most`` only the first so many of a task."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        seen: list[set] = [set() for _ in cols]
        for batch in batches:
            for k, column in enumerate(batch.columns):
                if most is not None and len(seen[k]) >= most:
                    continue
                new = [v for v in pc.unique(column).to_pylist() if v is not None and v not in seen[k]]
                if most is not None:
                    new = new[:most - len(seen[k])]
                elif len(seen[k]) > HELD:
                    seen[k].clear()
                if new:
                    seen[k].update(new)
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(new), pa.int32()), pa.array(new, pa.string())], names=["col", "value"])

    return df.select(*[_text(df, c).alias(f"x{k}") for k, c in enumerate(cols)]).mapInArrow(run, "col int, value string")


def _named(counts: DataFrame, cols: list[str]) -> DataFrame:
    names = counts.sparkSession.createDataFrame(list(enumerate(cols)), "col int, column string")
    return names.join(counts, "col", "left").select("column", F.coalesce("nunique", F.lit(0)).cast("long").alias("nunique"))


def distinct_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, nunique): the number of distinct non-null values of each column, exact."""
    cols = cols or df.columns
    once = _values(df, cols, None).distinct()
    return _named(once.groupBy("col").agg(F.count(F.lit(1)).alias("nunique")), cols)


def bounded_cardinality(df: DataFrame, cols: list[str] | None = None, limit: int = 20) -> DataFrame:
    """(column, nunique, more): the number of distinct non-null values, exact up to ``limit``; ``more`` and limit + 1 beyond.

    A task passes on at most limit + 1 values of a column, so that the state does not grow with the rows."""
    cols = cols or df.columns
    once = _values(df, cols, limit + 1).distinct()
    counts = once.groupBy("col").agg(F.least(F.count(F.lit(1)), F.lit(limit + 1)).alias("nunique"))
    return _named(counts, cols).withColumn("more", F.col("nunique") > limit)
