"""Readers for the message table."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.sources.schema import MESSAGE_SCHEMA


def read_messages(spark: SparkSession, path: str, fmt: str = "csv",
                  schema: T.StructType = MESSAGE_SCHEMA,
                  keep_corrupt: bool = False, multiline: bool = False) -> DataFrame:
    """Load messages with an explicit schema (no inference pass over the data); NaN becomes null.

    CSV columns are found by the name in the header, in whatever order they
    come; columns that the file does not have are null, others are left out.
    All files of a path must have the header of the first (else the read
    fails).  CSV is read PERMISSIVE: a malformed field becomes null; with
    ``keep_corrupt`` the raw line is kept in ``_corrupt_record``.  With
    ``multiline`` a quoted value may hold line breaks; a file is then read
    by one task, however large it is.
    """
    if fmt == "csv":
        return nan_to_null(_read_csv(spark, path, schema, keep_corrupt, multiline))
    if fmt == "parquet":
        return nan_to_null(spark.read.parquet(path))
    if fmt == "json":
        return nan_to_null(spark.read.schema(schema).json(path))
    raise ValueError(f"unknown format {fmt}")


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, keep_corrupt: bool, multiline: bool) -> DataFrame:
    options = {"header": True, "mode": "PERMISSIVE", "escape": '"', "multiLine": multiline}
    header = spark.read.options(**options).csv(path).columns     # reads the first line only
    typed = {f.name: f for f in schema.fields}
    fields = [typed.get(c, T.StructField(c, T.StringType())) for c in header]
    wanted = list(schema.fields)
    if keep_corrupt:
        extra = T.StructField("_corrupt_record", T.StringType())
        fields, wanted = fields + [extra], wanted + [extra]
        options["columnNameOfCorruptRecord"] = "_corrupt_record"
    got = spark.read.schema(T.StructType(fields)).options(**options, enforceSchema=False).csv(path)
    have = {f.name for f in fields}
    return got.select(*[F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted])


def cached_messages(df: DataFrame) -> DataFrame:
    """Memoised load: keep the table for several reports (spills to disk)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null, the one missing value pandas knows.

    Spark's ``avg``/``median`` return NaN if any input is NaN; pandas skips
    it.  Applied at ingest so every later aggregate skips it.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.nanvl(c, F.lit(None).cast(f.dataType)).alias(f.name)
        cols.append(c)
    return df.select(*cols)
