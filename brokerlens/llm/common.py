"""Helpers shared by the training-data operators: scratch tables in the
shared folder, word counts, and the documents reader."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brokerlens.session import ensure_checkpoint_dir

# fixed values: the white space of the word pattern [^\x20\x09-\x0D]+
WORD_SPACE = " \t\n\x0b\x0c\r"
WORD_SPACE_RE = r"[\x20\x09-\x0D]+"


ARROW_BYTES = "8m"


def batches_by_bytes(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_BYTES``: documents differ too much in length to count rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


class Scratch:
    """Tables written under the shared checkpoint folder and read back.

    Writing cuts the lineage (a lost executor re-runs one stage, not the
    whole plan) and gives every later branch the same rows.  ``drop``
    frees a table that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        batches_by_bytes(spark)
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.bases.append(self.base)

    bases: list[str] = []

    def table(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """``df`` written and read back; ``by`` names a column whose values get folders of their own."""
        path = f"{self.base}/{self.n}"
        self.n += 1
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(conf).delete(p, True)


def release_scratch(spark: SparkSession) -> None:
    """Delete every scratch folder written so far, once the results that read them are done with."""
    conf = spark._jsc.hadoopConfiguration()
    while Scratch.bases:
        p = spark._jvm.org.apache.hadoop.fs.Path(Scratch.bases.pop())
        p.getFileSystem(conf).delete(p, True)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` (null: 0)."""
    trimmed = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(
        F.size(F.split(trimmed, WORD_SPACE_RE))).cast("long")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
