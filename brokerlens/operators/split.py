"""Train / test splits and fold columns.

A row's part in a random split is a pure function of its key columns and
the seed (``xxhash64``), so the split is repeatable, needs no shuffle or
sort, and survives task retries.  Stratified splits and folds have exact
per-class sizes: a row's rank within its class, by the same hash, is its rank
within a hash cell plus the rows of the earlier cells.  Cells are as many as it takes for
``CELL_ROWS`` rows each, so that a cell, which one task sorts, does not grow with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["mqtt_message_id", "ts", "general_ip", "mqtt_topic"]
BUCKETS = 10000
CELL_ROWS = 100_000


def _hash_bucket(df: DataFrame, keys, seed: int, buckets: int = BUCKETS):
    cols = [F.col(f"`{k}`") for k in keys if k in df.columns] or [F.struct(*[F.col(f"`{c}`") for c in df.columns])]
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(buckets))


def with_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, keys=KEY, name: str = "split") -> DataFrame:
    b = _hash_bucket(df, keys, seed)
    return df.withColumn(name, F.when(b < F.lit(int(round(test_size * BUCKETS))), "test").otherwise("train"))


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, keys=KEY, exact: bool = False):
    """(train, test) by a seeded hash of the keys; with ``exact`` the test part has ceil(n * test_size) rows."""
    if exact:
        ranked = with_class_rank(df.withColumn("_one", F.lit(1)), "_one", seed, keys)
        in_test = F.col("_rank") < F.ceil(F.col("_size") * F.lit(test_size))
        return ranked.where(~in_test).select(*df.columns), ranked.where(in_test).select(*df.columns)
    s = with_split(df, test_size, seed, keys, "_split")
    return (s.where(F.col("_split") == "train").drop("_split"), s.where(F.col("_split") == "test").drop("_split"))


def cell_bits(rows: int) -> int:
    """Leading bits of a row's hash that name its cell: 12 at least, one more for every doubling beyond."""
    return min(40, max(12, (max(1, rows) // CELL_ROWS).bit_length()))


def with_class_rank(df: DataFrame, label: str, seed: int, keys=KEY) -> DataFrame:
    """Add ``_rank``, from 0, and ``_size`` of the row's class, in the order of a seeded hash of
    the keys (ties by all columns).  A null label is a class of its own."""
    cols = [F.col(f"`{k}`") for k in keys if k in df.columns]
    every = [F.col(f"`{c}`") for c in df.columns]
    d = df.select("*", F.coalesce(F.col(f"`{label}`").cast("string"), F.lit("null")).alias("_class"),
                  F.xxhash64(F.lit(seed), *(cols or every)).alias("_hash"), F.xxhash64(*every).alias("_tie"))
    bits = cell_bits(df.count())
    d = d.withColumn("_cell", F.shiftrightunsigned("_hash", 64 - bits))
    counts = d.groupBy("_class", "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # two steps, so that no task adds up more than 2**20 cells: over blocks of cells, then within a block
    counts = counts.withColumn("_block", F.shiftrightunsigned("_cell", 20))
    blocks = counts.groupBy("_class", "_block").agg(F.sum("_n").alias("_m"))
    of_class, of_block = Window.partitionBy("_class"), Window.partitionBy("_class", "_block")
    upto = lambda w, key: w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_class", "_block", F.sum("_m").over(of_class).alias("_size"),
                           F.coalesce(F.sum("_m").over(upto(of_class, "_block")), F.lit(0)).alias("_start"))
    before = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(upto(of_block, "_cell")), F.lit(0))).join(blocks, ["_class", "_block"]).select(
        "_class", "_cell", "_size", (F.col("_start") + F.col("_inside")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_class", "_cell").orderBy("_hash", "_tie")) - 1
    return (d.withColumn("_nth", nth).join(before, ["_class", "_cell"])
             .select(*every, (F.col("_before") + F.col("_nth")).alias("_rank"), "_size"))


def with_part(df: DataFrame, label: str = "is_ddos", test_size: float = 0.2, seed: int = 42, keys=KEY, name: str = "in_test") -> DataFrame:
    """Add whether the row is in the test part, which has ``test_size`` of each class, rounded."""
    in_test = F.col("_rank") < F.round(F.col("_size") * F.lit(test_size))
    return with_class_rank(df, label, seed, keys).select(*[F.col(f"`{c}`") for c in df.columns], in_test.alias(name))


def stratified_split(df: DataFrame, label: str = "is_ddos", test_size: float = 0.2, seed: int = 42, keys=KEY):
    """(train, test) with ``test_size`` of each class, rounded, in the test part."""
    ranked = with_part(df, label, test_size, seed, keys, "_in_test")
    return ranked.where("NOT _in_test").drop("_in_test"), ranked.where("_in_test").drop("_in_test")


def with_folds(df: DataFrame, k: int = 3, seed: int = 42, keys=KEY, name: str = "fold", label: str | None = None) -> DataFrame:
    """Add the fold, 0 to k - 1; with ``label`` every class is spread evenly over the folds."""
    if label is not None:
        ranked = with_class_rank(df, label, seed + 7919, keys)
        return ranked.select(*df.columns, F.pmod(F.col("_rank"), F.lit(k)).cast("int").alias(name))
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(seed + 7919), *[F.col(f"`{c}`") for c in keys
                                                                        if c in df.columns]), F.lit(k)).cast("int"))


def split_summary(train: DataFrame, test: DataFrame, label: str = "is_ddos") -> DataFrame:
    """Rows and class share per part."""
    from brokerlens.operators.basic import share_within
    both = (train.select(F.lit("train").alias("part"), label)
                 .unionByName(test.select(F.lit("test").alias("part"), label)))
    counts = both.groupBy("part", label).agg(F.count(F.lit(1)).alias("count"))
    return share_within(counts, "count", ["part"], "percent")


def recombine(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test, allowMissingColumns=True)
