"""Sharding by vector bin packing: bytes, tokens and rows balanced together.

Rows of equal text form a group, which goes to one shard; a group larger
than a shard is first dealt into parts of a fraction of one.  Groups are
placed largest first, each where the dot product of its size vector
with the shard's residual capacity is highest.

Packing runs in randomised blocks of bounded size: each block fills its
own set of bins, and the bins of up to ``FAN_IN`` blocks are then packed
as items of the next level, by the same rule, until one block is left.  So no
task sees more than a block, and the depth grows with the logarithm of the
input.

Defined cases: a null text counts as no bytes and no words, and all null
texts are one group; repeated rows each get a slot; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch, documents, word_count

SHARDS = 40
OVERHEAD = 16          # bytes that a row takes beside its text
BLOCK = 16384          # groups in a block, on average
FAN_IN = 64            # blocks whose bins are packed together
PART = 8               # a group larger than a shard is dealt into parts of 1/PART of one
PART_ROWS = 100_000    # rows of a group that are numbered by one task, on average, at most
SIZE = ["bytes", "tokens", "rows"]
WEIGHTS = (1.0, 0.1, 0.03)   # of the dimensions in the dot product: bytes come first


def place(sizes, bins: int, weights=WEIGHTS):
    """Bin of each row of ``sizes`` (items x dimensions), largest first: the one with the highest
    weighted dot product of the item's sizes and the bin's residual capacity, both as shares of a bin."""
    import numpy as np
    sizes = np.asarray(sizes, float)
    capacity = sizes.sum(axis=0) / bins
    unit = np.divide(sizes, capacity, out=np.zeros_like(sizes), where=capacity > 0)
    room, pull = np.ones((bins, sizes.shape[1])), unit * np.asarray(weights)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-unit.max(axis=1), kind="stable"):
        out[i] = b = int(np.argmax(room @ pull[i]))
        room[b] -= unit[i]
    return out


def _packer(bins: int, keep: list[str]):
    """applyInArrow function: adds ``bin``; rows come in the order of ``keep``, so that reruns agree."""
    def pack(table):
        import numpy as np
        import pyarrow as pa
        table = table.sort_by([(c, "ascending") for c in keep])
        sizes = np.column_stack([table.column(c).to_numpy() for c in SIZE])
        where = place(sizes, bins)
        rows, before = sizes[:, SIZE.index("rows")], np.zeros(len(sizes), np.int64)
        for b in range(bins):
            mine = where == b
            before[mine] = np.cumsum(rows[mine]) - rows[mine]
        return (table.append_column("bin", pa.array(where, pa.int32()))
                     .append_column("before", pa.array(before, pa.int64())))
    return pack


def _levels(units: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """(block, bin, shard, base): the shard of every first-level bin and the rows before it there."""
    bins = scratch.table(units.groupBy("block", "bin").agg(*[F.sum(c).alias(c) for c in SIZE]))
    path = scratch.table(bins.select("block", "bin", F.col("block").alias("b2"), F.col("bin").alias("n2"), "rows"))
    blocks = bins.select("block").distinct().count()
    level = bins
    while blocks > 1:
        blocks = -(-blocks // FAN_IN)
        items = level.select(F.pmod(F.col("block"), F.lit(blocks)).alias("up"), "block", F.col("bin").alias("item"), *SIZE)
        packed = items.groupBy("up").applyInArrow(
            _packer(shards, ["block", "item"]),
            "up long, block long, item int, bytes long, tokens long, rows long, bin int, before long")
        packed = scratch.table(packed)
        up = packed.select(F.col("block").alias("b2"), F.col("item").alias("n2"), "up", "bin")
        path = scratch.table(path.join(up.withColumnRenamed("bin", "u"), ["b2", "n2"])
                                 .select("block", "bin", F.col("up").alias("b2"), F.col("u").alias("n2"), "rows"))
        level = packed.groupBy(F.col("up").alias("block"), "bin").agg(*[F.sum(c).alias(c) for c in SIZE])
    w = Window.partitionBy("n2").orderBy("block", "bin").rowsBetween(Window.unboundedPreceding, -1)
    return path.select("block", "bin", F.col("n2").alias("shard"), F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("base"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, tokens: Column | None = None,
                    overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) per document row.

    ``size`` is the UTF-8 bytes of the text plus ``overhead``; ``tokens`` an expression over
    ``docs`` (default: the number of words); ``slot`` numbers a shard's rows from 0 without gaps."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = F.coalesce("text", F.lit(""))
    rows = scratch.table(docs.select(
        "doc_id", (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("group"),
        (word_count(F.col("text")) if tokens is None else tokens.cast("long")).alias("tokens"),
        F.monotonically_increasing_id().alias("row")))
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    total, n = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    capacity = max(1.0, total / shards)
    over = F.col("bytes") > capacity
    parts = F.greatest(F.when(over, F.col("bytes") / (capacity / PART)).otherwise(F.lit(1.0)), F.col("rows") / PART_ROWS)
    # fewer than shards + rows / PART_ROWS groups are dealt into parts
    large = groups.where(over | (F.col("rows") > PART_ROWS)).select("group", F.ceil(parts).cast("long").alias("parts"), over.alias("split"))
    rows = rows.join(large, "group", "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("row"), F.col("parts"))).cast("long")
    rows = rows.withColumn("part", part).withColumn("unit", F.when(F.coalesce("split", F.lit(False)), F.col("part")).otherwise(F.lit(0)).cast("long"))
    rows = rows.drop("parts", "split")
    dealt = scratch.table(rows.groupBy("group", "unit", "part").agg(
        F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")))
    units = scratch.table(dealt.groupBy("group", "unit").agg(*[F.sum(c).alias(c) for c in SIZE]))
    blocks = max(1, -(-units.count() // BLOCK))
    units = units.withColumn("block", F.pmod(F.xxhash64("group", "unit", F.lit(7)), F.lit(blocks)))
    units = scratch.table(units.groupBy("block").applyInArrow(
        _packer(shards, ["group", "unit"]),
        "group long, unit long, bytes long, tokens long, rows long, block long, bin int, before long"))
    placed = units.join(_levels(units, shards, scratch), ["block", "bin"]).select(
        "group", "unit", "shard", (F.col("base") + F.col("before")).alias("start"))
    earlier = F.sum("rows").over(Window.partitionBy("group", "unit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    where = scratch.table(dealt.withColumn("earlier", F.coalesce(earlier, F.lit(0))).join(placed, ["group", "unit"])
                               .select("group", "part", "shard", (F.col("start") + F.col("earlier")).alias("start")))
    nth = F.row_number().over(Window.partitionBy("group", "part").orderBy("doc_id", "row")) - 1
    return (rows.withColumn("nth", nth).join(where, ["group", "part"])
                .select("doc_id", "size", "text_crc32", "group", "shard", (F.col("start") + F.col("nth")).alias("slot")))


def q_op4(spark, sf_dir: str) -> DataFrame:
    """op4: all documents in 40 shards of near equal bytes (tokens and rows balanced along), equal texts together."""
    d = shard_documents(documents(spark, sf_dir))
    return d.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                    "slot", F.lit(None).cast("int").alias("grown_shard"))
