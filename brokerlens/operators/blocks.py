"""Rows as persisted matrix blocks, and sums of arrays over tasks, for models that pass over the data many times."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

BLOCK_ROWS = 4096
FAN_IN = 16          # rows that the driver adds up itself

BLOCK = "block int, n int, x binary, y binary"


def matrix_blocks(df: DataFrame, vec: Column, y: Column, key: Column, partitions: int) -> DataFrame:
    """(block, n, x, y): at most ``BLOCK_ROWS`` rows each as the bytes of float matrices, in ``partitions`` parts whose
    rows and order are functions of ``key`` (ties of the values).  ``vec``: array of doubles; ``y``: array of doubles.
    Kept in executor memory or on executor disk; the caller frees it with ``unpersist``."""
    rows = df.select(vec.alias("vec"), y.alias("y"), F.xxhash64(key, vec, y).alias("key"))

    def pack(batches):
        import pyarrow as pa
        held, count, nth = [], 0, 0

        def out(part, nth):
            x, t = (np.asarray(part.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False), float) for c in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([nth], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([x.tobytes()], pa.binary()),
                                               pa.array([t.tobytes()], pa.binary())], names=["block", "n", "x", "y"])

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= BLOCK_ROWS:
                t = pa.Table.from_batches(held)
                while t.num_rows >= BLOCK_ROWS:
                    yield out(t.slice(0, BLOCK_ROWS), nth)
                    t, nth = t.slice(BLOCK_ROWS), nth + 1
                held, count = t.to_batches(), t.num_rows
        if count:
            yield out(pa.Table.from_batches(held), nth)

    dealt = rows.repartition(partitions, "key").sortWithinPartitions("key", "y", "vec").select("vec", "y")
    return dealt.mapInArrow(pack, BLOCK).persist(StorageLevel.MEMORY_AND_DISK)


def unpacked(batch, p: int, q: int = 1):
    """(block, X, Y) of every row of a batch of blocks."""
    for block, n, x, y in zip(*(batch.column(c).to_pylist() for c in range(4))):
        yield block, np.frombuffer(x, float).reshape(n, p), np.frombuffer(y, float).reshape(n, q)


def sum_over_tasks(df: DataFrame, f, tasks: int, fan_in: int = FAN_IN) -> np.ndarray | None:
    """Sum of the arrays that ``f(batches)`` returns for each of the ``tasks`` partitions; None if none has any.

    Beyond ``fan_in`` tasks they are added up in a second stage first, so that the driver gets ``fan_in`` arrays at most."""
    def one(batches):
        import pyarrow as pa
        a = f(batches)
        if a is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(a, float).tobytes()], pa.binary())], names=["a"])

    def add(batches):
        import pyarrow as pa
        total = None
        for batch in batches:
            for a in batch.column(0).to_pylist():
                a = np.frombuffer(a, float)
                total = a.copy() if total is None else total + a
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["a"])

    sums = df.mapInArrow(one, "a binary")
    if tasks > fan_in:
        sums = sums.repartition(fan_in).mapInArrow(add, "a binary")
    rows = [np.frombuffer(r["a"], float) for r in sums.collect()]
    return sum(sorted(rows, key=lambda a: a.tobytes())) if rows else None
