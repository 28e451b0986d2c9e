"""Masked co-moments of column pairs in one pass.

Each task turns its rows into a matrix of values and a mask of present ones and
keeps, for every pair, the count, sums, squares, cross products and ranges over
the rows where both are present: matrix products per batch, added up over its
batches.  A task returns one row per pair; they merge by plain sums, minima and
maxima, so that neither rows nor null patterns are grouped.  Values are shifted by
constants near their means, against cancellation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHIFT_ROWS = 64      # first rows, whose means are the shifts; any finite shift gives the same result but for rounding

MOMENTS = "i int, j int, n double, sa double, sb double, qa double, qb double, ab double, la double, ha double, lb double, hb double"


def _shifts(x: DataFrame, p: int) -> list[float]:
    import math
    rows = [[v for v in r if v is not None and math.isfinite(v)] for r in zip(*x.limit(SHIFT_ROWS).collect())]
    return [sum(r) / len(r) if r and math.isfinite(sum(r)) else 0.0 for r in rows] or [0.0] * p


def co_moments(df: DataFrame, cols: list[str], against: list[str] | None = None) -> DataFrame:
    """(i, j, n, sa, sb, qa, qb, ab, la, ha, lb, hb) for columns i of ``cols`` and j of ``against`` (numbers in the two
    lists): count, sums of a, b, aa, bb, ab (a and b shifted) and the ranges of a and b over the rows that have both.
    Without ``against`` all pairs i <= j of ``cols``."""
    other = cols if against is None else against
    names = list(dict.fromkeys([*cols, *other]))
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(names)])
    shift = _shifts(x, len(names))
    at = {c: k for k, c in enumerate(names)}
    rows, others, triangle = [at[c] for c in cols], [at[c] for c in other], against is None

    def sums(batches):
        import numpy as np
        import pyarrow as pa
        A, B = np.array(rows), np.array(others)
        shape = (len(A), len(B))
        add = {k: np.zeros(shape) for k in ("n", "sa", "sb", "qa", "qb", "ab")}
        low, high = ({k: np.full(shape, fill) for k in "ab"} for fill in (np.inf, -np.inf))

        def matrix(V, M):
            """Co-moments of finite columns, missing values as zero."""
            a, b, ma, mb = V[:, A], V[:, B], M[:, A].astype(float), M[:, B].astype(float)
            with np.errstate(all="ignore"):
                return {"n": ma.T @ mb, "sa": a.T @ mb, "sb": ma.T @ b, "qa": (a * a).T @ mb, "qb": ma.T @ (b * b), "ab": a.T @ b}

        def single(V, M, k, m):
            """The same for one pair, row by row, as infinities must not meet the rows of other pairs."""
            both = M[:, A[k]] & M[:, B[m]]
            a, b = V[both, A[k]], V[both, B[m]]
            with np.errstate(all="ignore"):
                return {"n": len(a), "sa": a.sum(), "sb": b.sum(), "qa": (a * a).sum(), "qb": (b * b).sum(), "ab": (a * b).sum()}

        for batch in batches:
            if not batch.num_rows:
                continue
            M = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
            V = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            V = np.where(M, V - np.array(shift), 0.0)
            wild = ~np.isfinite(V).all(axis=0)
            got = matrix(np.where(wild, 0.0, V) if wild.any() else V, M)
            for k, m in zip(*np.nonzero(wild[A][:, None] | wild[B][None, :])):
                for key, v in single(V, M, k, m).items():
                    got[key][k, m] = v
            for key in add:
                add[key] += got[key]
            # ranges: of a column over the rows where another is present
            for own, far, key in ((A, B, "a"), (B, A, "b")):
                for m, f in enumerate(far):
                    there = M[:, own] & M[:, [f]]
                    lo = np.where(there, V[:, own], np.inf).min(axis=0)
                    hi = np.where(there, V[:, own], -np.inf).max(axis=0)
                    place = (slice(None), m) if key == "a" else (m, slice(None))
                    low[key][place] = np.minimum(low[key][place], lo)
                    high[key][place] = np.maximum(high[key][place], hi)
        i, j = np.indices(shape)
        keep = (i <= j) & (add["n"] > 0) if triangle else add["n"] > 0
        values = [add["n"], add["sa"], add["sb"], add["qa"], add["qb"], add["ab"], low["a"], high["a"], low["b"], high["b"]]
        yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *[pa.array(v[keep]) for v in values]],
                                         names=["i", "j", "n", "sa", "sb", "qa", "qb", "ab", "la", "ha", "lb", "hb"])

    per_task = x.mapInArrow(sums, MOMENTS)
    return per_task.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "qa", "qb", "ab")],
                                          *[F.min(c).alias(c) for c in ("la", "lb")], *[F.max(c).alias(c) for c in ("ha", "hb")])


def pearson(df: DataFrame, cols: list[str], against: list[str] | None = None) -> DataFrame:
    """(feature_x, feature_y, corr), pairwise complete: every ordered pair of ``cols``, or of ``cols`` with ``against``.
    Null where a column is constant or not finite over the pair's rows, and for a pair without rows."""
    spark = df.sparkSession
    m = co_moments(df, cols, against)
    n = F.col("n")
    va, vb = F.col("qa") - F.col("sa") * F.col("sa") / n, F.col("qb") - F.col("sb") * F.col("sb") / n
    r = (F.col("ab") - F.col("sa") * F.col("sb") / n) / F.sqrt(va * vb)
    varies = (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb")) & (va > 0) & (vb > 0) & ~F.isnan(r)
    corr = m.select("i", "j", F.when(varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("corr"))
    other = cols if against is None else against
    pairs = [(k, j, a, b) if against is not None or k <= j else (j, k, a, b) for k, a in enumerate(cols) for j, b in enumerate(other)]
    spine = spark.createDataFrame(pairs, "i int, j int, feature_x string, feature_y string")
    return spine.join(corr, ["i", "j"], "left").select("feature_x", "feature_y", "corr")
