"""Exact k nearest neighbours as a pivot-partitioned join.

Equal training points are first added up, so a point that a third of all rows
share is one row.  Points go to the cell of their nearest pivot; a cell with many
points is cut into rings by the distance from its pivot.  A ring (a part) is
known by its pivot and its least and largest distance, so the triangle
inequality gives a lower bound of the distance between a query and all its points,
and the hyperplane between two pivots another.

Queries, equal ones once, first search the part they fall into, which bounds the
distance of their k-th neighbour, and then only the parts whose lower bound is not
above it.  Within a part the points stand in the leaves of a k-d tree, whose boxes
prune in the same way.  A part's queries are dealt over several tasks if there are
many.  What the driver holds is bounded: pivots and the ranges of the parts.

Equally distant training rows at the k-th place share the places left evenly, so
that the result does not depend on any order of rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlens.operators.basic import materialize

PART_POINTS = 4096     # aimed at in a part
MAX_PIVOTS = 512
MAX_RINGS = 64         # of a cell
QUERY_ROWS = 50_000    # queries of a part that a task answers
CELLS = 1 << 20        # numbers in a matrix of queries and parts
LEAF = 64              # points in a leaf of the k-d tree
TIE = 12               # decimals to which distances are compared

FOUND = "vec array<double>, d double, n long, pos long"


# ---- inside a part ---------------------------------------------------------------------------------
def _leaves(X: np.ndarray, size: int = LEAF) -> list[np.ndarray]:
    """Rows of ``X`` in the leaves of a k-d tree: halves by the median of the widest axis."""
    todo, out = [np.arange(len(X))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        part = X[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return out


def _distances(Q: np.ndarray, X: np.ndarray) -> np.ndarray:
    out = np.zeros((len(Q), len(X)))
    for axis in range(Q.shape[1]):
        out += (Q[:, axis, None] - X[None, :, axis]) ** 2
    return np.round(np.sqrt(out), TIE)


def nearest_in(X, n, pos, Q, k: int, most=None):
    """(query, distance, n, pos): training rows at each distance, for the k nearest points of every query and all
    points as far as the last of them, none further than ``most``."""
    leaves = _leaves(X)
    lo, hi = (np.array([f(X[rows], axis=0) for rows in leaves]) for f in (np.min, np.max))
    out = [[], [], [], []]
    for at in range(0, len(Q), 2048):
        q = Q[at:at + 2048]
        box = np.zeros((len(q), len(leaves)))
        for axis in range(q.shape[1]):
            box += np.maximum(0.0, np.maximum(lo[None, :, axis] - q[:, axis, None], q[:, axis, None] - hi[None, :, axis])) ** 2
        box = np.sqrt(box) * (1 - 1e-9) - 10.0 ** -TIE
        order = np.argsort(box, axis=1)
        best = np.full((len(q), k), np.inf)
        limit = np.full(len(q), np.inf) if most is None else most[at:at + 2048].copy()
        going = np.arange(len(q))
        for step in range(len(leaves)):
            leaf = order[going, step]
            near = box[going, leaf] <= limit[going]
            going, leaf = going[near], leaf[near]        # leaves come by distance: who stops here is done
            if not len(going):
                break
            for v in np.unique(leaf):
                who = going[leaf == v]
                d = np.concatenate([best[who], _distances(q[who], X[leaves[v]])], axis=1)
                best[who] = np.partition(d, k - 1, axis=1)[:, :k]
                limit[who] = np.minimum(limit[who], best[who].max(axis=1))
        hit = box <= limit[:, None]
        for v in np.flatnonzero(hit.any(axis=0)):
            who = np.flatnonzero(hit[:, v])
            d = _distances(q[who], X[leaves[v]])
            i, j = np.nonzero(d <= limit[who, None])
            rows = leaves[v][j]
            for held, values in zip(out, (who[i] + at, d[i, j], n[rows], pos[rows])):
                held.append(values)
    query, d, n, pos = (np.concatenate(x) if x else np.zeros(0) for x in out)
    order = np.lexsort((d, query))
    query, d, n, pos = query[order].astype(np.int64), d[order], n[order], pos[order]
    first = np.flatnonzero(np.concatenate([[True], (query[1:] != query[:-1]) | (d[1:] != d[:-1])])) if len(query) else np.zeros(0, int)
    add = lambda x: np.add.reduceat(x, first).astype(np.int64) if len(first) else np.zeros(0, np.int64)
    return query[first], d[first], add(n), add(pos)


def _matrix(column, p: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _search(points: DataFrame, queries: DataFrame, k: int, p: int) -> DataFrame:
    """(vec, d, n, pos): the rows of ``nearest_in`` for queries (part, vec, most) in the parts they name."""
    spark = points.sparkSession
    deal = {r["part"]: math.ceil(r["m"] / QUERY_ROWS) for r in queries.groupBy("part").agg(F.count(F.lit(1)).alias("m")).collect()}
    if not deal:
        return spark.createDataFrame([], FOUND)
    shares = F.broadcast(spark.createDataFrame(list(deal.items()), "part int, shares int"))      # one row per part
    q = queries.join(shares, "part").withColumn("share", F.pmod(F.xxhash64("vec"), F.col("shares")).cast("int"))
    x = points.join(shares, "part").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))

    def run(left, right):
        import pyarrow as pa
        Q = _matrix(right["vec"], p)
        if left.num_rows:
            query, d, n, pos = nearest_in(_matrix(left["vec"], p), left["n"].to_numpy(), left["pos"].to_numpy(), Q, k, right["most"].to_numpy())
        else:
            query, d, n, pos = (np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64))
        vec = right["vec"].combine_chunks().take(pa.array(query))
        return pa.table([vec, pa.array(d), pa.array(n), pa.array(pos)], names=["vec", "d", "n", "pos"])

    left = x.select("part", "share", "vec", "n", "pos").groupBy("part", "share")
    return left.cogroup(q.select("part", "share", "vec", "most").groupBy("part", "share")).applyInArrow(run, FOUND)


# ---- parts -------------------------------------------------------------------------------------------
class Parts:
    """Pivots and the parts around them: cell, ring, number of points, least and largest distance from the pivot."""

    def __init__(self, pivots: np.ndarray, rows: list):
        self.pivots = pivots
        self.id = np.array([r["part"] for r in rows], int)
        self.cell = self.id // MAX_RINGS
        self.size = np.array([r["m"] for r in rows], int)
        self.least, self.most = (np.array([r[c] for r in rows], float) for c in ("least", "most"))
        self.apart = _distances(pivots, pivots)

    def ring_gap(self, D: np.ndarray) -> np.ndarray:
        """Lower bounds of the distances between queries (rows of distances to the pivots) and the parts."""
        to = D[:, self.cell]
        return np.maximum(0.0, np.maximum(to - self.most, self.least - to))

    def own(self, D: np.ndarray) -> np.ndarray:
        """Index of the part a query falls into: the nearest ring of its nearest pivot's cell, or of any with points."""
        gap = self.ring_gap(D)
        there = np.isin(np.arange(len(self.pivots)), self.cell)
        cell = np.argmin(np.where(there, D, np.inf), axis=1)
        return np.argmin(np.where(self.cell[None, :] == cell[:, None], gap, np.inf), axis=1)

    def bound(self, D: np.ndarray, k: int) -> np.ndarray:
        """Upper bound of the k-th neighbour's distance from any part of k points."""
        full = self.size >= k
        return (D[:, self.cell[full]] + self.most[full]).min(axis=1) if full.any() else np.full(len(D), np.inf)

    def within(self, D: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which parts may hold points not further than ``most``."""
        gap = self.ring_gap(D)
        nearest = np.argmin(D, axis=1)
        between = self.apart[nearest][:, self.cell]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (D[:, self.cell] ** 2 - D.min(axis=1)[:, None] ** 2) / (2 * between)
        gap = np.maximum(gap, np.where(between > 0, plane, 0.0))
        return gap * (1 - 1e-9) - 1e-9 <= most[:, None]


def _by_batch(df: DataFrame, schema: str, p: int, f, width: int) -> DataFrame:
    """``f(batch, matrix of vec)`` -> record batches, over the batches of ``df``, cut so that a matrix with ``width``
    columns has about ``CELLS`` numbers however many parts there are."""
    size = max(16, min(4096, CELLS // max(1, width)))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                yield from f(part, _matrix(pa.chunked_array([part["vec"]]), p), pa)
    return df.mapInArrow(run, schema)


def _partition(points: DataFrame, p: int) -> tuple[DataFrame, Parts]:
    """The points (vec, n, pos) with their ``part``, and the parts."""
    n = points.count()
    m = max(1, min(MAX_PIVOTS, math.ceil(n / PART_POINTS)))
    pivots = np.array([r["vec"] for r in points.orderBy(F.xxhash64("vec"), "vec").limit(m).select("vec").collect()], float).reshape(-1, p)

    def place(batch, X, pa):
        D = _distances(X, pivots)
        cell = D.argmin(axis=1)
        yield pa.RecordBatch.from_arrays([batch["vec"], batch["n"], batch["pos"], pa.array(cell, pa.int32()), pa.array(D[np.arange(len(X)), cell])],
                                         names=["vec", "n", "pos", "cell", "dist"])

    placed = materialize(_by_batch(points, "vec array<double>, n long, pos long, cell int, dist double", p, place, m))
    steps = F.array(*[F.lit(i / MAX_RINGS) for i in range(1, MAX_RINGS)])
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("m"), F.percentile_approx("dist", steps, 1000).alias("b"))
    rings = F.least(F.ceil(F.col("m") / PART_POINTS), F.lit(MAX_RINGS))
    bounds = F.transform(F.sequence(F.lit(1), rings.cast("int")), lambda i: F.get("b", F.floor(i * MAX_RINGS / rings).cast("int") - 1))
    cells = F.broadcast(cells.select("cell", F.array_distinct(F.slice(bounds, F.lit(1), F.greatest(rings.cast("int") - 1, F.lit(0)))).alias("bounds")))   # one row per pivot
    ring = F.size(F.filter("bounds", lambda b: b < F.col("dist")))
    placed = placed.join(cells, "cell").select("vec", "n", "pos", (F.col("cell") * MAX_RINGS + ring).cast("int").alias("part"), "dist")
    rows = placed.groupBy("part").agg(F.count(F.lit(1)).alias("m"), F.min("dist").alias("least"), F.max("dist").alias("most")).orderBy("part").collect()
    return placed.drop("dist"), Parts(pivots, rows)


def neighbour_counts(points: DataFrame, queries: DataFrame, k: int, p: int) -> DataFrame:
    """(vec, d, n, pos) for every query vector: training rows and positives among them at each distance, for the k
    nearest rows at least.  ``points`` (vec, n, pos) and ``queries`` (vec) are distinct vectors of ``p`` numbers."""
    placed, parts = _partition(points, p)
    placed, queries = materialize(placed), materialize(queries.select("vec"))
    width = max(len(parts.id), len(parts.pivots))

    def first(batch, Q, pa):
        D = _distances(Q, parts.pivots)
        yield pa.RecordBatch.from_arrays([batch["vec"], pa.array(parts.id[parts.own(D)], pa.int32()), pa.array(parts.bound(D, k))], names=["vec", "part", "most"])

    near = materialize(_search(placed, _by_batch(queries, "vec array<double>, part int, most double", p, first, width), k, p))
    # the distance at which the k-th row is reached, if it is
    so_far = F.sum("n").over(Window.partitionBy("vec").orderBy("d"))
    reached = near.withColumn("rows", so_far).where(F.col("rows") >= k).groupBy("vec").agg(F.min("d").alias("reached"))
    bounded = queries.join(reached, "vec", "left")

    def others(batch, Q, pa):
        D = _distances(Q, parts.pivots)
        most = np.fmin(batch["reached"].to_numpy(zero_copy_only=False).astype(float), parts.bound(D, k))
        hit = parts.within(D, most)
        hit[np.arange(len(Q)), parts.own(D)] = False
        i, j = np.nonzero(hit)
        yield pa.RecordBatch.from_arrays([batch["vec"].take(pa.array(i)), pa.array(parts.id[j], pa.int32()), pa.array(most[i])], names=["vec", "part", "most"])

    further = materialize(_by_batch(bounded, "vec array<double>, part int, most double", p, others, width))
    return near.union(_search(placed, further, k, p))


def votes(found: DataFrame, ks: list[int]) -> DataFrame:
    """(vec, p<k> for every k): share of positives among the k nearest rows by weight 1 / d; rows at distance 0 take all."""
    per = found.groupBy("vec", "d").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("vec").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("before", before).where(F.col("before") < max(ks))
    share, d, items = F.col("pos") / F.col("n"), F.col("d"), []
    for k in dict.fromkeys(ks):
        take = F.least(F.col("n"), F.lit(k) - F.col("before"))
        w = F.when((d > 0) & (take > 0), take / d)
        items += [F.sum(w).alias(f"w{k}"), F.sum(w * share).alias(f"wp{k}")]
    per = per.groupBy("vec").agg(F.max(F.when(d == 0, share)).alias("same"), *items)      # a row at distance 0 is the first
    return per.select("vec", *[F.coalesce("same", F.try_divide(f"wp{k}", f"w{k}")).alias(f"p{k}") for k in dict.fromkeys(ks)])


def vote(found: DataFrame, k: int) -> DataFrame:
    """(vec, probability) of ``votes`` for one k."""
    return votes(found, [k]).withColumnRenamed(f"p{k}", "probability")


def standard_vector(features: list[str], mean, scale) -> Column:
    """The standardised features as an array; a missing value counts as the mean."""
    def z(c, m, s):
        x = F.col(f"`{c}`").cast("double")
        return F.coalesce((F.when(~F.isnan(x), x) - F.lit(float(m))) / F.lit(float(s)), F.lit(0.0)) + F.lit(0.0)
    return F.array(*[z(c, m, s) for c, m, s in zip(features, mean, scale)])
