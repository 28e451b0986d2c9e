"""Random forest of two classes: binned rows, equal ones added up, bootstrap counts drawn where a row lies.

Features are cut into at most ``BINS`` bins, as MLlib's trees do, and rows with equal bins become one
weighted row.  A tree draws for every weighted row how often each class is in its sample (Poisson), from the seed,
the tree and the block the row lies in; so no sample is stored, and a rerun draws the same.

A node with more than ``LOCAL_ROWS`` weighted rows is split from histograms summed over all tasks, one pass a level
for all trees.  The rows of a smaller node are sent once to one task (a record per block, tree and node), which grows
the rest of its subtree.  The driver holds the trees, as MLlib's does, and the histograms of the large nodes.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from brokerlens.operators.blocks import sum_over_tasks

BINS = 32                # of a feature, at most
MIN_ROWS = 5             # sampled rows of a child, at least
LOCAL_ROWS = 500_000     # weighted rows of a node that one task grows on its own
PART_ROWS = 50_000       # weighted rows of a partition of blocks
BLOCK_ROWS = 32_768
SLOTS = 4096             # nodes whose histograms a task holds at a time while it grows a subtree
TASK_BYTES = 64 << 20    # of the records that a task grows subtrees from
NODE = np.dtype([("feature", "i2"), ("cut", "i2"), ("left", "i4"), ("c0", "f8"), ("c1", "f8")])   # feature -1: a leaf

BLOCK = "n int, x binary, w binary"
RECORD = "tree int, node int, wide int, x binary, w binary"


# ---- rows --------------------------------------------------------------------------------------------
def cut_points(rows: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper ends of the bins of every feature but the last bin: the middles between its values, or quantiles if it has many values."""
    x = {c: F.when(~F.isnan(c), F.col(c)) for c in features}
    at = [i / bins for i in range(1, bins)]
    got = rows.agg(*[F.struct(F.percentile_approx(v, at, 10_000).alias("q"), F.approx_count_distinct(v).alias("d")).alias(f"f{i}")
                     for i, v in enumerate(x.values())]).first()
    few = [i for i in range(len(features)) if got[i]["d"] <= 2 * bins]
    sets = rows.agg(F.lit(0), *[F.collect_set(x[features[i]]).alias(f"f{i}") for i in few]).first()
    out = []
    for i in range(len(features)):
        values = np.unique(np.array(sets[f"f{i}"], float) + 0.0) if i in few else None
        out.append((values[1:] + values[:-1]) / 2 if values is not None and len(values) <= bins else np.unique(np.array(got[i]["q"] or [], float)))
    return out


def to_bins(columns, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of the values; a missing value lies in the last bin."""
    return np.stack([np.searchsorted(c, x, "left").astype(np.uint8) for c, x in zip(cuts, columns)], axis=1)


def _binary(data: np.ndarray, width: int):
    """Rows of ``width`` bytes as an Arrow array."""
    import pyarrow as pa
    n = data.nbytes // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def weighted_rows(rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """(x, n0, n1): bins of a row as bytes, and how many rows of each class have them; ``rows`` hold the features and ``y``."""
    p = len(features)

    def pack(batches):
        import pyarrow as pa
        for batch in batches:
            if batch.num_rows:
                x = to_bins([batch.column(j).to_numpy(zero_copy_only=False) for j in range(p)], cuts)
                yield pa.RecordBatch.from_arrays([_binary(x, p), batch.column(p)], names=["x", "y"])
    binned = rows.select(*[F.col(f"`{c}`") for c in features], "y").mapInArrow(pack, "x binary, y double")
    one = F.col("y") == 1
    return binned.groupBy("x").agg(F.sum((~one).cast("long")).alias("n0"), F.sum(one.cast("long")).alias("n1"))


def row_blocks(weighted: DataFrame, p: int, partitions: int) -> DataFrame:
    """(n, x, w): blocks of weighted rows, which rows being a function of the rows and ``partitions``; persisted."""
    def pack(batches):
        import pyarrow as pa
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = b"".join(part.column(0).to_pylist())
                w = np.stack([part.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([x], pa.binary()), pa.array([w.astype(np.int64).tobytes()], pa.binary())],
                                                 names=["n", "x", "w"])
    dealt = weighted.repartition(partitions, "x").sortWithinPartitions("x")
    return dealt.mapInArrow(pack, BLOCK).persist(StorageLevel.MEMORY_AND_DISK)


def _unpacked(batch, p: int):
    """(mark, X, counts) of the blocks of a batch; the mark is a function of the rows."""
    for n, x, w in zip(*(batch.column(c) for c in range(3))):
        x, w = x.as_buffer(), w.as_buffer()
        yield zlib.crc32(w, zlib.crc32(x)), np.frombuffer(x, np.uint8).reshape(n.as_py(), p), np.frombuffer(w, np.int64).reshape(-1, 2)


def _sample(X: np.ndarray, counts: np.ndarray, seed: int, tree: int, mark: int):
    """Rows of a tree's sample and how often it holds each class of them."""
    w, held = np.zeros(counts.shape, np.int64), counts > 0
    w[held] = np.random.default_rng([seed, tree, mark]).poisson(counts[held])
    rows = np.flatnonzero(w[:, 0] + w[:, 1])
    return X[rows], w[rows]


# ---- splits ------------------------------------------------------------------------------------------
def descend(tree: np.ndarray, X: np.ndarray) -> np.ndarray:
    """The leaf of every row of bins."""
    at, live = np.zeros(len(X), np.int32), np.arange(len(X))
    while len(live):
        node = at[live]
        inner = tree["feature"][node] >= 0
        live, node = live[inner], node[inner]
        at[live] = tree["left"][node] + (X[live, tree["feature"][node]] > tree["cut"][node])
    return at


def histograms(X: np.ndarray, W: np.ndarray, slot: np.ndarray, slots: int, chosen: np.ndarray) -> np.ndarray:
    """(node, chosen feature, bin, column of W): sums of W; ``slot`` is a row's node."""
    m, rows = chosen.shape[1], np.arange(len(X))
    out = np.empty((slots, m, BINS, W.shape[1]))
    for j in range(m):
        i = slot * BINS + X[rows, chosen[slot, j]]
        for c in range(W.shape[1]):
            out[:, j, :, c] = np.bincount(i, weights=W[:, c], minlength=slots * BINS).reshape(slots, BINS)
    return out


def best_splits(hist: np.ndarray, min_rows: int):
    """Per node: whether a split lowers the Gini impurity, and of the best split the chosen feature, the cut and the sums on its left."""
    left = hist.cumsum(axis=2)
    total, left = left[:, :, -1:], left[:, :, :-1]
    right = total - left
    sizes = [a[..., :2].sum(axis=-1) for a in (total, left, right)]
    n, nl, nr = (np.maximum(s, 1.0) for s in sizes)
    purity = ((left[..., :2] ** 2).sum(axis=-1) / nl + (right[..., :2] ** 2).sum(axis=-1) / nr - (total[..., :2] ** 2).sum(axis=-1) / n) / n
    gain = np.where((sizes[1] >= min_rows) & (sizes[2] >= min_rows), purity, -1.0).reshape(len(hist), -1)
    at = gain.argmax(axis=1)
    k = np.arange(len(hist))
    j, cut = at // (BINS - 1), at % (BINS - 1)
    return gain[k, at] > 1e-14, j, cut, left[k, j, cut]


def subsets(rng, nodes: int, p: int, m: int) -> np.ndarray:
    """``m`` of ``p`` features for every node."""
    return np.argsort(rng.random((nodes, p)), axis=1)[:, :m]


def _leaves(sums: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sums), NODE)
    out["feature"], out["c0"], out["c1"] = -1, sums[:, 0], sums[:, 1]
    return out


def _splittable(sums: np.ndarray, min_rows: int) -> np.ndarray:
    return (sums[:, :2] > 0).all(axis=1) & (sums[:, :2].sum(axis=1) >= 2 * min_rows)


def grow(X: np.ndarray, W: np.ndarray, depth: int, m: int, min_rows: int, rng) -> np.ndarray:
    """The nodes of a subtree of at most ``depth`` levels below its root, children after their parents."""
    levels, size = [_leaves(W.sum(axis=0, dtype=float)[None])], 1
    slot, open_at = np.zeros(len(X), np.int64), np.flatnonzero(_splittable(W.sum(axis=0, dtype=float)[None], min_rows))
    while depth > 0 and len(open_at):
        chosen, parts = subsets(rng, len(open_at), X.shape[1], m), []
        for at in range(0, len(open_at), SLOTS):
            here = slice(None) if len(open_at) <= SLOTS else np.flatnonzero((slot >= at) & (slot < at + SLOTS))
            some = chosen[at:at + SLOTS]
            hist = histograms(X[here], W[here], slot[here] - at, len(some), some)
            parts.append((*best_splits(hist, min_rows), hist[:, 0].sum(axis=1)))
        good, j, cut, left, total = (np.concatenate(a) for a in zip(*parts))
        feature, rank = chosen[np.arange(len(chosen)), j], np.cumsum(good) - 1
        above = levels[-1]
        above["feature"][open_at[good]], above["cut"][open_at[good]] = feature[good], cut[good]
        above["left"][open_at[good]] = size + 2 * np.arange(good.sum())
        sums = np.stack([left[good], total[good] - left[good]], axis=1).reshape(-1, 2)
        stays = good[slot]
        X, W, slot = X[stays], W[stays], slot[stays]
        child = 2 * rank[slot] + (X[np.arange(len(X)), feature[slot]] > cut[slot])
        levels.append(_leaves(sums))
        size += len(sums)
        is_open = _splittable(sums, min_rows)
        open_at, number = np.flatnonzero(is_open), np.cumsum(is_open) - 1
        stays = is_open[child]
        X, W, slot = X[stays], W[stays], number[child[stays]]
        depth -= 1
    return np.concatenate(levels)


# ---- fitted trees ------------------------------------------------------------------------------------
def pruned(tree: np.ndarray) -> np.ndarray:
    """Without splits whose two leaves predict the same class, as MLlib's trees are."""
    tree = tree.copy()
    while True:
        inner = np.flatnonzero(tree["feature"] >= 0)
        l, r = tree[tree["left"][inner]], tree[tree["left"][inner] + 1]
        same = (l["feature"] < 0) & (r["feature"] < 0) & ((l["c1"] > l["c0"]) == (r["c1"] > r["c0"]))
        if not same.any():
            break
        tree["feature"][inner[same]] = -1
    kept, level = [np.array([0])], np.array([0])
    while len(level):
        level = level[tree["feature"][level] >= 0]
        level = np.stack([tree["left"][level], tree["left"][level] + 1], axis=1).ravel()
        kept.append(level)
    kept = np.concatenate(kept)
    place = np.zeros(len(tree), np.int32)
    place[kept] = np.arange(len(kept))
    out = tree[kept]
    out["left"] = np.where(out["feature"] >= 0, place[out["left"]], 0)
    return out


def tree_importances(tree: np.ndarray, p: int) -> np.ndarray:
    """Share of every feature in the fall of the impurity, weighted by sampled rows."""
    def impurity(t):
        return 2.0 * t["c0"] * t["c1"] / np.maximum(t["c0"] + t["c1"], 1.0)      # times its rows
    inner = tree[tree["feature"] >= 0]
    fall = impurity(inner) - impurity(tree[inner["left"]]) - impurity(tree[inner["left"] + 1])
    out = np.bincount(inner["feature"], weights=fall, minlength=p)
    return out / out.sum() if out.sum() > 0 else out


class Forest:
    """A trained forest: ``trees`` (arrays of ``NODE``), ``cuts`` of the features, ``depth`` and the number of classes seen."""

    def __init__(self, trees: list[np.ndarray], cuts: list[np.ndarray], depth: int, classes: int):
        self.trees, self.cuts, self.depth, self.classes = trees, cuts, depth, classes

    @property
    def nodes(self) -> int:
        return sum(map(len, self.trees))

    def importances(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the forest, and of every tree."""
        per_tree = np.array([tree_importances(t, len(self.cuts)) for t in self.trees])
        total = per_tree.sum(axis=0)
        return (total / total.sum() if total.sum() > 0 else total), per_tree

    def probability(self, vec):
        """Column of the probability of class 1 (mean of the leaves' shares) for a column of feature arrays."""
        trees, cuts = self.trees, self.cuts
        share = [t["c1"] / np.maximum(t["c0"] + t["c1"], 1.0) for t in trees]

        @F.pandas_udf("double")
        def proba(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=float)
            X, back = np.unique(to_bins(np.stack(x.to_numpy()).T, cuts), axis=0, return_inverse=True)
            return pd.Series((sum(s[descend(t, X)] for t, s in zip(trees, share)) / len(trees))[back.ravel()])
        return proba(vec)


# ---- training ----------------------------------------------------------------------------------------
def _level(tops: list[np.ndarray], slots: list[np.ndarray], chosen: np.ndarray, p: int, seed: int):
    """Function over blocks: histograms (class 0, class 1, weighted rows) of the nodes that have a slot."""
    def run(batches):
        out = None
        for batch in batches:
            for mark, X, counts in _unpacked(batch, p):
                out = np.zeros((len(chosen), chosen.shape[1], BINS, 3)) if out is None else out
                for t, top in enumerate(tops):
                    own = slots[t][slots[t] >= 0]
                    if not len(own):
                        continue
                    x, w = _sample(X, counts, seed, t, mark)
                    slot = slots[t][descend(top, x)]
                    here = slot >= 0
                    lo, hi = own.min(), own.max() + 1     # a tree's slots follow each other
                    out[lo:hi] += histograms(x[here], np.column_stack([w[here], np.ones(here.sum())]), slot[here] - lo, hi - lo, chosen[lo:hi])
        return None if out is None else out.ravel()
    return run


def _records(tops: list[np.ndarray], local: list[np.ndarray], p: int, seed: int):
    """Function over blocks: a record per block, tree and node to be grown by one task, with the node's sampled rows."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for mark, X, counts in _unpacked(batch, p):
                for t, top in enumerate(tops):
                    if not local[t].any():
                        continue
                    x, w = _sample(X, counts, seed, t, mark)
                    node = descend(top, x)
                    order = np.argsort(node, kind="stable")
                    order = order[local[t][node[order]]]
                    if not len(order):
                        continue
                    x, w, node = x[order], w[order], node[order]
                    wide = 1 if w.max() < 1 << 8 else 2 if w.max() < 1 << 16 else 8
                    w = w.astype(f"u{wide}")
                    starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
                    ends = np.r_[starts[1:], len(node)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(starts), t, np.int32)), pa.array(node[starts].astype(np.int32)), pa.array(np.full(len(starts), wide, np.int32)),
                         pa.array([x[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()), pa.array([w[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
                        names=["tree", "node", "wide", "x", "w"])
    return run


def _subtrees(levels_left: list[np.ndarray], p: int, m: int, min_rows: int, seed: int):
    """Function over the sorted records: (tree, node, nodes of the grown subtree)."""
    def run(batches):
        import pyarrow as pa

        def done(key, held):
            X, W = (np.concatenate(a) for a in zip(*held))
            tree = grow(X, W.astype(float), int(levels_left[key[0]][key[1]]), m, min_rows, np.random.default_rng([seed, 1, *key]))
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([tree.tobytes()], pa.binary())],
                                              names=["tree", "node", "nodes"])
        key, held = None, []
        for batch in batches:
            trees, nodes, wide = (batch.column(c).to_pylist() for c in range(3))
            for k in range(batch.num_rows):
                if (trees[k], nodes[k]) != key:
                    if held:
                        yield done(key, held)
                    key, held = (trees[k], nodes[k]), []
                held.append((np.frombuffer(batch.column(3)[k].as_buffer(), np.uint8).reshape(-1, p),
                             np.frombuffer(batch.column(4)[k].as_buffer(), f"u{wide[k]}").reshape(-1, 2)))
        if held:
            yield done(key, held)
    return run


def binned_rows(train: DataFrame, features: list[str], label: str) -> tuple[list[np.ndarray], DataFrame]:
    """The cuts of the features and the weighted rows, persisted, that any number of forests of these rows start from."""
    rows = train.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features], F.col(label).cast("double").alias("y"))
    if not features or train.where(F.col(label).isNull()).limit(1).count():
        raise ValueError("a forest needs features, and labels that are not null")
    cuts = cut_points(rows, features)
    return cuts, weighted_rows(rows, features, cuts).persist(StorageLevel.MEMORY_AND_DISK)


def train_forest(train: DataFrame, features: list[str], label: str, trees: int, depth: int, min_rows: int = MIN_ROWS, seed: int = 42,
                 local_rows: int = LOCAL_ROWS, part_rows: int = PART_ROWS, binned: tuple | None = None) -> Forest:
    """Fit ``trees`` trees of at most ``depth`` levels; a node chooses among sqrt(p) features.  ``binned``: the
    ``binned_rows`` of ``train``, if several forests are fitted on them; the caller frees them."""
    spark, p = train.sparkSession, len(features)
    m = math.ceil(math.sqrt(p))
    cuts, weighted = binned or binned_rows(train, features, label)
    size = weighted.agg(F.count(F.lit(1)).alias("n"), F.sum("n1").alias("n1")).first()
    if not size["n"]:
        raise ValueError("a forest needs training rows")
    parts = math.ceil(size["n"] / part_rows)
    blocks = row_blocks(weighted, p, parts)
    tops = [_leaves(np.zeros((1, 2))) for _ in range(trees)]
    left = [np.array([depth]) for _ in range(trees)]               # levels below a node
    large = [np.array([size["n"] > local_rows]) for _ in range(trees)]
    local = [~x for x in large]
    rows_in = [np.array([size["n"]]) for _ in range(trees)]
    try:
        for level in range(depth):
            sizes = [int(x.sum()) for x in large]
            if not sum(sizes):
                break
            starts = np.cumsum([0, *sizes])
            slots = [np.where(x, starts[t] + np.cumsum(x) - 1, -1) for t, x in enumerate(large)]
            chosen = subsets(np.random.default_rng([seed, 2, level]), int(starts[-1]), p, m)
            hist = sum_over_tasks(blocks, _level(tops, slots, chosen, p, seed), parts).reshape(len(chosen), m, BINS, 3)
            good, j, cut, lefts = best_splits(hist, min_rows)
            for t in range(trees):
                s, at = np.arange(starts[t], starts[t + 1]), np.flatnonzero(large[t])
                total = hist[s, 0].sum(axis=1)
                top, g = tops[t], good[s]
                top["c0"][at], top["c1"][at] = total[:, 0], total[:, 1]
                top["feature"][at[g]], top["cut"][at[g]] = chosen[s, j[s]][g], cut[s][g]
                top["left"][at[g]] = len(top) + 2 * np.arange(g.sum())
                sums = np.stack([lefts[s][g], (total - lefts[s])[g]], axis=1).reshape(-1, 3)
                tops[t] = np.concatenate([top, _leaves(sums)])
                below = np.repeat(left[t][at[g]] - 1, 2)
                grows = _splittable(sums, min_rows) & (below > 0)
                large[t] = np.r_[np.zeros(len(top), bool), grows & (sums[:, 2] > local_rows)]
                local[t] = np.r_[local[t], grows & (sums[:, 2] <= local_rows)]
                rows_in[t], left[t] = np.r_[rows_in[t], sums[:, 2]], np.r_[left[t], below]
        sent = sum(float(n[x].sum()) for n, x in zip(rows_in, local))
        if sent:
            tasks = max(min(trees, 4 * spark.sparkContext.defaultParallelism), math.ceil(sent * (p + 2) / TASK_BYTES))
            records = blocks.mapInArrow(_records(tops, local, p, seed), RECORD)
            dealt = records.repartition(tasks, "tree", "node").sortWithinPartitions("tree", "node")
            grown = dealt.mapInArrow(_subtrees(left, p, m, min_rows, seed), "tree int, node int, nodes binary").collect()
            for r in sorted(grown, key=lambda r: (r["tree"], r["node"])):
                tops[r["tree"]] = _with_subtree(tops[r["tree"]], r["node"], np.frombuffer(r["nodes"], NODE))
    finally:
        blocks.unpersist()
        if binned is None:
            weighted.unpersist()
    return Forest([pruned(t) for t in tops], cuts, depth, 2 if size["n1"] else 1)


def _with_subtree(tree: np.ndarray, node: int, below: np.ndarray) -> np.ndarray:
    """``tree`` with the root of ``below`` in place of ``node``."""
    below = below.copy()
    below["left"] = np.where(below["feature"] >= 0, below["left"] + len(tree) - 1, 0)
    out = np.concatenate([tree, below[1:]])
    out[node] = below[0]
    return out
