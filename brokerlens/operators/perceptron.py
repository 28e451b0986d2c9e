"""Multi-layer perceptron: relu layers, a logistic output, Adam on mini-batches, early stop.

The rows lie as matrix blocks in executor memory.  In an epoch every partition
runs Adam over its mini-batches from the common weights; the weights and both moment
estimates are then averaged by rows (local steps with periodic averaging), so an
epoch is one pass over the data and one exchange of arrays whose size is that of the
network.  With one partition it is plain mini-batch Adam.  Training stops when
the accuracy on the validation rows has not risen by ``TOL`` for ``patience`` epochs, and
the best weights are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.operators.blocks import FAN_IN, matrix_blocks, sum_over_tasks, unpacked

# fixed values: the defaults of the reference's perceptron
RATE, BETA1, BETA2, EPSILON, PENALTY, TOL = 1e-3, 0.9, 0.999, 1e-8, 1e-4, 1e-4
BATCH, VALIDATION, PATIENCE = 200, 0.1, 10

PARTITION_ROWS = 200_000     # training rows of a partition, that is between two averagings
DRIVER_BYTES = 16 << 20      # of the arrays of an epoch that the driver adds up without a stage before


def shapes(layers: list[int]) -> list[tuple]:
    return [s for a, b in zip(layers, layers[1:]) for s in ((a, b), (b,))]


def unflat(w: np.ndarray, layers: list[int]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes(layers):
        n = math.prod(s)
        out.append(w[at:at + n].reshape(s))
        at += n
    return out


def start_weights(layers: list[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(layers, layers[1:]):
        bound = math.sqrt(6.0 / (a + b))
        out += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
    return np.concatenate(out)


def forward(w: np.ndarray, layers: list[int], X: np.ndarray) -> list[np.ndarray]:
    """Values of every layer; the last one is the logit."""
    parts, values = unflat(w, layers), [X]
    for k in range(0, len(parts), 2):
        z = values[-1] @ parts[k] + parts[k + 1]
        values.append(z if k + 2 == len(parts) else np.maximum(z, 0.0))
    return values


class Scratch:
    """Arrays for mini-batches of at most ``rows`` rows, used again by each: new ones of this size cost more than the sums in them."""

    def __init__(self, layers: list[int], rows: int):
        self.values, self.deltas = ([np.empty((rows, k)) for k in layers[1:]] for _ in range(2))
        self.above = [np.empty((rows, k), bool) for k in layers[1:]]
        size = sum(math.prod(s) for s in shapes(layers))
        self.gradient, self.one, self.two = (np.empty(size) for _ in range(3))
        self.parts, self.pulls = unflat(self.gradient, layers), unflat(self.one, layers)


def loss_and_gradient(w: np.ndarray, layers: list[int], X: np.ndarray, y: np.ndarray, penalty: float = PENALTY, scratch: Scratch | None = None):
    """Mean log loss with the penalty on the connections, and its gradient (an array of ``scratch``, if given)."""
    n, s, parts = len(X), scratch or Scratch(layers, len(X)), unflat(w, layers)
    values = [X]
    for k in range(0, len(parts), 2):
        z = np.matmul(values[-1], parts[k], out=s.values[k // 2][:n])
        z += parts[k + 1]
        values.append(z if k + 2 == len(parts) else np.maximum(z, 0.0, out=z))
    z = values[-1][:, 0]
    loss = np.mean(np.logaddexp(0.0, z) - y * z) + penalty / 2 * sum((parts[k] ** 2).sum() for k in range(0, len(parts), 2)) / n
    delta = ((1.0 / (1.0 + np.exp(-np.clip(z, -500, 500))) - y) / n)[:, None]
    for k in range(len(parts) - 2, -1, -2):
        below, pull = values[k // 2], s.pulls[k]
        np.matmul(below.T, delta, out=s.parts[k])
        np.multiply(penalty, parts[k], out=pull)
        pull /= n
        s.parts[k][...] += pull
        np.sum(delta, axis=0, out=s.parts[k + 1])
        if k:
            times = np.multiply if delta.shape[1] == 1 else np.matmul
            delta = times(delta, parts[k].T, out=s.deltas[k // 2 - 1][:n])
            delta *= np.greater(below, 0, out=s.above[k // 2 - 1][:n])
    return loss, s.gradient


def _epoch(state: np.ndarray, layers: list[int], p: int, seed: int, epoch: int, batch_rows: int):
    """Function over a partition's blocks: (rows, loss sum, rows x state) after its mini-batches; state: w, m, v, t."""
    def run(batches):
        size = (len(state) - 1) // 3
        w, m, v, t = state[:size].copy(), state[size:2 * size].copy(), state[2 * size:-1].copy(), state[-1]
        rows, total, s = 0, 0.0, None
        for batch in batches:
            for block, X, Y in unpacked(batch, p):
                s = s or Scratch(layers, batch_rows)
                order = np.random.default_rng([seed, epoch, block]).permutation(len(X))
                X, y = X[order], Y[order, 0]
                for at in range(0, len(X), batch_rows):
                    x = X[at:at + batch_rows]
                    loss, g = loss_and_gradient(w, layers, x, y[at:at + batch_rows], scratch=s)
                    t += 1
                    step = np.subtract(g, m, out=s.one)              # m += (1 - BETA1) * (g - m), and so on, in place
                    step *= 1 - BETA1
                    m += step
                    step = np.multiply(g, g, out=s.one)
                    step -= v
                    step *= 1 - BETA2
                    v += step
                    step = np.multiply(RATE * math.sqrt(1 - BETA2 ** t) / (1 - BETA1 ** t), m, out=s.one)
                    root = np.sqrt(v, out=s.two)
                    root += EPSILON
                    step /= root
                    w -= step
                    rows += len(x)
                    total += loss * len(x)
        return np.concatenate([[rows, total], rows * np.concatenate([w, m, v, [t]])]) if rows else None
    return run


def _right(w: np.ndarray, layers: list[int], p: int):
    def run(batches):
        n = good = 0
        for batch in batches:
            for _, X, Y in unpacked(batch, p):
                n += len(X)
                good += int(((forward(w, layers, X)[-1][:, 0] > 0) == (Y[:, 0] > 0.5)).sum())
        return np.array([n, good], float) if n else None
    return run


class Perceptron:
    """A trained network: ``layers``, ``weights``, and per epoch ``losses`` and ``scores`` (validation accuracy)."""

    def __init__(self, layers, weights, losses, scores):
        self.layers, self.weights, self.losses, self.scores = layers, weights, losses, scores

    def probability(self, vec):
        """Column of the probability of class 1 for a column of feature arrays."""
        w, layers = self.weights, self.layers

        @F.pandas_udf("double")
        def proba(x: pd.Series) -> pd.Series:
            X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, layers[0]))
            return pd.Series(1.0 / (1.0 + np.exp(-np.clip(forward(w, layers, X)[-1][:, 0], -500, 500))))
        return proba(vec)


def train_perceptron(train: DataFrame, vec, label: str, p: int, hidden=(100,), max_iter: int = 200, seed: int = 42, batch: int = BATCH,
                     validation: float = VALIDATION, patience: int = PATIENCE, partition_rows: int = PARTITION_ROWS) -> Perceptron:
    """Fit on the rows of ``train``; ``vec`` is the column of ``p`` standardised features.  With ``validation`` 0 all
    rows are trained on, and the loss decides when to stop."""
    from brokerlens.operators.split import stratified_split
    layers = [p, *hidden, 1]
    rows = train.select(vec.alias("vec"), (F.col(label) == 1).cast("double").alias("y")).where("y IS NOT NULL")
    rows = rows.withColumn("key", F.xxhash64("vec", "y"))
    fitted, held = (rows, None) if not validation else stratified_split(rows, "y", validation, seed, keys=["key"])
    n = rows.count()
    parts = max(1, math.ceil(n / partition_rows))
    checks = max(min(parts, FAN_IN), math.ceil(parts * validation))
    pack = lambda d, m: matrix_blocks(d, F.col("vec"), F.array("y"), F.lit(seed), m)
    blocks, check = pack(fitted, parts), pack(held, checks) if held is not None else None
    size = sum(math.prod(s) for s in shapes(layers))
    state = np.concatenate([start_weights(layers, seed), np.zeros(2 * size + 1)])
    fan_in = max(FAN_IN, DRIVER_BYTES // state.nbytes)
    best, best_at, losses, scores = (-math.inf, state[:size]), 0, [], []
    try:
        for epoch in range(max_iter):
            got = sum_over_tasks(blocks, _epoch(state, layers, p, seed, epoch, batch), parts, fan_in)
            if got is None:
                break
            state = got[2:] / got[0]
            losses.append(float(got[1] / got[0]))
            right = sum_over_tasks(check, _right(state[:size], layers, p), checks) if check is not None else None
            scores.append(float(right[1] / right[0]) if right is not None else -losses[-1])
            if scores[-1] > best[0] + TOL:
                best, best_at = (scores[-1], state[:size]), epoch
            elif scores[-1] > best[0]:
                best = (scores[-1], state[:size])
            if epoch - best_at >= patience:
                break
    finally:
        blocks.unpersist()
        if check is not None:
            check.unpersist()
    return Perceptron(layers, best[1], losses, scores if check is not None else [None] * len(losses))
