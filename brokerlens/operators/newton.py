"""Many logistic regressions at once: Newton steps for all (k, fold) fits, one pass over the rows a step."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from brokerlens.operators.blocks import sum_over_tasks, unpacked

RIDGE = 1e-8         # per row, keeps the steps finite on separable or repeated features
GAIN = 1e-7          # a fit whose mean loss falls by less is done


def _sizes(p: int, folds: int) -> list[tuple[int, int]]:
    return [(k, f) for k in range(1, p + 1) for f in range(folds)]


def _moments(weights: dict, active: set, p: int, q: int, folds: int):
    """Function over blocks: per fit in order (rows, loss, held-out rows, held-out right, gradient, Hessian)."""
    fits = _sizes(p, folds)

    def run(batches):
        out = [np.zeros(4 + (k + 1) + (k + 1) ** 2) for k, _ in fits]
        seen = False
        for batch in batches:
            for _, X, Y in unpacked(batch, p, q):
                seen = True
                X1 = np.column_stack([np.ones(len(X)), X])
                y, fold = Y[:, 0], Y[:, 1].astype(int)
                for at, (k, f) in enumerate(fits):
                    z = X1[:, :k + 1] @ weights[k, f]
                    own = fold != f
                    out[at][2] += (~own).sum()
                    out[at][3] += ((z > 0) == (y > 0.5))[~own].sum()
                    if (k, f) not in active:
                        continue
                    A, t, z = X1[own, :k + 1], y[own], z[own]
                    mu = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                    out[at][0] += len(t)
                    out[at][1] += (np.logaddexp(0.0, z) - t * z).sum()
                    out[at][4:k + 5] += A.T @ (mu - t)
                    out[at][k + 5:] += ((A * (mu * (1 - mu))[:, None]).T @ A).ravel()
        return np.concatenate(out) if seen else None
    return run


def nested_logistic(blocks: DataFrame, p: int, folds: int, tasks: int, max_passes: int = 15) -> dict[tuple[int, int], tuple[float, np.ndarray]]:
    """{(k, fold): (accuracy on the fold, weights with the constant first)} of a logistic regression on the first k
    of ``p`` columns, fitted on the other folds.  ``blocks`` hold (y, fold) per row, in ``tasks`` partitions; at most ``max_passes`` passes."""
    fits = _sizes(p, folds)
    w = {x: np.zeros(x[0] + 1) for x in fits}
    before, active, right = {}, set(fits), {}
    for step in range(max_passes):
        got = sum_over_tasks(blocks, _moments(w, active, p, 2, folds), tasks)
        if got is None:
            return {}
        at = 0
        for k, f in fits:
            part = got[at:at + 4 + (k + 1) + (k + 1) ** 2]
            at += len(part)
            right[k, f] = part[3] / part[2] if part[2] else math.nan
            if (k, f) not in active:
                continue
            n, loss, g, H = part[0], part[1] / max(part[0], 1), part[4:k + 5], part[k + 5:].reshape(k + 1, k + 1)
            if not n:
                active.discard((k, f))
                continue
            last = before.get((k, f))
            if last is not None and loss > last[0] + 1e-12:
                w[k, f] = (w[k, f] + last[1]) / 2        # too far: half way back, measured in the next pass
                continue
            if last is not None and last[0] - loss < GAIN:
                active.discard((k, f))
                continue
            before[k, f] = (loss, w[k, f].copy())
            w[k, f] = w[k, f] - np.linalg.lstsq(H + RIDGE * n * np.eye(k + 1), g + RIDGE * n * w[k, f], rcond=None)[0]
        if not active:
            break
    return {x: (right[x], w[x]) for x in fits}
