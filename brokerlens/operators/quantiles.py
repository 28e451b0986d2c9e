"""Exact quantiles of many columns side by side.

A mergeable sketch per column (``percentile_approx``, all in one aggregate)
brackets every quantile between two values.  One counting pass, again one
aggregate, finds how many rows lie below, on and between the bounds; brackets with
more than ``LIMIT`` values between them are narrowed by another sketch of those
values only.  The few values that remain are collected and the ranks read off.
No row is exploded or shuffled: every pass is a map-side aggregate that returns
one row, whose size depends on the numbers of columns and quantiles alone.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

LIMIT = 4096          # values between two bounds that are collected
ACCURACY = 2000       # of the sketches: a bracket holds about 8 / ACCURACY of the rows
AGGREGATES = 240      # expressions of one aggregate; wider ones are split into several


def _one_row(df: DataFrame, items: list) -> list:
    """Values of the aggregate columns ``items``, in their order."""
    out = []
    for at in range(0, len(items), AGGREGATES):
        out += list(df.agg(*[c.alias(f"v{k}") for k, c in enumerate(items[at:at + AGGREGATES])]).first())
    return out


class _Bracket:
    """A quantile between two values: ``low`` and ``high`` are its 0-based ranks, ``frac`` the weight of the upper one."""

    def __init__(self, x, q: float, n: int):
        self.x, h = x, q * (n - 1)
        self.low, self.high, self.frac = math.floor(h), math.ceil(h), h - math.floor(h)
        self.values = []

    def between(self):
        return F.when((self.x > F.lit(self.a)) & (self.x < F.lit(self.b)), self.x)

    def counts(self):
        a, b = F.lit(self.a), F.lit(self.b)
        return [F.count(F.when(self.x < a, 1)), F.count(F.when(self.x == a, 1)), F.count(self.between()),
                F.count(F.when((self.x == b) & (b > a), 1))]

    def holds(self) -> bool:
        return self.below <= self.low and self.high < self.below + self.on_a + self.inside + self.on_b

    def at(self, rank: int) -> float:
        r = rank - self.below - self.on_a
        return self.a if r < 0 else self.values[r] if r < self.inside else self.b

    def value(self) -> float:
        lo, hi = self.at(self.low), self.at(self.high)
        return lo if lo == hi else lo + (hi - lo) * self.frac


def _around(p: float, accuracy: int) -> list[float]:
    return [min(1.0, max(0.0, p + side * 4.0 / accuracy)) for side in (-1, 1)]


def wide_quantiles(df: DataFrame, cols: list[str], qs, accuracy: int = ACCURACY, limit: int = LIMIT) -> dict[str, list]:
    """{column: [value of each quantile]}, linearly interpolated as pandas does; missing values (null, NaN) are
    skipped, a column without values gives None."""
    qs = [float(q) for q in qs]
    if not cols or not qs:
        return {c: [None] * len(qs) for c in cols}
    # the passes read the columns from executor memory (or disk) instead of computing the input anew; freed below
    values = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in dict.fromkeys(cols)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _wide_quantiles(values, list(dict.fromkeys(cols)), qs, accuracy, limit)
    finally:
        values.unpersist()


def _wide_quantiles(df: DataFrame, cols: list[str], qs: list[float], accuracy: int, limit: int) -> dict[str, list]:
    xs = {c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c in cols}
    probs = F.array(*[F.lit(p) for q in qs for p in _around(q, accuracy)])
    first = _one_row(df, [e for x in xs.values() for e in (F.count(x), F.min(x), F.max(x), F.percentile_approx(x, probs, accuracy))])
    brackets = {}
    for k, (c, x) in enumerate(xs.items()):
        n, least, most, sketch = first[4 * k:4 * k + 4]
        for m, q in enumerate(qs if n else []):
            b = brackets[c, m] = _Bracket(x, q, n)
            b.least, b.most = least, most
            b.a, b.b = (least, most) if n <= limit else (sketch[2 * m], sketch[2 * m + 1])
    todo = list(brackets.values())
    while todo:
        got = _one_row(df, [e for b in todo for e in b.counts()])
        wide = []
        for k, b in enumerate(todo):
            b.below, b.on_a, b.inside, b.on_b = got[4 * k:4 * k + 4]
            if not b.holds():                       # a sketch further off than it promises
                b.a, b.b = b.least, b.most
                wide.append(b)
        narrow = [b for b in todo if b not in wide and b.inside > limit]
        if narrow:
            rank = lambda b, r: min(1.0, max(0.0, (r - b.below - b.on_a) / b.inside))
            ends = [F.percentile_approx(b.between(), F.array(F.lit(_around(rank(b, b.low), accuracy)[0]), F.lit(_around(rank(b, b.high), accuracy)[1])), accuracy)
                    for b in narrow]
            for b, (a, z) in zip(narrow, _one_row(df, ends)):
                # the bounds themselves stay in when the ranks may be theirs
                b.a, b.b = b.a if b.low < b.below + b.on_a else a, b.b if b.high >= b.below + b.on_a + b.inside else z
        todo = wide + narrow
    few = [b for b in brackets.values() if b.inside and not (b.high < b.below + b.on_a or b.low >= b.below + b.on_a + b.inside)]
    for b, values in zip(few, _one_row(df, [F.collect_list(b.between()) for b in few])):
        b.values = sorted(values)
    return {c: [brackets[c, m].value() if (c, m) in brackets else None for m in range(len(qs))] for c in cols}
