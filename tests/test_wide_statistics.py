"""Quantiles and co-moments of many columns side by side, against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brokerlens.operators import profile as P
from brokerlens.operators import stats as ST
from brokerlens.operators.comoments import pearson
from brokerlens.operators.quantiles import wide_quantiles

QS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]


def table(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    cols = {"normal": rng.normal(1e9, 3.0, n), "three": rng.integers(0, 3, n).astype(float), "skew": np.exp(rng.normal(0, 5, n)),
            "mostly_one": np.where(rng.random(n) < 0.999, 1.0, rng.normal(size=n)), "constant": np.full(n, 7.0), "ids": rng.permutation(n).astype(float)}
    rows = [[None if rng.random() < 0.05 else (float("nan") if rng.random() < 0.02 else float(v[i])) for v in cols.values()] + [None] for i in range(n)]
    return rows, [*cols, "empty"], spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [*cols, "empty"])).repartition(5)


@pytest.mark.parametrize("n, accuracy, limit", [(0, 100, 10), (1, 100, 10), (2, 100, 10), (7, 100, 100), (5000, 100, 5), (5000, 20, 50), (20_000, 2000, 4096)])
def test_quantiles_match_numpy(spark, n, accuracy, limit):
    rows, cols, df = table(spark, n)
    got = wide_quantiles(df, cols, QS, accuracy, limit)
    for k, c in enumerate(cols):
        x = [r[k] for r in rows if r[k] is not None and not math.isnan(r[k])]
        want = [float(v) for v in np.quantile(x, QS)] if x else [None] * len(QS)
        assert got[c] == pytest.approx(want, rel=1e-12, abs=1e-12) if x else got[c] == want, c


def test_quantiles_of_infinite_values(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1.0,), (2.0,), (3.0,)], "x double")
    assert wide_quantiles(df, ["x"], [0.0, 0.25, 0.5, 1.0]) == {"x": [float("-inf"), 1.0, 2.0, float("inf")]}


def test_quantile_passes_explode_and_shuffle_no_rows(spark):
    """The aggregates of describe and boxplot see no Generate below them and exchange one row per task."""
    df = spark.range(0, 50_000, 1, 8).select(F.rand(1).alias("a"), F.rand(2).alias("b"))
    for out in (P.describe_numeric(df), P.boxplot_stats(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Generate") == 1 and plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")


def test_profiles_of_columns_without_values(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (float("nan"), None)], "a double, b double")
    assert {r["column"]: (r["count"], r["q50"]) for r in P.describe_numeric(df).collect()} == {"a": (2, 2.0), "b": (0, None)}
    for exact in (True, False):
        assert [r["column"] for r in P.boxplot_stats(df, exact=exact).collect()] == ["a"]
    assert P.boxplot_stats(df.select("b")).collect() == []


def expected_corr(a, b):
    both = [(x, y) for x, y in zip(a, b) if x is not None and y is not None]
    if not both:
        return None
    x, y = np.array(both).T
    if x.min() == x.max() or y.min() == y.max():
        return None
    return float(np.corrcoef(x, y)[0, 1])


def test_seventy_columns_with_nulls(spark):
    """Every row has its own null pattern; columns far from zero, constant ones, and pairs without common rows."""
    rng = np.random.default_rng(3)
    n, p = 600, 70
    base = rng.normal(size=(n, p)) + rng.normal(size=(n, 1)) + np.where(np.arange(p) % 10 == 0, 1e7, 0)
    base[:, 5] = 2.5
    rows = [[None if rng.random() < 0.3 else float(v) for v in r] for r in base]
    for k, r in enumerate(rows):
        r[6 if k % 2 else 7] = None
    cols = [f"c{k}" for k in range(p)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(7)
    got = {(r.feature_x, r.feature_y): r["corr"] for r in ST.correlation_matrix(df, cols).collect()}
    assert len(got) == p * p
    by = list(zip(*rows))
    for i in range(0, p, 3):
        for j in range(p):
            want = expected_corr(by[i], by[j])
            assert (got[cols[i], cols[j]] is None) == (want is None)
            assert want is None or got[cols[i], cols[j]] == pytest.approx(want, abs=1e-7)
            assert got[cols[i], cols[j]] == got[cols[j], cols[i]]
    assert got["c6", "c7"] is None and got["c5", "c0"] is None
    target = {r.feature: r["corr"] for r in ST.target_correlation(df, cols, "c3").collect()}
    assert all(target[c] == pytest.approx(got[c, "c3"], abs=1e-9) if got[c, "c3"] is not None else target[c] is None for c in cols)


def test_infinite_values_stay_in_their_pairs(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 1.0, 2.0), (3.0, 5.0, 4.0), (float("inf"), 1.0, None), (float("nan"), None, 7.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = {(r.feature_x, r.feature_y): r["corr"] for r in pearson(df, ["a", "b", "c"]).collect()}
    assert got["b", "c"] == pytest.approx(expected_corr([2.0, 1.0, 5.0], [1.0, 2.0, 4.0]))
    assert got["a", "b"] is None and got["a", "a"] is None


def test_no_rows(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert {r["corr"] for r in pearson(df, ["a", "b"]).collect()} == {None}
    assert len(pearson(df, ["a", "b"], ["a"]).collect()) == 2


def test_correlation_groups_no_null_patterns(spark):
    df = spark.range(0, 1000).select(*[F.rand(k).alias(f"c{k}") for k in range(20)])
    plan = ST.correlation_matrix(df, df.columns)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "present" not in plan and "Generate" not in plan
