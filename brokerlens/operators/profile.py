"""Data profiling: shape, per-column counts, describe, missing values,
categorical value tables, box-plot statistics and density curves.

Every multi-column profile is ONE aggregate over the table (a struct per
column inside an array), exploded to long rows afterwards: never one job
per column.

Quantiles: ``exact=True`` uses ``quantiles.wide_quantiles`` (linear
interpolation like pandas, all columns side by side, no row exploded);
``exact=False`` uses ``percentile_approx`` (one pass, state bounded by
``accuracy``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brokerlens.functions.scalar import ratio
from brokerlens.operators.distinct import distinct_counts
from brokerlens.operators.quantiles import wide_quantiles
from brokerlens.sources.schema import columns_by_type


def _q(c: Column, qs, exact: bool, accuracy: int = 100000) -> Column:
    arr = F.array(*[F.lit(float(q)) for q in qs])
    return F.percentile(c, arr) if exact else F.percentile_approx(c, arr, accuracy)


def _long(df: DataFrame, items: list[Column]) -> DataFrame:
    """One aggregate row holding an array of per-column structs -> long rows."""
    return df.agg(F.array(*items).alias("_s")).select(F.explode("_s").alias("_r")).select("_r.*")


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def column_info(df: DataFrame) -> DataFrame:
    """Name, Spark type, kind (numeric / categorical / other) and non-null count."""
    numeric, categorical = columns_by_type(df)
    items = []
    for f in df.schema.fields:
        kind = "numeric" if f.name in numeric else "categorical" if f.name in categorical else "other"
        items.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                              F.lit(kind).alias("kind"), F.count(F.col(f"`{f.name}`")).alias("non_null")))
    return _long(df, items)


def dtype_counts(df: DataFrame) -> DataFrame:
    return column_info(df).groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))


def _quartile_items(df: DataFrame, cols: list[str], qs, names: list[str], exact: bool) -> dict[str, list[Column]]:
    """Per column its quantiles as columns of an aggregate: fitted constants if exact, else sketches."""
    if exact:
        found = wide_quantiles(df, cols, qs)
        return {c: [F.lit(v).cast("double").alias(n) for v, n in zip(found[c], names)] for c in cols}
    out = {}
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        qv = _q(F.when(~F.isnan(x), x), qs, False)
        out[c] = [qv[i].alias(n) for i, n in enumerate(names)]
    return out


def quartiles(df: DataFrame, cols: list[str], qs=(0.25, 0.5, 0.75), exact: bool = True) -> DataFrame:
    """(column, one column per quantile named q25 / q50 / ...)."""
    names = [f"q{int(round(q * 100))}" for q in qs]
    found = _quartile_items(df, cols, qs, names, exact)
    return _long(df, [F.struct(F.lit(c).alias("column"), *found[c]) for c in cols])


def describe_numeric(df: DataFrame, cols: list[str] | None = None, exact: bool = True) -> DataFrame:
    """count, mean, std (n-1), min, 25/50/75 %, max per numeric column, missing values (null, NaN) skipped.

    One aggregate of all columns side by side; exact quantiles come from
    ``quantiles.wide_quantiles``, approximate ones from the same aggregate."""
    cols = cols or columns_by_type(df)[0]
    quart = _quartile_items(df, cols, (0.25, 0.5, 0.75), ["q25", "q50", "q75"], exact)
    items = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)
        items.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                              F.min(x).alias("min"), *quart[c], F.max(x).alias("max")))
    return _long(df, items)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls, rows) for every column, one pass."""
    n = F.count(F.lit(1))
    return _long(df, [F.struct(F.lit(c).alias("column"),
                               F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias("nulls"), n.alias("rows"))
                      for c in df.columns])


def missing_profile(df: DataFrame) -> DataFrame:
    """Columns with nulls: count and percent, most missing first."""
    return (null_counts(df).where(F.col("nulls") > 0)
              .select("column", "nulls", (ratio(F.col("nulls"), F.col("rows")) * F.lit(100.0)).alias("percent"))
              .orderBy(F.desc("nulls"), "column"))


def missing_total(df: DataFrame) -> DataFrame:
    return null_counts(df).agg(F.sum("nulls").alias("missing_cells"))


def completeness(df: DataFrame) -> DataFrame:
    """Non-null share per column (the bar chart of missing-value tools)."""
    return null_counts(df).select("column", (F.lit(1.0) - ratio(F.col("nulls"), F.col("rows"))).alias("completeness"))


def null_patterns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows per null pattern: one character per column, '1' = null."""
    cols = cols or df.columns
    pattern = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c in cols])
    return df.groupBy(pattern.alias("pattern")).agg(F.count(F.lit(1)).alias("count"))


def categorical_summary(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """nunique, nulls and null percent per categorical column."""
    cols = cols or columns_by_type(df)[1]
    missing = null_counts(df.select(*[F.col(f"`{c}`") for c in cols])).select(
        "column", "nulls", (ratio(F.col("nulls"), F.col("rows")) * F.lit(100.0)).alias("null_pct"))
    return distinct_counts(df, cols).join(missing, "column").select("column", "nunique", "nulls", "null_pct")


def categorical_values(df: DataFrame, cols: list[str] | None = None, all_below: int = 20,
                       top: int = 10) -> DataFrame:
    """Value counts per categorical column: every value when the column has
    at most ``all_below`` distinct values, else the ``top`` most frequent.

    Values are unpivoted to (column, value), counted, and ranked per
    column; ``row_number <= k`` lets Spark apply a per-partition group
    limit before the ranking shuffle, so no column's full value list is
    moved to one task."""
    cols = cols or columns_by_type(df)[1]
    longv = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in cols
    ])).alias("_r")).select("_r.*").where(F.col("value").isNotNull())
    counts = longv.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    ranked = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(all_below, top))
    nun = counts.groupBy("column").agg(F.count(F.lit(1)).alias("nunique"))
    return (ranked.join(nun, "column")
                  .where((F.col("nunique") <= all_below) | (F.col("rank") <= top))
                  .select("column", "value", "count", "rank"))


def boxplot_stats(df: DataFrame, cols: list[str] | None = None, whisker: float = 1.5,
                  exact: bool = True) -> DataFrame:
    """q1, median, q3, whiskers (furthest values within 1.5 IQR) and the number of outliers, per numeric column with
    values: the quartiles, then one aggregate of all columns side by side against them."""
    cols = cols or columns_by_type(df)[0]
    if exact:
        found = wide_quantiles(df, cols, (0.25, 0.5, 0.75))
    else:
        found = {r["column"]: [r["q25"], r["q50"], r["q75"]] for r in quartiles(df, cols, exact=False).collect()}    # one row per column
    items = []
    for c in (c for c in cols if found[c][0] is not None):
        x = F.col(f"`{c}`").cast("double")
        x = F.when(~F.isnan(x), x)
        q1, median, q3 = found[c]
        lo, hi = F.lit(q1 - whisker * (q3 - q1)), F.lit(q3 + whisker * (q3 - q1))
        inside = (x >= lo) & (x <= hi)
        items.append(F.struct(F.lit(c).alias("column"), F.lit(q1).alias("q1"), F.lit(median).alias("median"), F.lit(q3).alias("q3"),
                              F.min(F.when(inside, x)).alias("lower_whisker"), F.max(F.when(inside, x)).alias("upper_whisker"),
                              F.count(F.when(~inside, 1)).alias("outliers")))
    if not items:
        return df.sparkSession.createDataFrame([], "column string, q1 double, median double, q3 double, lower_whisker double, "
                                                   "upper_whisker double, outliers long")
    return _long(df, items)


FINE_STEPS = 256      # bins between two points of a density curve


def kde_error_bound(bandwidth: float, step: float, fine: int = FINE_STEPS) -> float:
    """Largest difference of ``kde_curve`` from the sum over all values: the kernel is replaced by its linear interpolation
    between bins of step / fine, which is at most width**2 / 8 times its largest second derivative off."""
    return (step / fine) ** 2 / 8 / (bandwidth ** 3 * (2 * 3.141592653589793) ** 0.5)


def kde_curve(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0, tail_sd: float | None = None, fine: int = FINE_STEPS) -> DataFrame:
    """Gaussian kernel density of ``col`` on ``grid`` points spanning [min - cut*bw, max + cut*bw], bandwidth by
    Scott's rule (n^(-1/5) * sample std); null densities where that is undefined or 0.

    Linear binning: each value is shared by the two nearest of (grid - 1) * fine + 1 equidistant bins, in one
    aggregate with as many rows at most, whatever the number of distinct values.  The curve is the
    discrete convolution of the bins with the kernel, off the exact one by ``kde_error_bound`` at most;
    with fewer distinct values than bins these take their place, and it is exact.
    With ``tail_sd`` the kernel ends at that many bandwidths."""
    import numpy as np
    spark = df.sparkSession
    vals = df.select(F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    n, sd, lo, hi, distinct = vals.agg(F.count(F.lit(1)), F.stddev_samp("x"), F.min("x"), F.max("x"), F.approx_count_distinct("x")).first()
    schema = "point long, x double, density double"
    if not n or not sd:
        at = [lo] * grid if n else [None] * grid
        return spark.createDataFrame([(i, at[i], None) for i in range(grid)], schema)
    bw = sd * n ** -0.2
    first, step = lo - cut * bw, (hi - lo + 2 * cut * bw) / (grid - 1)
    size = (grid - 1) * fine + 1
    points = first + step * np.arange(grid)
    if distinct <= size // 2:
        table = vals.groupBy("x").agg(F.count(F.lit(1)).alias("w")).toArrow()                          # fewer than the bins
        at, weight = table["x"].to_numpy(), table["w"].to_numpy()
    else:
        place = (F.col("x") - F.lit(first)) / F.lit(step / fine)
        binned = vals.select(F.floor(place).cast("long").alias("b"), (place - F.floor(place)).alias("f"))
        table = binned.groupBy("b").agg(F.count(F.lit(1)).alias("w"), F.sum("f").alias("f")).toArrow()  # at most the bins
        b, w, f = np.clip(table["b"].to_numpy(), 0, size - 1), table["w"].to_numpy(), table["f"].to_numpy()
        weight = np.zeros(size + 1)
        np.add.at(weight, b, w - f)
        np.add.at(weight, b + 1, f)
        at, weight = first + step / fine * np.flatnonzero(weight), weight[weight != 0]
    z = (points[:, None] - at[None, :]) / bw
    kernel = np.exp(-0.5 * z ** 2)
    if tail_sd is not None:
        kernel[np.abs(z) > tail_sd] = 0.0
    density = kernel @ weight / (n * bw * (2 * 3.141592653589793) ** 0.5)
    return spark.createDataFrame([(i, float(x), float(d)) for i, (x, d) in enumerate(zip(points, density))], schema)
