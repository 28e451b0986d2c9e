"""Generic building blocks: value counts, top-k, histograms, class crosstabs.

Totals for percentages are scalar subqueries (one small aggregate), never
a window over the whole table: a window without ``partitionBy`` runs in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brokerlens.functions.scalar import ratio


def value_counts(df: DataFrame, col: str, n: int | None = None, percent: bool = False,
                 count_name: str = "count") -> DataFrame:
    """Counts of the non-null values of ``col``, most frequent first
    (ties by value), optionally the top ``n`` and the percent of non-null rows."""
    counts = (df.where(F.col(col).isNotNull()).groupBy(col)
                .agg(F.count(F.lit(1)).alias(count_name)))
    if percent:
        total = counts.agg(F.sum(count_name)).scalar()
        counts = counts.withColumn("percent", ratio(F.col(count_name), total) * F.lit(100.0))
    ordered = counts.orderBy(F.desc(count_name), F.asc(col))
    return ordered.limit(n) if n is not None else ordered


def _bin(x: Column, lo: Column, hi: Column, n: int) -> Column:
    """Bin 1..n of equal width over [lo, hi]; last bin closed; lo == hi is
    widened to [lo - .5, hi + .5] as numpy does."""
    same = lo == hi
    lo2 = F.when(same, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(same, hi + F.lit(0.5)).otherwise(hi)
    b = F.floor(F.lit(float(n)) * (x - lo2) / (hi2 - lo2)) + F.lit(1)
    return F.least(b, F.lit(n).cast("long"))


def _edges(lo: Column, hi: Column, n: int, b: Column):
    same = lo == hi
    lo2 = F.when(same, lo - F.lit(0.5)).otherwise(lo)
    hi2 = F.when(same, hi + F.lit(0.5)).otherwise(hi)
    width = (hi2 - lo2) / F.lit(float(n))
    return (lo2 + (b - F.lit(1)) * width), (lo2 + b * width)


def histogram(df: DataFrame, col: str, bins: int = 20, by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram over min..max of ``col`` (nulls skipped).

    Output ``[by...], bin, bin_lo, bin_hi, count`` with empty bins as 0.
    With ``by`` each group gets its own range.  Bin spines come from
    ``sequence(1, bins)`` per group (bounded by ``bins``), not a cross join.
    """
    by = list(by or [])
    vals = df.select(*by, F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull())
    if not by:
        lo = vals.agg(F.min("x")).scalar()
        hi = vals.agg(F.max("x")).scalar()
        counts = vals.groupBy(_bin(F.col("x"), lo, hi, bins).alias("bin")).agg(
            F.count(F.lit(1)).alias("count"))
        bounds = vals.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    else:
        bounds = vals.groupBy(*by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
        counts = (vals.join(bounds, on=by)
                      .groupBy(*by, _bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))
                      .agg(F.count(F.lit(1)).alias("count")))
    spine = bounds.select(*by, "lo", "hi",
                          F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))).alias("bin"))
    blo, bhi = _edges(F.col("lo"), F.col("hi"), bins, F.col("bin"))
    return (spine.join(counts, on=by + ["bin"], how="left")
                 .select(*by, "bin", blo.alias("bin_lo"), bhi.alias("bin_hi"),
                         F.coalesce(F.col("count"), F.lit(0).cast("long")).alias("count")))


def class_counts(df: DataFrame, keys: list[str], label: str = "is_ddos") -> DataFrame:
    """Rows per key and class, wide: ``normal``, ``ddos`` (0 filled).

    Conditional counts in one aggregate: no pivot value discovery job."""
    return (df.groupBy(*keys)
              .agg(F.count(F.when(F.col(label) == 0, 1)).alias("normal"),
                   F.count(F.when(F.col(label) == 1, 1)).alias("ddos")))


def share_within(df: DataFrame, count_col: str, partition: list[str], name: str = "percent") -> DataFrame:
    """Percent of ``count_col`` within each ``partition`` group of an
    already aggregated (small) table."""
    w = Window.partitionBy(*partition)
    return df.withColumn(name, ratio(F.col(count_col), F.sum(count_col).over(w)) * F.lit(100.0))


def split_join(left: DataFrame, right: DataFrame, key: str, how: str) -> DataFrame:
    """Equi-join on the string column ``key`` with a ``right`` that is grouped by ``key``.

    The right side is compared through an expression of its key, so it gets an
    exchange of its own: grouped and joined in one partitioning, AQE could not
    split the left rows of a hot key (its skew rule needs an exchange on both
    sides).  The extra exchange moves one row per key."""
    other = "_" + key
    while other in left.columns or other in right.columns:
        other = "_" + other
    r = right.withColumn(other, F.concat(F.col(f"`{key}`"), F.lit(""))).drop(key)
    return left.join(r, F.col(f"`{key}`") == F.col(f"`{other}`"), how).drop(other)


def _buckets(order: Column, bounds: Column, heads: Column, step: int) -> Column:
    """Index of the bucket of ``order``: the number of bounds below it.
    A pure function of the value, so every branch of a plan agrees.  Looked
    up in two steps, among every ``step``-th bound and then between two of them."""
    below = lambda arr: F.size(F.filter(arr, lambda b: b < order))
    block = F.greatest(below(heads) - 1, F.lit(0)) * step
    return (block + below(F.slice(bounds, block + 1, F.lit(step)))).cast("int")


def materialize(df: DataFrame) -> DataFrame:
    """Write a (small, already aggregated) table once as Parquet under the
    session's shared checkpoint folder and read it back: every branch of
    the plan that follows reads the same rows, the lineage is cut, so a lost
    executor does not recompute the upstream scan, and the reads stay
    columnar (a ``checkpoint()`` would go through row-serialised RDD files)."""
    import uuid
    from brokerlens.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(df.sparkSession)
    path = f"{base.rstrip('/')}/materialized-{uuid.uuid4().hex}"
    df.write.parquet(path)
    MATERIALIZED.append(path)
    return df.sparkSession.read.parquet(path)


MATERIALIZED: list[str] = []


def release_materialized(spark) -> int:
    """Delete the tables that ``materialize`` wrote so far, once the results that read them are
    done with; how many there were."""
    conf = spark._jsc.hadoopConfiguration()
    n = len(MATERIALIZED)
    while MATERIALIZED:
        p = spark._jvm.org.apache.hadoop.fs.Path(MATERIALIZED.pop())
        p.getFileSystem(conf).delete(p, True)
    return n


def running_sums(df: DataFrame, group: list[str], order: str, cols: list[str],
                 descending: bool = False, parts: int | None = None, materialized: bool = False) -> DataFrame:
    """Add ``cum_<c>``: the sum of ``c`` over the rows of the same ``group``
    whose ``order`` value is <= the current one (>= when ``descending``).

    Distributed prefix sum, no single-task window.  Rows go to value
    buckets whose bounds are approximate quantiles of the order value (one
    scalar subquery, run once per query); each (bucket, group) computes
    local running sums, and the totals of the earlier buckets of the same
    group (a table of at most buckets x groups rows) are added as offsets.
    The bucket is a function of the value alone, so equal values share a
    bucket (ties get one cumulative value, ``rangeBetween``) and the local
    and total branches of the plan agree without a shared shuffle.
    """
    spark = df.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = (F.col(order) if not descending else -F.col(order)).cast("double")
    d = df.withColumn("_ord", key)
    if not materialized:
        d = materialize(d)
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    step = max(1, int(parts ** 0.5))
    found = d.agg(F.percentile_approx("_ord", probs, 10000).alias("b"))
    every = F.filter("b", lambda _, i: i % step == 0)
    bounds = found.select(F.struct(F.col("b").alias("all"), every.alias("heads"))).scalar()
    # the bounds enter as a column (subqueries may not appear inside lambdas)
    d = d.withColumn("_bounds", bounds).withColumn(
        "_pid", _buckets(F.col("_ord"), F.col("_bounds.all"), F.col("_bounds.heads"), step)).drop("_bounds")
    wl = (Window.partitionBy("_pid", *group).orderBy("_ord")
                .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    loc = d.select("*", *[F.sum(c).over(wl).alias(f"_loc_{c}") for c in cols])
    tot = d.groupBy("_pid", *group).agg(*[F.sum(c).alias(f"_tot_{c}") for c in cols])
    wo = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_pid", *group, *[F.coalesce(F.sum(f"_tot_{c}").over(wo), F.lit(0)).alias(f"_off_{c}")
                                       for c in cols])
    out = loc.join(off, on=["_pid", *group])
    return out.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[(F.col(f"_loc_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in cols])


def dense_codes(values: DataFrame, col: str, name: str = "code", group: list[str] | None = None) -> DataFrame:
    """Distinct non-null values of ``col`` numbered 0..n-1 in sort order
    (code-point order for strings), separately per ``group``, computed
    without a global window: the distinct values are materialized, range
    partitioned on (group, value), numbered locally, and offset by a table
    of partition counts."""
    group = list(group or [])
    # the range partition of every row is written down: both branches below
    # read it, so they agree whatever the optimizer reuses or samples anew
    spark = values.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = values.select(*group, col).where(F.col(col).isNotNull()).distinct()
    d = materialize(d.repartitionByRange(parts, *[F.col(g) for g in group], F.col(col))
                     .withColumn("_pid", F.spark_partition_id()))
    d = d.withColumn("_loc", F.row_number().over(Window.partitionBy("_pid", *group).orderBy(col)) - F.lit(1))
    tot = d.groupBy("_pid", *group).agg(F.count(F.lit(1)).alias("_n"))
    off = tot.select("_pid", *group, F.coalesce(F.sum("_n").over(
        Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return d.join(off, ["_pid", *group]).select(*group, col, (F.col("_loc") + F.col("_off")).cast("int").alias(name))


def exact_quantiles(df: DataFrame, group: list[str], col: str, qs, accuracy: int = 10000) -> DataFrame:
    """Exact quantiles (linear interpolation, pandas' default) per ``group``: rows (group..., q,
    value).  Missing values (null, NaN) and null groups are skipped.

    Two passes and no table of all values.  The first brackets each quantile
    by approximate ones a little below and above it (by the smallest and largest
    value where a group is small).  The second counts the rows below the bracket
    and the values inside it, a few in ``accuracy`` of the rows, which are
    materialized; distributed running sums of those counts locate the 0-based
    ranks floor(q (n - 1)) and ceil(q (n - 1)).
    """
    group, qs = list(group), [float(q) for q in qs]
    key = group or ["_all"]
    d = df if group else df.withColumn("_all", F.lit(0))
    d = d.select(*key, F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    around = [min(1.0, max(0.0, q + side * 4.0 / accuracy)) for q in qs for side in (-1, 1)]
    per = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
                              F.percentile_approx("_x", F.array(*[F.lit(p) for p in around]), accuracy).alias("_a"))
    small = F.col("_n") <= 2 * accuracy
    brackets = F.array(*[F.struct(F.lit(q).alias("q"), F.when(small, F.col("_min")).otherwise(F.col("_a")[2 * i]).alias("_from"),
                                  F.when(small, F.col("_max")).otherwise(F.col("_a")[2 * i + 1]).alias("_to"))
                         for i, q in enumerate(qs)])
    per = materialize(per.select(*key, "_n", F.explode(brackets).alias("_b")).select(*key, "_n", "_b.*"))
    near = d.join(per, key).where(F.col("_x") <= F.col("_to"))
    inside = F.when(F.col("_x") >= F.col("_from"), F.col("_x"))
    counts = materialize(near.groupBy(*key, "q", "_n", inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    below = counts.where(F.col("_v").isNull()).select(*key, "q", F.col("_c").alias("_below"))
    cum = running_sums(counts.where(F.col("_v").isNotNull()), [*key, "q"], "_v", ["_c"], materialized=True)
    j = cum.join(below, [*key, "q"], "left")
    h = F.col("q") * (F.col("_n") - F.lit(1)).cast("double")
    lo, hi = F.floor(h), F.ceil(h)
    end = F.coalesce("_below", F.lit(0)) + F.col("cum__c")
    holds = lambda r: (end - F.col("_c") <= r) & (r < end)
    agg = j.groupBy(*key, "q").agg(F.max(F.when(holds(lo), F.col("_v"))).alias("_lo"), F.max(F.when(holds(hi), F.col("_v"))).alias("_hi"),
                                   F.max(h - lo).alias("_f"))
    return agg.select(*group, "q", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f")).alias("value"))
