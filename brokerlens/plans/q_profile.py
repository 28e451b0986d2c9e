"""Queries: profiling, cleaning, scalar functions and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens.functions import scalar as S
from brokerlens.functions import temporal as TM
from brokerlens.operators import cleaning as C
from brokerlens.operators import distinct as DI
from brokerlens.operators import profile as P
from brokerlens.operators import split as SP
from brokerlens.operators.basic import histogram, value_counts
from brokerlens.operators.ip_features import FIXTURE_THRESHOLDS as FT
from brokerlens.plans.oracle_sql import hist, vc
from brokerlens.plans.prepare import fixture_labelled
from brokerlens.plans.registry import oq, register
from brokerlens.sources.fixture import mqtt_messages

# The labelled fixture table: column, Spark type, kind.
LABELLED = [
    ("mqtt_message_id", "bigint", "numeric"), ("ts", "timestamp", "other"),
    ("general_ip", "string", "categorical"), ("general_mac", "string", "categorical"),
    ("general_device_name", "string", "categorical"), ("mqtt_topic", "string", "categorical"),
    ("mqtt_message_type", "string", "categorical"), ("mqtt_message_value", "string", "categorical"),
    ("mqtt_qos", "int", "numeric"), ("mqtt_duplicate", "boolean", "categorical"),
    ("mqtt_retained", "boolean", "categorical"), ("value", "double", "numeric"),
    ("hour", "int", "numeric"), ("day_of_week", "int", "numeric"), ("day", "int", "numeric"),
    ("month", "int", "numeric"), ("day_name", "string", "categorical"),
    ("requests_per_ip", "bigint", "numeric"), ("duplicate_rate_per_ip", "double", "numeric"),
    ("unique_topics_per_ip", "bigint", "numeric"), ("avg_qos_per_ip", "double", "numeric"),
    ("retained_rate_per_ip", "double", "numeric"), ("is_ddos", "int", "numeric"),
]
ALL = [c for c, _, _ in LABELLED]
NUM = [c for c, _, k in LABELLED if k == "numeric"]
CAT = [c for c, _, k in LABELLED if k == "categorical"]
DBL_COLS = ("value", "duplicate_rate_per_ip", "avg_qos_per_ip", "retained_rate_per_ip")
IMPUTE = ["mqtt_message_id", "value", "requests_per_ip", "duplicate_rate_per_ip", "unique_topics_per_ip"]


def labelled(spark, sf):
    return fixture_labelled(spark, sf, FT)


def union(parts):
    return "\nUNION ALL ".join(parts)


@register("preview", oq("SELECT * FROM mqtt ORDER BY mqtt_message_id NULLS LAST, ts LIMIT 10"), dbl=("value",))
def q_preview(spark, sf):
    return mqtt_messages(spark, sf).orderBy(F.asc_nulls_last("mqtt_message_id"), "ts").limit(10)


@register("table_shape", oq(f"SELECT count(*) AS n_rows, {len(ALL)} AS n_columns FROM labelled"))
def q_shape(spark, sf):
    return P.table_shape(labelled(spark, sf))


@register("column_info", oq(union(
    f"SELECT '{c}' AS column, '{t}' AS dtype, '{k}' AS kind, count({c}) AS non_null FROM labelled"
    for c, t, k in LABELLED)))
def q_column_info(spark, sf):
    return P.column_info(labelled(spark, sf))


KINDS = "(VALUES " + ", ".join(f"('{c}', '{t}', '{k}')" for c, t, k in LABELLED) + ") AS kinds(\"column\", dtype, kind)"


@register("dtype_counts", oq(f"SELECT dtype, count(*) AS n_columns FROM {KINDS} GROUP BY dtype"))
def q_dtype_counts(spark, sf):
    return P.dtype_counts(labelled(spark, sf))


@register("columns_by_type", oq(f'SELECT "column", kind FROM {KINDS}'))
def q_columns_by_type(spark, sf):
    """Numeric / categorical grouping of the labelled table's columns."""
    return P.column_info(labelled(spark, sf)).select("column", "kind")


@register("describe_numeric", oq(union(
    f"""SELECT '{c}' AS column, count({c}) AS count, avg(CAST({c} AS DOUBLE)) AS mean,
       stddev_samp(CAST({c} AS DOUBLE)) AS std, CAST(min({c}) AS DOUBLE) AS min,
       quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q25, quantile_cont(CAST({c} AS DOUBLE), 0.5) AS q50,
       quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q75, CAST(max({c}) AS DOUBLE) AS max FROM labelled"""
    for c in NUM)), dbl=("mean", "std", "min", "q25", "q50", "q75", "max"))
def q_describe(spark, sf):
    return P.describe_numeric(labelled(spark, sf), NUM)


NULLS_SQL = ", nc AS (" + union(
    f"SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(*) AS rows FROM labelled"
    for c in ALL) + ")"


@register("missing_profile", oq(NULLS_SQL + """
SELECT "column", nulls, CAST(nulls AS DOUBLE) * 100 / rows AS percent FROM nc WHERE nulls > 0"""), dbl=("percent",))
def q_missing(spark, sf):
    return P.missing_profile(labelled(spark, sf))


@register("missing_total", oq(NULLS_SQL + " SELECT CAST(sum(nulls) AS BIGINT) AS missing_cells FROM nc"))
def q_missing_total(spark, sf):
    return P.missing_total(labelled(spark, sf))


@register("completeness", oq(NULLS_SQL + ' SELECT "column", 1.0 - CAST(nulls AS DOUBLE) / rows AS completeness FROM nc'),
          dbl=("completeness",))
def q_completeness(spark, sf):
    return P.completeness(labelled(spark, sf))


@register("null_patterns", oq("SELECT concat(" + ", ".join(
    f"CASE WHEN {c} IS NULL THEN '1' ELSE '0' END" for c in ALL) + ") AS pattern, count(*) AS count FROM labelled GROUP BY 1"))
def q_null_patterns(spark, sf):
    return P.null_patterns(labelled(spark, sf))


@register("categorical_profile", oq(union(
    f"""SELECT '{c}' AS column, count(DISTINCT {c}) AS nunique, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
       CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) * 100 / count(*) AS null_pct FROM labelled"""
    for c in CAT)), dbl=("null_pct",))
def q_cat_profile(spark, sf):
    return P.categorical_summary(labelled(spark, sf), CAT)


@register("categorical_values", oq(", lv AS (" + union(
    f"SELECT '{c}' AS column, CAST({c} AS VARCHAR) AS value FROM labelled WHERE {c} IS NOT NULL" for c in CAT) + """),
cnt AS (SELECT "column", value, count(*) AS count FROM lv GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank,
              count(*) OVER (PARTITION BY "column") AS nunique FROM cnt)
SELECT "column", value, count, CAST(rank AS INTEGER) AS rank FROM rk WHERE nunique <= 20 OR rank <= 10"""))
def q_cat_values(spark, sf):
    return P.categorical_values(labelled(spark, sf), CAT)


@register("value_counts", oq(vc("mqtt_qos", "mqtt", 20, percent=True)), dbl=("percent",))
def q_value_counts(spark, sf):
    return value_counts(mqtt_messages(spark, sf), "mqtt_qos", 20, percent=True)


@register("histogram", oq(hist("value", "mqtt", 20)), dbl=("bin_lo", "bin_hi"))
def q_histogram(spark, sf):
    return histogram(mqtt_messages(spark, sf), "value", 20)


@register("kde_curve", oq("""
, v AS (SELECT CAST(value AS DOUBLE) AS x FROM mqtt WHERE value IS NOT NULL),
st AS (SELECT count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS bw, min(x) AS lo, max(x) AS hi FROM v),
g AS (SELECT range AS point, lo - 3 * bw + range * ((hi - lo + 6 * bw) / 199.0) AS x FROM st, range(0, 200))
SELECT g.point, g.x, sum(exp(-0.5 * pow((g.x - v.x) / st.bw, 2))) / (st.n * st.bw * sqrt(2 * pi())) AS density
FROM g, v, st GROUP BY g.point, g.x, st.n, st.bw"""), dbl=("x", "density"))
def q_kde(spark, sf):
    return P.kde_curve(mqtt_messages(spark, sf), "value", 200)


@register("boxplot_stats", oq(", lv AS (" + union(
    f"SELECT '{c}' AS column, CAST({c} AS DOUBLE) AS x FROM labelled WHERE {c} IS NOT NULL" for c in NUM) + """),
qt AS (SELECT "column", quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
       FROM lv GROUP BY 1)
SELECT "column", q1, median, q3,
       min(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS lower_whisker,
       max(x) FILTER (WHERE x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
       count(*) FILTER (WHERE NOT (x >= q1 - 1.5 * (q3 - q1) AND x <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM lv JOIN qt USING ("column") GROUP BY "column", q1, median, q3"""),
          dbl=("q1", "median", "q3", "lower_whisker", "upper_whisker"))
def q_boxplot(spark, sf):
    return P.boxplot_stats(labelled(spark, sf), NUM)


# ---- cleaning ------------------------------------------------------------------
@register("low_cardinality_columns", oq(", nu AS (" + union(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS nunique FROM labelled" for c in ALL) + """)
SELECT "column", nunique, nunique < 10 AS crosstab, nunique <= 15 AS plot, nunique <= 20 AS all_values FROM nu"""))
def q_low_card(spark, sf):
    nu = DI.distinct_counts(labelled(spark, sf))
    return nu.select("column", "nunique", (F.col("nunique") < 10).alias("crosstab"),
                     (F.col("nunique") <= 15).alias("plot"), (F.col("nunique") <= 20).alias("all_values"))


@register("bounded_cardinality", oq(", nu AS (" + union(
    f"SELECT '{c}' AS column, count(DISTINCT {c}) AS n FROM labelled" for c in ALL) + """)
SELECT "column", least(n, 21) AS nunique, n > 20 AS more FROM nu"""))
def q_bounded_cardinality(spark, sf):
    """Distinct values of every column, exact up to 20: the decisions at 10, 15 and 20 need no more."""
    return DI.bounded_cardinality(labelled(spark, sf))


@register("drop_sparse_columns", oq(NULLS_SQL + ' SELECT "column", nulls, nulls > 50 AS drop FROM nc'))
def q_sparse(spark, sf):
    return C.sparse_columns(labelled(spark, sf), 50)


@register("drop_constant_columns", oq(union(
    f"SELECT '{c}' AS column, coalesce(min({c}) = max({c}), true) AS constant FROM labelled" for c in ALL)))
def q_constant(spark, sf):
    return C.constant_columns(labelled(spark, sf))


# the columns of the fixture at sf0.01 with more than 50 nulls
SPARSE = ["mqtt_message_id", "general_ip", "mqtt_message_value", "requests_per_ip", "duplicate_rate_per_ip", "unique_topics_per_ip",
          "avg_qos_per_ip", "retained_rate_per_ip"]


@register("without_sparse_columns", oq("SELECT * EXCLUDE (" + ", ".join(SPARSE) + ") FROM labelled"), dbl=("value",))
def q_without_sparse(spark, sf):
    """The table without the columns of more than 50 nulls."""
    return C.drop_sparse_columns(labelled(spark, sf), 50)


@register("without_constant_columns", oq("SELECT * EXCLUDE (month) FROM labelled"), dbl=DBL_COLS)
def q_without_constant(spark, sf):
    """The table without constant columns (the fixture covers one month)."""
    return C.drop_constant_columns(labelled(spark, sf))


@register("drop_excluded", oq("SELECT * EXCLUDE (" + ", ".join(
    c for c in C.EXCLUDED if c in ALL) + ") FROM labelled"), dbl=DBL_COLS)
def q_drop_excluded(spark, sf):
    return C.drop_excluded(labelled(spark, sf))


@register("select_available", oq("SELECT " + ", ".join(C.MODEL_FEATURES) + " FROM labelled"),
          dbl=("duplicate_rate_per_ip",))
def q_select_available(spark, sf):
    return C.select_available(labelled(spark, sf), C.MODEL_FEATURES + ["avg_payload_entropy"])


@register("fill_missing_category", oq("SELECT mqtt_message_id, " + ", ".join(
    f"coalesce({c}, 'MISSING') AS {c}" for c, t, _ in LABELLED if t == "string") + " FROM labelled"))
def q_fill_missing(spark, sf):
    strings = [c for c, t, _ in LABELLED if t == "string"]
    return C.fill_missing_category(labelled(spark, sf).select("mqtt_message_id", *strings), strings)


@register("impute_median", oq("SELECT " + ", ".join(
    f"coalesce(CAST({c} AS DOUBLE), (SELECT median(CAST({c} AS DOUBLE)) FROM labelled)) AS {c}" for c in IMPUTE)
    + " FROM labelled"), dbl=tuple(IMPUTE))
def q_impute(spark, sf):
    df = labelled(spark, sf).select(*IMPUTE)
    return C.impute_median(df, C.fit_medians(df, IMPUTE))


@register("replace_infinite", oq("SELECT mqtt_message_id, " + ", ".join(
    f"CASE WHEN isinf({c}) THEN NULL ELSE {c} END AS {c}" for c in DBL_COLS) + " FROM labelled"), dbl=DBL_COLS)
def q_replace_inf(spark, sf):
    return C.replace_infinite(labelled(spark, sf).select("mqtt_message_id", *DBL_COLS))


@register("count_infinite", oq("SELECT " + " + ".join(
    f"count(*) FILTER (WHERE isinf({c}))" for c in DBL_COLS) + " AS n_infinite FROM labelled"))
def q_count_inf(spark, sf):
    return C.count_infinite(labelled(spark, sf), list(DBL_COLS))


@register("class_name", oq("""
SELECT mqtt_message_id, is_ddos, CASE is_ddos WHEN 1 THEN 'DDoS' WHEN 0 THEN 'Normal' END AS class_name FROM labelled"""))
def q_class_name(spark, sf):
    return labelled(spark, sf).select("mqtt_message_id", "is_ddos", S.class_name().alias("class_name"))


@register("filter_attack", oq("SELECT mqtt_message_id, general_ip, is_ddos FROM labelled WHERE is_ddos = 1"))
def q_filter_attack(spark, sf):
    return C.filter_class(labelled(spark, sf), 1).select("mqtt_message_id", "general_ip", "is_ddos")


@register("filter_normal", oq("SELECT mqtt_message_id, general_ip, is_ddos FROM labelled WHERE is_ddos = 0"))
def q_filter_normal(spark, sf):
    return C.filter_class(labelled(spark, sf), 0).select("mqtt_message_id", "general_ip", "is_ddos")


# ---- scalar functions -------------------------------------------------------------
RAW_TS_SQL = """, raw AS (SELECT mqtt_message_id, CASE WHEN mqtt_message_value IS NULL THEN 'not a date'
                 ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS "@timestamp" FROM mqtt)"""


def raw_timestamps(spark, sf):
    """Stand-in input: ISO text of ``ts``, with unreadable text where the
    payload is null."""
    m = mqtt_messages(spark, sf)
    return m.select("mqtt_message_id", F.when(F.col("mqtt_message_value").isNull(), F.lit("not a date"))
                    .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("@timestamp"))


@register("parse_timestamp", oq(RAW_TS_SQL + """
SELECT mqtt_message_id, "@timestamp", try_strptime("@timestamp", '%Y-%m-%dT%H:%M:%SZ') AS timestamp_parsed FROM raw"""))
def q_parse_ts(spark, sf):
    return raw_timestamps(spark, sf).withColumn("timestamp_parsed", TM.parse_timestamp("@timestamp"))


@register("parse_timestamp_strict", oq(RAW_TS_SQL + """
SELECT mqtt_message_id, "@timestamp", strptime("@timestamp", '%Y-%m-%dT%H:%M:%SZ') AS timestamp_parsed FROM raw
WHERE "@timestamp" <> 'not a date'"""))
def q_parse_ts_strict(spark, sf):
    """Strict parse of the readable rows (unreadable text would fail the query)."""
    raw = raw_timestamps(spark, sf).where(F.col("@timestamp") != "not a date")
    return raw.withColumn("timestamp_parsed", TM.parse_timestamp_strict("@timestamp"))


@register("temporal_features", oq("SELECT mqtt_message_id, hour, day_of_week, day, month, day_name FROM labelled"))
def q_temporal(spark, sf):
    return TM.temporal_features(mqtt_messages(spark, sf)).select(
        "mqtt_message_id", "hour", "day_of_week", "day", "month", "day_name")


@register("expand_datetime", oq("""
SELECT mqtt_message_id, CAST(year(ts) AS INTEGER) AS ts_year, CAST(month(ts) AS INTEGER) AS ts_month,
       CAST(day(ts) AS INTEGER) AS ts_day, CAST(hour(ts) AS INTEGER) AS ts_hour,
       CAST(isodow(ts) - 1 AS INTEGER) AS ts_dayofweek FROM mqtt"""))
def q_expand_dt(spark, sf):
    return TM.expand_datetime(mqtt_messages(spark, sf).select("mqtt_message_id", "ts"))


@register("calendar_date", oq("SELECT mqtt_message_id, CAST(ts AS DATE) AS date FROM mqtt"))
def q_calendar_date(spark, sf):
    return mqtt_messages(spark, sf).select("mqtt_message_id", TM.calendar_date("ts").alias("date"))


@register("message_length", oq("""
SELECT mqtt_message_id, CAST(length(mqtt_message_value) AS INTEGER) AS message_length,
       mqtt_message_value IS NOT NULL AS has_message FROM mqtt"""))
def q_message_length(spark, sf):
    return mqtt_messages(spark, sf).select("mqtt_message_id", S.message_length().alias("message_length"),
                                           S.has_message().alias("has_message"))


@register("day_order", oq("SELECT DISTINCT day_of_week, day_name FROM labelled WHERE day_of_week IS NOT NULL"))
def q_day_order(spark, sf):
    return (TM.temporal_features(mqtt_messages(spark, sf)).where(F.col("day_of_week").isNotNull())
              .select("day_of_week", "day_name").distinct().orderBy("day_of_week"))


# ---- splits ---------------------------------------------------------------------------
@register("random_split")
def q_random_split(spark, sf):
    """Part of each message under a repeatable 80 / 20 hash split."""
    return SP.with_split(labelled(spark, sf), 0.2, 42).select("mqtt_message_id", "general_ip", "is_ddos", "split")


@register("random_split_sizes", oq("""
SELECT 'test' AS split, CAST(ceil(count(*) * 0.2) AS BIGINT) AS count FROM labelled
UNION ALL SELECT 'train', count(*) - CAST(ceil(count(*) * 0.2) AS BIGINT) FROM labelled"""))
def q_random_split_sizes(spark, sf):
    """Rows of both parts of a random split of exact size."""
    train, test = SP.random_split(labelled(spark, sf), 0.2, 42, exact=True)
    return SP.recombine(train.select(F.lit("train").alias("split")), test.select(F.lit("test").alias("split"))).groupBy("split").count()


@register("stratified_split")
def q_stratified_split(spark, sf):
    train, test = SP.stratified_split(labelled(spark, sf), "is_ddos", 0.2, 42)
    return (train.select("mqtt_message_id", "is_ddos", F.lit("train").alias("split"))
            .unionByName(test.select("mqtt_message_id", "is_ddos", F.lit("test").alias("split"))))


@register("split_summary", oq(""", of_class AS (SELECT is_ddos, count(*) AS n, CAST(round(count(*) * 0.2) AS BIGINT) AS tested FROM labelled GROUP BY is_ddos),
of_part AS (SELECT 'test' AS part, is_ddos, tested AS count FROM of_class
            UNION ALL SELECT 'train', is_ddos, n - tested FROM of_class)
SELECT part, is_ddos, count, 100.0 * count / sum(count) OVER (PARTITION BY part) AS percent FROM of_part WHERE count > 0"""), dbl=("percent",))
def q_split_summary(spark, sf):
    train, test = SP.stratified_split(labelled(spark, sf), "is_ddos", 0.2, 42)
    return SP.split_summary(train, test)


@register("recombine", oq("SELECT mqtt_message_id, general_ip, is_ddos FROM labelled"))
def q_recombine(spark, sf):
    """Split, then union the parts again: the whole table comes back."""
    train, test = SP.random_split(labelled(spark, sf), 0.2, 42)
    return SP.recombine(train.select("mqtt_message_id", "general_ip", "is_ddos"),
                        test.select("mqtt_message_id", "general_ip", "is_ddos"))


@register("has_message", oq("SELECT mqtt_message_id, mqtt_message_value IS NOT NULL AS has_message FROM mqtt"))
def q_has_message(spark, sf):
    return mqtt_messages(spark, sf).select("mqtt_message_id", S.has_message().alias("has_message"))


ALIGN_TRAIN = ["mqtt_qos", "hour", "requests_per_ip", "avg_qos_per_ip", "day"]


@register("align_columns", oq("""
SELECT mqtt_qos, hour, requests_per_ip, 0 AS avg_qos_per_ip, day FROM labelled
WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'"""))
def q_align(spark, sf):
    """Test part whose frame lacks ``avg_qos_per_ip`` (and has extra columns),
    aligned to the train part's column order: absent -> 0, extra dropped."""
    lab = labelled(spark, sf)
    test = lab.where(F.col("ts") >= F.to_timestamp(F.lit("2024-01-25 00:00:00"))).drop("avg_qos_per_ip")
    return C.align_columns(test, ALIGN_TRAIN)
