"""Queries: encoding, scaling, correlation, ANOVA selection, leakage."""

from __future__ import annotations

from brokerlens.operators import leakage as L
from brokerlens.operators import stats as ST
from brokerlens.operators.cleaning import MODEL_FEATURES
from brokerlens.operators.ip_features import FIXTURE_THRESHOLDS as FT
from brokerlens.plans.prepare import fixture_labelled
from brokerlens.plans.registry import oq, register
from brokerlens.plans.training import CUTOFF, prepared_parts

F10 = MODEL_FEATURES
CORR_COLS = ["mqtt_message_id", "mqtt_qos", "mqtt_duplicate", "mqtt_retained", "value", "hour", "day_of_week",
             "day", "month", "requests_per_ip", "duplicate_rate_per_ip", "unique_topics_per_ip", "avg_qos_per_ip",
             "retained_rate_per_ip", "is_ddos"]
ENC_COLS = ["mqtt_message_type", "day_name", "mqtt_duplicate", "general_device_name"]


def labelled(spark, sf):
    return fixture_labelled(spark, sf, FT)


def parts(spark, sf):
    return prepared_parts(labelled(spark, sf), cutoff=CUTOFF)


def union(parts_):
    return "\nUNION ALL ".join(parts_)


def txt(c):
    if c.split(".")[-1] == "mqtt_duplicate":
        return f"coalesce(CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END, 'MISSING')"
    return f"coalesce(CAST({c} AS VARCHAR), 'MISSING')"


# DuckDB: feature frame, train-fitted medians, parts
PREP = ", feat AS (SELECT mqtt_message_id, ts, " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" for c in F10) + f""", is_ddos,
       CASE WHEN ts < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS part FROM labelled),
med AS (SELECT """ + ", ".join(f"median({c}) FILTER (WHERE NOT isinf({c})) AS {c}" for c in F10) + """
        FROM feat WHERE part = 'train'),
clean AS (SELECT f.mqtt_message_id, f.ts, f.is_ddos, f.part, """ + ", ".join(
    f"coalesce(CASE WHEN isinf(f.{c}) THEN NULL ELSE f.{c} END, med.{c}) AS {c}" for c in F10) + """
          FROM feat f, med),
train AS (SELECT * FROM clean WHERE part = 'train'),
test AS (SELECT * FROM clean WHERE part = 'test')"""


def enc_map_sql(cols, src):
    return union(
        f"""SELECT '{c}' AS "column", v AS value, CAST(dense_rank() OVER (ORDER BY v) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT {txt(c)} AS v FROM {src} UNION SELECT 'MISSING')""" for c in cols)


@register("encoding_map", oq(", emap AS (" + enc_map_sql(ENC_COLS, "labelled") + ") SELECT * FROM emap"))
def q_encoding_map(spark, sf):
    return ST.encoding_map(labelled(spark, sf), ENC_COLS)


@register("label_encode", oq(", emap AS (" + enc_map_sql(ENC_COLS, "labelled") + ") SELECT l.mqtt_message_id, " + ", ".join(
    f"(SELECT code FROM emap WHERE \"column\" = '{c}' AND value = {txt('l.' + c)}) AS {c}_encoded" for c in ENC_COLS)
    + " FROM labelled l"))
def q_label_encode(spark, sf):
    df = labelled(spark, sf).select("mqtt_message_id", *ENC_COLS)
    return ST.label_encode(df, ENC_COLS)


APPLY_COLS = ["general_ip", "mqtt_topic"]


@register("label_encode_apply", oq(f"""
, tr AS (SELECT * FROM labelled WHERE ts IS NULL OR ts < TIMESTAMP '{CUTOFF}'),
te AS (SELECT * FROM labelled WHERE ts >= TIMESTAMP '{CUTOFF}'),
emap AS (""" + enc_map_sql(APPLY_COLS, "tr") + ") SELECT t.mqtt_message_id, " + ", ".join(
    f"coalesce((SELECT code FROM emap WHERE \"column\" = '{c}' AND value = {txt('t.' + c)}), "
    f"(SELECT code FROM emap WHERE \"column\" = '{c}' AND value = 'MISSING')) AS {c}_encoded" for c in APPLY_COLS)
    + " FROM te t"))
def q_label_encode_apply(spark, sf):
    from pyspark.sql import functions as F
    df = labelled(spark, sf).select("mqtt_message_id", "ts", *APPLY_COLS)
    cut = F.to_timestamp(F.lit(CUTOFF))
    tr, te = df.where(F.col("ts") < cut), df.where(F.col("ts") >= cut)
    return ST.label_encode_apply(te, ST.encoding_map(tr, APPLY_COLS), APPLY_COLS).drop("ts")


@register("standardize", oq(PREP + ", sc AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}" for c in F10)
    + " FROM train) SELECT mqtt_message_id, " + ", ".join(f"({c} - m_{c}) / s_{c} AS {c}" for c in F10)
    + " FROM test, sc"), dbl=tuple(F10))
def q_standardize(spark, sf):
    tr, te, feats = parts(spark, sf)
    return ST.standardize(te.select("mqtt_message_id", *feats), ST.fit_scaler(tr, feats), feats)


PEARSON = ("covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / nullif(stddev_pop(CASE WHEN {b} IS NOT NULL THEN "
           "CAST({a} AS DOUBLE) END) * stddev_pop(CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END), 0)")


@register("correlation_matrix", oq(", cm AS (" + union(
    f"SELECT '{a}' AS feature_x, '{b}' AS feature_y, {PEARSON.format(a=a, b=b)} AS corr FROM labelled"
    for a in CORR_COLS for b in CORR_COLS) + ") SELECT * FROM cm"), dbl=("corr",))
def q_corr_matrix(spark, sf):
    return ST.correlation_matrix(labelled(spark, sf), CORR_COLS)


TC = ", tc AS (" + union(
    f"SELECT '{a}' AS feature, {PEARSON.format(a=a, b='is_ddos')} AS corr FROM labelled" for a in CORR_COLS) + ")"


@register("target_correlation", oq(TC + " SELECT * FROM tc"), dbl=("corr",))
def q_target_corr(spark, sf):
    return ST.target_correlation(labelled(spark, sf), CORR_COLS)


@register("top_positive_correlations", oq(TC + " SELECT * FROM tc WHERE corr > 0 ORDER BY corr DESC, feature LIMIT 15"),
          dbl=("corr",))
def q_top_pos(spark, sf):
    return ST.top_correlations(labelled(spark, sf), CORR_COLS, positive=True)


@register("top_negative_correlations", oq(TC + " SELECT * FROM tc WHERE corr < 0 ORDER BY corr, feature LIMIT 15"),
          dbl=("corr",))
def q_top_neg(spark, sf):
    return ST.top_correlations(labelled(spark, sf), CORR_COLS, positive=False)


ANOVA = PREP + ", lf AS (" + union(f"SELECT '{c}' AS feature, {c} AS x, is_ddos AS label FROM train" for c in F10) + """),
per AS (SELECT feature, label, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM lf
        WHERE x IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
tot AS (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS gm FROM per GROUP BY 1),
fs AS (SELECT p.feature, CASE WHEN sum(n * v) > 0 THEN (sum(n * pow(m - gm, 2)) / nullif(k - 1, 0)) / (sum(n * v) / nullif(nn - k, 0)) END AS f_score
       FROM per p JOIN tot t USING (feature) GROUP BY p.feature, k, nn)"""


@register("anova_f", oq(ANOVA + " SELECT * FROM fs"), dbl=("f_score",))
def q_anova(spark, sf):
    tr, _, feats = parts(spark, sf)
    return ST.anova_f(tr, feats)


@register("select_k_best", oq(ANOVA + " SELECT * FROM fs WHERE f_score IS NOT NULL ORDER BY f_score DESC, feature LIMIT 5"),
          dbl=("f_score",))
def q_select_k_best(spark, sf):
    tr, _, feats = parts(spark, sf)
    return ST.select_k_best(ST.anova_f(tr, feats), 5)


@register("feature_importance_percent", oq(ANOVA + """
, sel AS (SELECT * FROM fs WHERE f_score IS NOT NULL ORDER BY f_score DESC, feature LIMIT 5)
SELECT feature, f_score, f_score * 100 / (SELECT sum(f_score) FROM sel) AS importance_pct FROM sel"""),
          dbl=("f_score", "importance_pct"))
def q_importance_pct(spark, sf):
    tr, _, feats = parts(spark, sf)
    return ST.feature_importance_percent(ST.select_k_best(ST.anova_f(tr, feats), 5))


@register("feature_reduction", oq(ANOVA + """
SELECT 10 AS n_features, 5 AS n_selected, 50.0 AS reduction_pct FROM (SELECT 1 FROM fs LIMIT 1)"""), dbl=("reduction_pct",))
def q_feature_reduction(spark, sf):
    """How much smaller the selected feature set is."""
    tr, _, feats = parts(spark, sf)
    return ST.feature_reduction(ST.select_k_best(ST.anova_f(tr, feats), 5), len(feats))


@register("f_score_tier", oq(ANOVA + """
, s AS (SELECT * FROM fs WHERE f_score IS NOT NULL),
p AS (SELECT quantile_cont(f_score, 0.75) AS p75, quantile_cont(f_score, 0.5) AS p50 FROM s)
SELECT feature, f_score, CASE WHEN f_score > p75 THEN 'red' WHEN f_score > p50 THEN 'orange' ELSE 'blue' END AS tier
FROM s, p"""), dbl=("f_score",))
def q_f_tier(spark, sf):
    tr, _, feats = parts(spark, sf)
    return ST.f_score_tier(ST.anova_f(tr, feats))


# ---- leakage -------------------------------------------------------------------------
TCT = ", tct AS (" + union(
    f"SELECT '{a}' AS feature, abs({PEARSON.format(a=a, b='is_ddos')}) AS correlation FROM train" for a in F10) + ")"


@register("leak_high_corr", oq(PREP + TCT + """
SELECT feature, correlation, CASE WHEN correlation > 0.99 THEN 'CRITICAL' ELSE 'HIGH' END AS severity
FROM tct WHERE correlation > 0.95"""), dbl=("correlation",))
def q_leak_corr(spark, sf):
    tr, _, feats = parts(spark, sf)
    return L.leak_high_corr(tr, feats)


VAR = ", vr AS (" + union(f"SELECT '{c}' AS feature, var_samp({c}) AS variance FROM train" for c in F10) + ")"


@register("leak_zero_variance", oq(PREP + VAR + " SELECT * FROM vr WHERE variance < 1e-10"), dbl=("variance",))
def q_leak_var(spark, sf):
    tr, _, feats = parts(spark, sf)
    return L.leak_zero_variance(tr, feats)


AUC = ", alf AS (" + union(f"SELECT '{c}' AS feature, {c} AS x, is_ddos AS label FROM train" for c in F10) + """),
aper AS (SELECT feature, x, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
         FROM alf WHERE x IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2),
acum AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY x) - neg AS below FROM aper),
aagg AS (SELECT feature, sum(pos * (below + 0.5 * neg)) AS u, sum(pos) AS n_pos, sum(neg) AS n_neg,
                count(*) AS n_values FROM acum GROUP BY 1),
fauc AS (SELECT feature, CAST(u AS DOUBLE) / nullif(n_pos * n_neg, 0) AS auc, n_values FROM aagg)"""


@register("feature_auc", oq(PREP + AUC + " SELECT * FROM fauc"), dbl=("auc",))
def q_feature_auc(spark, sf):
    tr, _, feats = parts(spark, sf)
    return L.feature_auc(tr, feats)


@register("leak_perfect_auc", oq(PREP + AUC + """
SELECT feature, auc, 'CRITICAL' AS severity FROM fauc WHERE n_values > 1 AND (auc > 0.99 OR auc < 0.01)"""),
          dbl=("auc",))
def q_leak_auc(spark, sf):
    tr, _, feats = parts(spark, sf)
    return L.leak_perfect_auc(tr, feats)


OVL = (", dtr AS (" + union(f"SELECT DISTINCT '{c}' AS feature, {c} AS x FROM train" for c in F10) + "),"
       + " dte AS (" + union(f"SELECT DISTINCT '{c}' AS feature, {c} AS x FROM test" for c in F10) + """),
ov AS (SELECT f.feature, coalesce(a.n, 0) AS n_unique_train, coalesce(b.n, 0) AS n_unique_test,
              CAST(coalesce(s.n, 0) AS DOUBLE) / greatest(coalesce(b.n, 0), 1) AS overlap_ratio
       FROM (SELECT DISTINCT feature FROM dtr UNION SELECT DISTINCT feature FROM dte) f
       LEFT JOIN (SELECT feature, count(*) AS n FROM dtr GROUP BY 1) a ON a.feature = f.feature
       LEFT JOIN (SELECT feature, count(*) AS n FROM dte GROUP BY 1) b ON b.feature = f.feature
       LEFT JOIN (SELECT dtr.feature, count(*) AS n FROM dtr JOIN dte ON dtr.feature = dte.feature
                  AND dtr.x IS NOT DISTINCT FROM dte.x GROUP BY 1) s ON s.feature = f.feature)""")


@register("value_overlap", oq(PREP + OVL + " SELECT * FROM ov"), dbl=("overlap_ratio",))
def q_overlap(spark, sf):
    tr, te, feats = parts(spark, sf)
    return L.value_overlap(tr, te, feats)


SAME = PREP + OVL + ", mo AS (" + union(
    f"""SELECT '{c}' AS feature, (SELECT avg({c}) FROM train) AS train_mean, (SELECT avg({c}) FROM test) AS test_mean,
       (SELECT stddev_samp({c}) FROM train) AS train_std, (SELECT stddev_samp({c}) FROM test) AS test_std"""
    for c in F10) + """),
sd AS (SELECT mo.feature,
              CASE WHEN train_std > 0 AND test_std > 0 THEN abs(train_mean - test_mean) / train_std END AS mean_diff_ratio,
              CASE WHEN train_std > 0 AND test_std > 0 THEN abs(train_std - test_std) / train_std END AS std_diff_ratio,
              overlap_ratio, train_mean, test_mean, train_std, test_std, n_unique_train, n_unique_test
       FROM mo JOIN ov USING (feature)),
sdf AS (SELECT *, coalesce(mean_diff_ratio < 0.005 AND std_diff_ratio < 0.005 AND overlap_ratio > 0.995, false)
                  AS suspicious FROM sd)"""


@register("leak_same_distribution", oq(SAME + " SELECT * FROM sdf"),
          dbl=("mean_diff_ratio", "std_diff_ratio", "overlap_ratio", "train_mean", "test_mean", "train_std", "test_std"))
def q_same_dist(spark, sf):
    tr, te, feats = parts(spark, sf)
    return L.leak_same_distribution(tr, te, feats, only_flagged=False)


@register("leak_report", oq(SAME + TCT + VAR + AUC.replace(", alf AS", ", alf AS", 1) + """
SELECT 'high_correlation' AS "check", feature, correlation AS value,
       CASE WHEN correlation > 0.99 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM tct WHERE correlation > 0.95
UNION ALL SELECT 'perfect_predictor', feature, auc, 'CRITICAL' FROM fauc WHERE n_values > 1 AND (auc > 0.99 OR auc < 0.01)
UNION ALL SELECT 'same_distribution', feature, overlap_ratio, 'WARNING' FROM sdf WHERE suspicious
UNION ALL SELECT 'zero_variance', feature, variance, 'CLEANING' FROM vr WHERE variance < 1e-10"""), dbl=("value",))
def q_leak_report(spark, sf):
    tr, te, feats = parts(spark, sf)
    return L.leak_report(tr, te, feats)


# the only feature the report condemns on the fixture is the constant month
KEPT9 = [c for c in F10 if c != "month"]


@register("remove_leaky_features", oq(PREP + "\nSELECT mqtt_message_id, ts, " + ", ".join(KEPT9) + ", is_ddos FROM train"),
          dbl=tuple(KEPT9))
def q_remove_leaky(spark, sf):
    """Training part without the features the leakage report condemns."""
    tr, te, feats = parts(spark, sf)
    return L.remove_leaky_features(tr, L.leak_report(tr, te, feats))


@register("remove_leaky_standardized", oq(PREP + "\nSELECT mqtt_message_id, is_ddos, " + ", ".join(
    f"({c} - (SELECT avg({c}) FROM train)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM train) AS {c}"
    for c in KEPT9) + " FROM test"), dbl=tuple(KEPT9))
def q_remove_leaky_standardized(spark, sf):
    """Test part without the condemned features, standardised anew with the training part."""
    tr, te, feats = parts(spark, sf)
    _, test, kept = L.remove_and_standardize(tr, te, feats, L.leak_report(tr, te, feats))
    return test.select("mqtt_message_id", "is_ddos", *kept)


@register("single_class_check", oq(PREP + """
SELECT count(DISTINCT is_ddos) AS n_classes, count(DISTINCT is_ddos) < 2 AS single_class FROM test"""))
def q_single_class(spark, sf):
    _, te, _ = parts(spark, sf)
    return L.single_class_check(te)
