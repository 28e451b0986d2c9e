"""Queries: evaluation of scored messages.

The scored input is deterministic (FIXTURES F4): label = is_ddos,
probability = coalesce(duplicate_rate_per_ip, 0), prediction =
probability > 0.25.  For per-model tables the "models" are that score cut
at 0.15, 0.25 and 0.35, each evaluated on the time-split train and test
parts; trained MLlib models use the same operators (see q_models).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brokerlens.operators import evaluate as EV
from brokerlens.operators.ip_features import FIXTURE_THRESHOLDS as FT
from brokerlens.plans.oracle_sql import hist
from brokerlens.plans.prepare import fixture_labelled
from brokerlens.plans.registry import oq, register
from brokerlens.plans.training import CUTOFF

CUTS = {"t15": 0.15, "t25": 0.25, "t35": 0.35}


def scored(spark, sf, cut=0.25):
    lab = fixture_labelled(spark, sf, FT)
    p = F.coalesce(F.col("duplicate_rate_per_ip"), F.lit(0.0))
    return lab.select("mqtt_message_id", "ts", F.col("is_ddos").alias("label"), p.alias("probability"),
                      (p > F.lit(cut)).cast("int").alias("prediction"))


def model_scores(spark, sf):
    base = scored(spark, sf).drop("prediction")
    part = F.when(F.col("ts").isNull() | (F.col("ts") < F.to_timestamp(F.lit(CUTOFF))), "train").otherwise("test")
    # one row per (message, model): the three cut-offs as an explode, not a join
    cuts = F.array(*[F.struct(F.lit(k).alias("model"), F.lit(v).alias("cut")) for k, v in CUTS.items()])
    return (base.withColumn("part", part).withColumn("m", F.explode(cuts))
                .select("mqtt_message_id", "label", "probability", "part", F.col("m.model").alias("model"),
                        (F.col("probability") > F.col("m.cut")).cast("int").alias("prediction")))


SCORED = """
, scored AS (SELECT mqtt_message_id, ts, is_ddos AS label, coalesce(duplicate_rate_per_ip, 0) AS probability,
                    CASE WHEN coalesce(duplicate_rate_per_ip, 0) > 0.25 THEN 1 ELSE 0 END AS prediction FROM labelled),
cnt AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
               count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
               count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
               count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM scored)"""

Z = "coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0)"


def z(a, b):
    return Z.format(a=a, b=b)


CM = """
, cm AS (SELECT 0 AS label, 0 AS prediction, 'TN' AS cell, tn AS count FROM cnt
         UNION ALL SELECT 0, 1, 'FP', fp FROM cnt UNION ALL SELECT 1, 0, 'FN', fn FROM cnt
         UNION ALL SELECT 1, 1, 'TP', tp FROM cnt)"""


@register("confusion_matrix", oq(SCORED + CM + " SELECT * FROM cm"))
def q_confusion(spark, sf):
    return EV.confusion_matrix(scored(spark, sf))


@register("confusion_percent", oq(SCORED + CM + """
SELECT *, CAST(count AS DOUBLE) / nullif(sum(count) OVER (PARTITION BY label), 0) * 100 AS percent FROM cm"""),
          dbl=("percent",))
def q_confusion_pct(spark, sf):
    return EV.confusion_percent(scored(spark, sf))


@register("binary_metrics", oq(SCORED + f"""
SELECT {z('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {z('tp', 'tp + fp')} AS precision,
       {z('tp', 'tp + fn')} AS recall,
       {z('2.0 * ' + z('tp', 'tp + fp') + ' * ' + z('tp', 'tp + fn'), z('tp', 'tp + fp') + ' + ' + z('tp', 'tp + fn'))} AS f1
FROM cnt"""), dbl=("accuracy", "precision", "recall", "f1"))
def q_binary_metrics(spark, sf):
    return EV.binary_metrics(scored(spark, sf))


@register("rate_metrics", oq(SCORED + f"""
SELECT {z('tp', 'tp + fn')} AS tpr, {z('tn', 'tn + fp')} AS tnr, {z('fp', 'fp + tn')} AS fpr, {z('fn', 'fn + tp')} AS fnr
FROM cnt"""), dbl=("tpr", "tnr", "fpr", "fnr"))
def q_rate_metrics(spark, sf):
    return EV.rate_metrics(scored(spark, sf))


SC = """
, sc AS (SELECT probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
         FROM scored WHERE probability IS NOT NULL AND label IS NOT NULL GROUP BY 1)"""


@register("roc_auc", oq(SCORED + SC + """
, cu AS (SELECT *, sum(neg) OVER (ORDER BY probability) - neg AS below FROM sc)
SELECT CAST(sum(pos * (below + 0.5 * neg)) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0) AS roc_auc FROM cu"""),
          dbl=("roc_auc",))
def q_roc_auc(spark, sf):
    return EV.roc_auc(scored(spark, sf))


@register("roc_curve", oq(SCORED + SC + """
SELECT probability AS threshold,
       coalesce(CAST(sum(neg) OVER (ORDER BY probability DESC) AS DOUBLE) / nullif((SELECT sum(neg) FROM sc), 0), 0) AS fpr,
       coalesce(CAST(sum(pos) OVER (ORDER BY probability DESC) AS DOUBLE) / nullif((SELECT sum(pos) FROM sc), 0), 0) AS tpr
FROM sc UNION ALL SELECT CAST('inf' AS DOUBLE), 0.0, 0.0 WHERE (SELECT count(*) FROM sc) > 0"""), dbl=("threshold", "fpr", "tpr"))
def q_roc_curve(spark, sf):
    return EV.roc_curve(scored(spark, sf))


P1, R1 = z("tp", "tp + fp"), z("tp", "tp + fn")
P0, R0 = z("tn", "tn + fn"), z("tn", "tn + fp")
F11 = z(f"2.0 * {P1} * {R1}", f"{P1} + {R1}")
F10 = z(f"2.0 * {P0} * {R0}", f"{P0} + {R0}")


@register("classification_report", oq(SCORED + f"""
SELECT '0' AS class, {P0} AS precision, {R0} AS recall, {F10} AS f1, tn + fp AS support FROM cnt
UNION ALL SELECT '1', {P1}, {R1}, {F11}, tp + fn FROM cnt
UNION ALL SELECT 'accuracy', NULL, NULL, {z('tp + tn', 'tp + tn + fp + fn')}, tp + tn + fp + fn FROM cnt
UNION ALL SELECT 'macro avg', ({P0} + {P1}) / 2, ({R0} + {R1}) / 2, ({F10} + {F11}) / 2, tp + tn + fp + fn FROM cnt
UNION ALL SELECT 'weighted avg', {z(f'{P0} * (tn + fp) + {P1} * (tp + fn)', 'tp + tn + fp + fn')},
       {z(f'{R0} * (tn + fp) + {R1} * (tp + fn)', 'tp + tn + fp + fn')},
       {z(f'{F10} * (tn + fp) + {F11} * (tp + fn)', 'tp + tn + fp + fn')}, tp + tn + fp + fn FROM cnt"""),
          dbl=("precision", "recall", "f1"))
def q_class_report(spark, sf):
    return EV.classification_report(scored(spark, sf))


@register("probability_histogram", oq(SCORED + hist("probability", "scored", 30, by="label")),
          dbl=("bin_lo", "bin_hi"))
def q_proba_hist(spark, sf):
    return EV.probability_histogram(scored(spark, sf), 30)


MS = f"""
, ms AS (SELECT s.mqtt_message_id, s.label, s.probability,
                CASE WHEN s.ts IS NULL OR s.ts < TIMESTAMP '{CUTOFF}' THEN 'train' ELSE 'test' END AS part, c.model,
                CASE WHEN s.probability > c.cut THEN 1 ELSE 0 END AS prediction
         FROM scored s, (VALUES ('t15', 0.15), ('t25', 0.25), ('t35', 0.35)) c(model, cut)),
mc AS (SELECT model, part, count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
              count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
              count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn,
              count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn FROM ms GROUP BY 1, 2),
mm AS (SELECT model, part, {z('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {P1} AS precision, {R1} AS recall,
              {F11} AS f1 FROM mc),
msc AS (SELECT model, probability, count(*) FILTER (WHERE label = 1) AS pos, count(*) FILTER (WHERE label <> 1) AS neg
        FROM ms WHERE part = 'test' GROUP BY 1, 2),
mau AS (SELECT model, CAST(sum(pos * (below + 0.5 * neg)) AS DOUBLE) / nullif(sum(pos) * sum(neg), 0) AS roc_auc
        FROM (SELECT *, sum(neg) OVER (PARTITION BY model ORDER BY probability) - neg AS below FROM msc) GROUP BY 1),
cmp0 AS (SELECT t.model, t.accuracy, t.precision, t.recall, t.f1, a.roc_auc, r.accuracy AS train_accuracy,
                r.accuracy - t.accuracy AS gap
         FROM mm t JOIN mau a USING (model) LEFT JOIN mm r ON r.model = t.model AND r.part = 'train'
         WHERE t.part = 'test'),
cmp AS (SELECT *, CASE WHEN gap > 0.1 THEN 'overfitting' WHEN gap > 0.05 THEN 'slight overfitting' ELSE 'ok' END AS overfit,
               model = (SELECT first(model ORDER BY f1 DESC, model) FROM cmp0) AS best FROM cmp0)"""
CMP_DBL = ("accuracy", "precision", "recall", "f1", "roc_auc", "train_accuracy", "gap")


def comparison(spark, sf):
    return EV.model_comparison(model_scores(spark, sf))


@register("model_comparison", oq(SCORED + MS + " SELECT * FROM cmp"), dbl=CMP_DBL)
def q_model_comparison(spark, sf):
    return comparison(spark, sf)


@register("overfit_band", oq(SCORED + MS + " SELECT model, train_accuracy, accuracy, gap, overfit FROM cmp"),
          dbl=("train_accuracy", "accuracy", "gap"))
def q_overfit(spark, sf):
    return comparison(spark, sf).select("model", "train_accuracy", "accuracy", "gap", "overfit")


@register("model_ranking", oq(SCORED + MS + """
SELECT model, f1, accuracy, row_number() OVER (ORDER BY f1 DESC, model) AS rank FROM cmp
ORDER BY f1 DESC, model LIMIT 3"""), dbl=("f1", "accuracy"))
def q_ranking(spark, sf):
    return EV.model_ranking(comparison(spark, sf), 3)


@register("model_diagnosis", oq(SCORED + MS + """
SELECT model, part, accuracy, precision, recall, f1,
       CASE WHEN accuracy = 1.0 THEN 'perfect accuracy: check for leakage'
            WHEN accuracy > 0.95 THEN 'very high accuracy: verify' WHEN f1 > 0.8 THEN 'excellent'
            WHEN f1 > 0.6 THEN 'good' ELSE 'needs improvement' END AS diagnosis FROM mm"""),
          dbl=("accuracy", "precision", "recall", "f1"))
def q_diagnosis(spark, sf):
    return EV.model_diagnosis(EV.binary_metrics(model_scores(spark, sf), ["model", "part"]))


@register("model_recommendation", oq(SCORED + MS + """
SELECT model, f1, gap, CASE WHEN f1 > 0.9 AND gap < 0.05 THEN 'ready for production'
                            WHEN gap > 0.1 THEN 'overfitting: regularise or simplify'
                            ELSE 'good, can be improved' END AS recommendation FROM cmp"""), dbl=("f1", "gap"))
def q_recommendation(spark, sf):
    return EV.model_recommendation(comparison(spark, sf))
