"""Classifiers (MLlib) trained on the prepared frame, and their reports.

Fixed configurations of the reference, mapped to MLlib:
  tree_simple  depth 10, min leaf 10        tree_deep  depth 20, min leaf 5
  rf_50        50 trees, depth 15           rf_100     100 trees, depth 20
  rf_200       200 trees, depth 25          knn_3/5/10 distance-weighted kNN
  mlp          hidden (100,), max 200 epochs; mlp_100_50 and mlp_150_100_50 have those layers
  naive_bayes  Gaussian                     svm        RBF kernel (random Fourier features)
  logistic     max 1000 iterations
The perceptron (``perceptron``) has relu layers, Adam, a 10 % validation share and
early stop, as the reference's; ``estimator("mlp")`` is MLlib's, which has none of them.
The forests (``forest``) are MLlib's in all choices (bins, Gini, square root of the features, Poisson samples,
pruning), but over equal rows added up; ``estimator("rf_50")`` is MLlib's own.
Differences: trees bin continuous features and have no
min-samples-split; the RBF SVM is approximated by random Fourier features
(Rahimi & Recht, 2007) + LinearSVC with a logistic (Platt) calibration.
Trees use raw features, the other models standardised ones.
"""

from __future__ import annotations

import math
import time
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import (DecisionTreeClassifier, LinearSVC, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes, RandomForestClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART_ROWS = 500_000     # at most, of a partition that MLlib passes over

FORESTS = {"rf_50": (50, 15), "rf_100": (100, 20), "rf_200": (200, 25)}      # trees, depth
TREE_MODELS = {"tree_simple", "tree_deep", *FORESTS}
MODEL_NAMES = ["logistic", "tree_simple", "tree_deep", "knn_3", "knn_5", "knn_10", "rf_50", "rf_100", "rf_200",
               "mlp", "naive_bayes", "svm"]


class OneClassError(ValueError):
    """A model that needs both classes was given one."""


# layers and iterations the reference offers for its perceptron
MLP_LAYERS = [(100,), (100, 50), (150, 100, 50)]
MLP_ITERATIONS = (100, 500)


def mlp_layers(name: str) -> tuple:
    """Hidden layers of a model name: ``mlp`` or ``mlp_<units>_<units>...``."""
    return tuple(int(x) for x in name.split("_")[1:]) or (100,)


def estimator(name: str, n_features: int, seed: int = 42, hidden=(100,), max_iter: int = 200):
    """The MLlib estimator of a named configuration; ``hidden`` layers and ``max_iter`` are the perceptron's."""
    if name == "logistic":
        return LogisticRegression(maxIter=1000, labelCol="label")
    if name == "tree_simple":
        return DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=10, seed=seed, labelCol="label")
    if name == "tree_deep":
        return DecisionTreeClassifier(maxDepth=20, minInstancesPerNode=5, seed=seed, labelCol="label")
    if name in FORESTS:
        trees, depth = FORESTS[name]
        return RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed,
                                      labelCol="label")
    if name == "mlp":
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=max_iter, seed=seed, labelCol="label")
    if name == "naive_bayes":
        return NaiveBayes(modelType="gaussian", labelCol="label")
    raise ValueError(name)


def assemble(df: DataFrame, features: list[str], scale: bool, scaler=None):
    v = VectorAssembler(inputCols=features, outputCol="features_raw", handleInvalid="keep").transform(df)
    if not scale:
        return v.withColumnRenamed("features_raw", "features"), None
    scaler = scaler or StandardScaler(withMean=True, withStd=True, inputCol="features_raw",
                                      outputCol="features").fit(v)
    return scaler.transform(v).drop("features_raw"), scaler


def fitted_vector(train: DataFrame, features: list[str]):
    """Column of the standardised features, with means and deviations of ``train``; a missing value counts as the mean."""
    from brokerlens.operators.knn import standard_vector
    x = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features]
    stats = train.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x)]).first()
    p = range(len(features))
    return standard_vector(features, [stats[f"m{i}"] or 0.0 for i in p], [stats[f"s{i}"] or 1.0 for i in p])


def _prep(train, test, features, label, scale):
    tr = train.withColumn("label", F.col(label).cast("double"))
    te = test.withColumn("label", F.col(label).cast("double"))
    tr, sc = assemble(tr, features, scale)
    te, _ = assemble(te, features, scale, sc)
    return tr, te


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over the cores: a narrow table is small on disk, so that few tasks would read it."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))
    return df.repartition(parts)


def _scored(pred: DataFrame, keys) -> DataFrame:
    return pred.select(*keys, F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"),
                       F.coalesce(F.get(vector_to_array("probability"), 1), F.lit(0.0)).alias("probability"))


class Fitted:
    """A trained classifier with its feature preparation; ``score`` turns
    any part into (keys, label, prediction, probability)."""

    def __init__(self, name, features, label, model=None, scaler=None, train=None, rff=None, seconds=0.0):
        self.name, self.features, self.label = name, features, label
        self.model, self.scaler, self.train, self.rff, self.seconds = model, scaler, train, rff, seconds
        self.dealt = False       # whether the rows to be scored lie evenly already

    def score(self, df: DataFrame, keys=("mqtt_message_id",)) -> DataFrame:
        keys = [k for k in keys if k in df.columns]
        if self.name.startswith("knn_"):
            return knn_predict(self.train, df, self.features, int(self.name.split("_")[1]), self.label, keys)
        if self.name.startswith("mlp"):
            d = df.select(*keys, F.col(self.label).cast("int").alias("label"), self.scaler.alias("vec")).withColumn("probability", self.model.probability(F.col("vec")))
            return d.select(*keys, "label", (F.col("probability") > F.lit(0.5)).cast("int").alias("prediction"), "probability")
        d = df.select(*keys, *self.features, F.col(self.label).cast("double").alias("label"))
        d = d if self.dealt else spread(d)
        if self.name in FORESTS:
            x = F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(math.nan)) for c in self.features])
            d = d.select(*keys, F.col("label").cast("int").alias("label"), self.model.probability(x).alias("probability"))
            return d.select(*keys, "label", (F.col("probability") > F.lit(0.5)).cast("int").alias("prediction"), "probability")
        d, _ = assemble(d, self.features, self.name not in TREE_MODELS, self.scaler)
        if self.name == "svm":
            svc, platt = self.model
            m = svc.transform(self.rff(d)).drop("prediction")
            pred = platt.transform(m.withColumn("mvec", array_to_vector(F.array(vector_to_array("margin_vec")[1]))))
        else:
            pred = self.model.transform(d)
        return _scored(pred, keys)


def mllib_rows(train: DataFrame, features: list[str], label: str) -> DataFrame:
    """The features and ``label`` of the rows, dealt evenly: what MLlib's models are fitted on."""
    return spread(train.select(*features, F.col(label).cast("double").alias("label")))


def fit(train: DataFrame, features: list[str], name: str, label: str = "is_ddos", seed: int = 42, dealt: DataFrame | None = None, **options) -> Fitted:
    """``dealt``: the ``mllib_rows`` of ``train``, if several models are fitted on them."""
    t0 = time.perf_counter()
    if name.startswith("knn_"):  # lazy learner: the training rows are the model
        return Fitted(name, features, label, train=train, seconds=0.0)
    if name.startswith("mlp"):
        from brokerlens.operators.perceptron import train_perceptron
        vec = fitted_vector(train, features)
        model = train_perceptron(train, vec, label, len(features), seed=seed, **{"hidden": mlp_layers(name), **options})
        return Fitted(name, features, label, model, vec, seconds=time.perf_counter() - t0)
    if name in FORESTS:
        from brokerlens.operators.forest import train_forest
        model = train_forest(train, features, label, *FORESTS[name], seed=seed, **options)
        return Fitted(name, features, label, model, seconds=time.perf_counter() - t0)
    if name == "svm":
        rows = train.select(*features, F.col(label).cast("double").alias("label")) if dealt is None else dealt
        from brokerlens.operators.basic import materialize
        _, scaler = assemble(rows, features, True)
        equal = materialize(rows.groupBy(*[F.col(f"`{c}`") for c in features], "label").agg(F.count(F.lit(1)).cast("double").alias("weight")))
        tr, _ = assemble(spread(equal), features, True, scaler)
        if tr.select("label").distinct().limit(2).count() < 2:
            raise OneClassError("svm needs both classes in the training part")
        rff = _rff(len(features), seed)
        trz = rff(tr).persist()
        svc = LinearSVC(maxIter=100, regParam=0.0, labelCol="label", weightCol="weight", rawPredictionCol="margin_vec").fit(trz)
        platt_in = svc.transform(trz).drop("prediction").withColumn(
            "mvec", array_to_vector(F.array(vector_to_array("margin_vec")[1])))
        platt = LogisticRegression(labelCol="label", weightCol="weight", featuresCol="mvec").fit(platt_in)
        trz.unpersist()
        return Fitted(name, features, label, (svc, platt), scaler, rff=rff, seconds=time.perf_counter() - t0)
    tr, scaler = assemble(mllib_rows(train, features, label) if dealt is None else dealt, features, name not in TREE_MODELS)
    model = estimator(name, len(features), seed, **options).fit(tr)
    return Fitted(name, features, label, model, scaler, seconds=time.perf_counter() - t0)


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], name: str, label: str = "is_ddos",
                keys=("mqtt_message_id",), seed: int = 42):
    """Train ``name`` on ``train``; return (test predictions as
    (keys, label, prediction, probability), fitted model, seconds)."""
    f = fit(train, features, name, label, seed)
    return f.score(test, keys), f.model, f.seconds


# ---- RBF SVM by random Fourier features -------------------------------------------------
def _rff(p: int, seed: int, n_components: int = 100):
    """Column map z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), gamma =
    1 / p (features are standardised, so this is sklearn's 'scale' gamma).
    Vectorised per Arrow batch: one matrix product per batch."""
    from pyspark.sql.functions import pandas_udf
    rng = np.random.default_rng(seed)
    W = rng.normal(0.0, np.sqrt(2.0 / p), size=(n_components, p))
    b = rng.uniform(0, 2 * np.pi, size=n_components)
    scale = np.sqrt(2.0 / n_components)

    @pandas_udf("array<double>")
    def rff_udf(x: pd.Series) -> pd.Series:
        X = np.stack(x.to_numpy()) if len(x) else np.zeros((0, p))
        Z = scale * np.cos(X @ W.T + b)
        return pd.Series(list(Z))

    def apply(df: DataFrame) -> DataFrame:
        return df.withColumn("features", array_to_vector(rff_udf(vector_to_array("features"))))
    return apply


# ---- distance-weighted kNN ------------------------------------------------------------------------
def knn_sample(train: DataFrame, features: list[str], label: str, limit: int, order: str = "mqtt_message_id") -> DataFrame:
    """At most ``limit`` training rows: all if they are that few, else of each class its share, the rows with
    the lowest hash of their id and features."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if total <= limit:
        return train
    key = F.xxhash64(*[F.col(c) for c in ([order] if order in train.columns else []) + features])
    out = None
    for y, n in sorted(counts.items(), key=lambda c: (c[0] is None, c[0] or 0)):
        of_class = train.where(F.col(label).eqNullSafe(F.lit(y))).withColumn("_key", key)
        of_class = of_class.orderBy("_key", *features).limit(max(1, n * limit // total)).drop("_key")
        out = of_class if out is None else out.union(of_class)
    return out


def knn_train_rows(train: DataFrame, features: list[str], label: str, limit: int, order: str = "mqtt_message_id"):
    """The features and labels of ``knn_sample`` as numpy arrays."""
    rows = knn_sample(train, features, label, limit, order).select(*[F.col(c).cast("double") for c in features], F.col(label).cast("int")).collect()
    X = np.array([[np.nan if v is None else v for v in r[:-1]] for r in rows], float).reshape(len(rows), len(features))
    return X, np.array([r[-1] or 0 for r in rows], int)


def knn_predict(train: DataFrame, test: DataFrame, features: list[str], k: int, label: str = "is_ddos",
                keys=("mqtt_message_id",), max_train: int | None = None) -> DataFrame:
    """k nearest neighbours (Euclidean, standardised with train statistics), weights 1/d; zero
    distances take all the weight; rows equally far at the k-th place share it.

    Exact over all training rows (``knn``), whatever their number.  Only with ``max_train`` the training
    rows are a sample, stratified by class.  A missing value counts as the mean."""
    return knn_predict_each(train, [test], features, [k], label, keys, max_train)[k][0]


def knn_predict_each(train: DataFrame, tests: list[DataFrame], features: list[str], ks: list[int], label: str = "is_ddos",
                     keys=("mqtt_message_id",), max_train: int | None = None) -> dict[int, list[DataFrame]]:
    """{k: predictions of every part} of ``knn_predict``: the neighbours for the largest k are searched once, for all parts together."""
    from brokerlens.operators import knn
    from brokerlens.operators.basic import materialize
    p = len(features)
    vec = fitted_vector(train, features).alias("vec")
    known = train if max_train is None else knn_sample(train, features, label, max_train)
    points = materialize(known.select(vec, (F.col(label) == 1).cast("long").alias("y")).groupBy("vec").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")))
    rows = [materialize(t.select(*keys, F.col(label).cast("int").alias("label"), vec)) for t in tests]
    queries = reduce(DataFrame.union, [r.select("vec") for r in rows]).distinct()
    known = not points.isEmpty()
    each = list(dict.fromkeys(ks))
    voted = knn.votes(knn.neighbour_counts(points, queries, max(ks), p), each) if known else \
        queries.select("vec", *[F.lit(None).cast("double").alias(f"p{k}") for k in each])
    voted = materialize(voted) if len(rows) > 1 else voted
    # compared through an expression, so that the rows of a frequent vector can be split
    voted = voted.withColumn("_vec", F.concat("vec", F.array().cast("array<double>"))).drop("vec")
    rows = [r.join(voted, F.col("vec") == F.col("_vec"), "left").select(*keys, "label", *[f"p{k}" for k in each]) for r in rows]
    rows = [materialize(r) for r in rows] if len(each) > 1 else rows
    return {k: [r.select(*keys, "label", F.col(f"p{k}").alias("probability"), (F.col(f"p{k}") > F.lit(0.5)).cast("int").alias("prediction")) for r in rows] for k in each}


# ---- model reports ---------------------------------------------------------------------------------
def loss_curve(spark: SparkSession, model) -> DataFrame:
    """Training loss and validation accuracy of each epoch of a perceptron."""
    rows = [(i, loss, score) for i, (loss, score) in enumerate(zip(model.losses, model.scores))]
    return spark.createDataFrame(rows, "iteration int, loss double, validation_accuracy double")


def tree_importance(spark: SparkSession, model, features: list[str], top: int = 15) -> DataFrame:
    imp = model.featureImportances.toArray()
    rows = sorted(((f, float(imp[i])) for i, f in enumerate(features)), key=lambda r: (-r[1], r[0]))[:top]
    return spark.createDataFrame(rows, "feature string, importance double")


def forest_importance_std(spark: SparkSession, model, features: list[str], top: int = 20) -> DataFrame:
    mean, per_tree = model.importances()
    std = per_tree.std(axis=0)
    rows = sorted(((f, float(mean[i]), float(std[i])) for i, f in enumerate(features)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:top], "feature string, importance double, std double")


def forest_details(spark: SparkSession, model, name: str) -> DataFrame:
    return spark.createDataFrame([(name, len(model.trees), model.depth, len(model.cuts), model.classes, model.nodes)],
                                 "model string, n_trees int, max_depth int, n_features int, n_classes int, total_nodes int")


# ---- selection of k by cross-validated logistic regression ---------------------------------------
def elbow_k(train: DataFrame, ranked_features: list[str], folds: int = 5, max_k: int = 30, label: str = "is_ddos",
            seed: int = 42) -> DataFrame:
    """For k = 1..min(p, max_k): mean accuracy of a logistic regression over ``folds`` stratified hash folds using
    the k best-ranked features.  All fits take their Newton steps together, one pass over the rows a step (``newton``)."""
    from brokerlens.operators.blocks import matrix_blocks
    from brokerlens.operators.newton import nested_logistic
    from brokerlens.operators.split import with_folds
    spark = train.sparkSession
    features = ranked_features[:max_k]
    p = len(features)
    if not p:
        return spark.createDataFrame([], "k int, cv_accuracy double, best boolean")
    base = with_folds(train, folds, seed, label=label).where(F.col(label).isNotNull())
    y = F.array((F.col(label) == 1).cast("double"), F.col("fold").cast("double"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = matrix_blocks(base, fitted_vector(train, features), y, F.lit(seed), tasks)
    fits = nested_logistic(blocks, p, folds, tasks)
    blocks.unpersist()
    rows = []
    for k in range(1, p + 1):
        accs = [fits[k, f][0] for f in range(folds) if (k, f) in fits and not np.isnan(fits[k, f][0])]
        rows.append((k, float(np.mean(accs)) if accs else None))
    best = max(rows, key=lambda r: (-1.0 if r[1] is None else r[1], -r[0]))[0]
    return spark.createDataFrame([(k, a, k == best) for k, a in rows], "k int, cv_accuracy double, best boolean")


def cross_validate(train: DataFrame, features: list[str], name: str, folds: int = 3, label: str = "is_ddos",
                   seed: int = 42) -> DataFrame:
    """Per stratified fold: train and test accuracy and F1, and the gap (train - test accuracy); a
    last row with a null fold holds the means."""
    from brokerlens.operators.evaluate import binary_metrics
    from brokerlens.operators.split import with_folds
    spark = train.sparkSession
    base = with_folds(train, folds, seed, label=label).persist()
    rows = []
    for f in range(folds):
        tr, te = base.where(F.col("fold") != f), base.where(F.col("fold") == f)
        fitted = fit(tr, features, name, label, seed)    # one fit, scored on both sides
        sc_te, sc_tr = fitted.score(te), fitted.score(tr)
        mt = binary_metrics(sc_te).first()
        mr = binary_metrics(sc_tr).first()
        rows.append((name, f, mr["accuracy"], mt["accuracy"], mr["f1"], mt["f1"], mr["accuracy"] - mt["accuracy"]))
    base.unpersist()
    rows.append((name, None, *[float(np.mean([r[i] for r in rows])) for i in range(2, 7)]))
    return spark.createDataFrame(rows, "model string, fold int, train_accuracy double, test_accuracy double, "
                                       "train_f1 double, test_f1 double, gap double")


def compare_models(train: DataFrame, test: DataFrame, features: list[str], names=MODEL_NAMES,
                   label: str = "is_ddos", folds: int | None = None) -> DataFrame:
    """Fit each model once, score both parts in one pass, and reduce its scores to
    counts before the next model; the measures of all models are then taken
    together (the E3 comparison flow).  Returns
    model x (test accuracy, precision, recall, f1, roc_auc, train
    accuracy, cross-validated means, gap, overfit band, seconds, best).

    With ``folds`` the gap is the cross-validated one (mean train minus mean
    test accuracy over the folds), otherwise that of the hold-out."""
    from brokerlens.operators.basic import materialize
    from brokerlens.operators.evaluate import binary_metrics, overfit_band, roc_auc
    spark = train.sparkSession
    train, test = train.persist(), test.persist()
    both = reduce(DataFrame.unionAll, [d.select(F.lit(part).alias("_part"), *features, label) for part, d in (("test", test), ("train", train))])
    ks = [int(n.split("_")[1]) for n in names if n.startswith("knn_")]
    by_k = {}
    if ks:       # neighbours are those of a vector, so that equal rows are joined with them once
        equal = materialize(both.groupBy("_part", *features, label).agg(F.count(F.lit(1)).alias("_n")))
        by_k = knn_predict_each(train, [equal], features, ks, label, ("_part", "_n"))
    # dealt and sorted once for all models: equal rows lie together, which a forest's batches score once
    dealt = mllib_rows(train, features, label).persist()
    scored = spread(both).sortWithinPartitions(*features).persist()
    fitted, failed, counts, binned = [], {}, [], None
    for name in names:
        try:
            if name in FORESTS and binned is None:
                from brokerlens.operators.forest import binned_rows
                binned = binned_rows(train, features, label)
            f = fit(train, features, name, label, dealt=dealt, **({"binned": binned} if name in FORESTS else {}))
            cv = cross_validate(train, features, name, folds, label).where("fold IS NULL").first() if folds else None
        except OneClassError as e:  # named case: reported, not fatal
            failed[name] = str(e).splitlines()[0][:200]
            continue
        f.dealt = True
        s = by_k[int(name.split("_")[1])][0] if name.startswith("knn_") else f.score(scored, ("_part",)).withColumn("_n", F.lit(1).cast("long"))
        s = s.groupBy("_part", "label", "prediction", "probability").agg(F.sum("_n").alias("_n"))
        counts.append(materialize(s.withColumn("model", F.lit(name))))
        fitted.append((name, f.seconds, cv))
    measures, auc, done = {}, {}, {}
    if counts:
        every = reduce(DataFrame.unionAll, counts)
        measures = {(r["model"], r["_part"]): r for r in binary_metrics(every, ["model", "_part"], "_n").collect()}
        auc = {r["model"]: r["roc_auc"] for r in roc_auc(every.where("_part = 'test'"), ["model"], "_n").collect()}
    nothing = dict.fromkeys(("accuracy", "precision", "recall", "f1"), 0.0)       # of a part without rows
    for name, seconds, cv in fitted:
        mt, acc_tr = measures.get((name, "test"), nothing), measures.get((name, "train"), nothing)["accuracy"]
        cv_means = (cv["train_accuracy"], cv["test_accuracy"], cv["gap"]) if cv else (None, None, acc_tr - mt["accuracy"])
        done[name] = (name, mt["accuracy"], mt["precision"], mt["recall"], mt["f1"], auc.get(name), acc_tr, *cv_means, float(seconds), None)
    rows = [done.get(name) or (name, *[None] * 10, failed[name]) for name in names]
    for d in (train, test, dealt, scored, *([binned[1]] if binned else [])):
        d.unpersist()
    df = spark.createDataFrame(rows, "model string, accuracy double, precision double, recall double, f1 double, "
                                     "roc_auc double, train_accuracy double, cv_train_accuracy double, "
                                     "cv_test_accuracy double, gap double, train_seconds double, error string")
    best = min(rows, key=lambda r: (-(r[4] or 0.0), r[0]))[0]
    return df.withColumn("overfit", overfit_band(F.col("gap"))).withColumn("best", F.col("model") == best)
