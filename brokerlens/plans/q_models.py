"""Queries: PCA and classifiers (rows-only checks; numbers are pinned by
unit tests against numpy)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from brokerlens.operators import evaluate as EV
from brokerlens.operators import models as M
from brokerlens.operators import pca as PC
from brokerlens.operators.cleaning import constant_columns
from brokerlens.operators.ip_features import FIXTURE_THRESHOLDS as FT
from brokerlens.operators.stats import anova_f
from brokerlens.plans.prepare import fixture_labelled
from brokerlens.plans.registry import register
from brokerlens.plans.training import prepared_parts


def parts(spark, sf):
    """Cleaned train / test parts of a stratified hold-out and the non-constant features of train."""
    tr, te, feats = prepared_parts(fixture_labelled(spark, sf, FT))
    const = {r["column"] for r in constant_columns(tr, feats).where("constant").collect()}
    return tr, te, [f for f in feats if f not in const]


def pca_fit(spark, sf, standardize=True, k=None):
    tr, _, feats = parts(spark, sf)
    return tr, PC.fit_pca(tr, feats, k=k, standardize=standardize)


@register("pca_variance")
def q_pca_variance(spark, sf):
    return PC.pca_variance(spark, pca_fit(spark, sf)[1])


@register("pca_components_needed")
def q_pca_needed(spark, sf):
    return PC.pca_components_needed(spark, pca_fit(spark, sf)[1])


@register("pca_project")
def q_pca_project(spark, sf):
    tr, fit = pca_fit(spark, sf)
    return PC.pca_project(tr, fit, 2)


@register("pca_project_unscaled")
def q_pca_project_unscaled(spark, sf):
    """2-D projection of the centred but unscaled features."""
    tr, fit = pca_fit(spark, sf, standardize=False)
    return PC.pca_project(tr, fit, 2)


@register("pca_loadings")
def q_pca_loadings(spark, sf):
    return PC.pca_loadings(spark, pca_fit(spark, sf)[1], top=15)


@register("pca_contribution_percent")
def q_pca_contrib(spark, sf):
    return PC.pca_contribution_percent(spark, pca_fit(spark, sf)[1], 15)


@register("pca_heatmap_top20")
def q_pca_heatmap(spark, sf):
    return PC.pca_heatmap_top(spark, pca_fit(spark, sf)[1], 20)


@register("pca_circle")
def q_pca_circle(spark, sf):
    return PC.pca_circle(spark, pca_fit(spark, sf)[1])


@register("pca_reduced_dataset")
def q_pca_reduced(spark, sf):
    tr, _, feats = parts(spark, sf)
    return PC.pca_reduced_dataset(tr, feats, 0.90)[0]


@register("pca_reduction")
def q_pca_reduction(spark, sf):
    """Components that hold 90 % of the variance, and how much smaller the data set is with them."""
    tr, _, feats = parts(spark, sf)
    fit = PC.fit_pca(tr, feats)
    return PC.pca_reduction(spark, fit, 0.90)


def _model_query(name):
    def run(spark, sf):
        tr, te, feats = parts(spark, sf)
        scored, _, _ = M.fit_predict(tr, te, feats, name)
        return scored
    run.__doc__ = f"Test-part predictions (label, prediction, probability) of the {name} model."
    return run


# the three layer sets of the reference's perceptron: mlp has (100,)
for _name in [*M.MODEL_NAMES, "mlp_100_50", "mlp_150_100_50"]:
    register(f"model_{_name}")(_model_query(_name))


@register("loss_curve")
def q_loss_curve(spark, sf):
    """Training loss and validation accuracy of the perceptron's epochs."""
    tr, te, feats = parts(spark, sf)
    _, model, _ = M.fit_predict(tr, te, feats, "mlp")
    return M.loss_curve(spark, model)


@register("tree_importance")
def q_tree_importance(spark, sf):
    tr, te, feats = parts(spark, sf)
    _, model, _ = M.fit_predict(tr, te, feats, "tree_simple")
    return M.tree_importance(spark, model, feats, 15)


@register("forest_importance_std")
def q_forest_importance(spark, sf):
    tr, te, feats = parts(spark, sf)
    _, model, _ = M.fit_predict(tr, te, feats, "rf_50")
    return M.forest_importance_std(spark, model, feats, 20)


@register("forest_details")
def q_forest_details(spark, sf):
    tr, te, feats = parts(spark, sf)
    _, model, _ = M.fit_predict(tr, te, feats, "rf_50")
    return M.forest_details(spark, model, "rf_50")


@register("elbow_k")
def q_elbow(spark, sf):
    """Cross-validated logistic accuracy for the k best ANOVA features."""
    tr, _, feats = parts(spark, sf)
    ranked = [r["feature"] for r in anova_f(tr, feats).where("f_score IS NOT NULL")
              .orderBy(F.desc("f_score"), "feature").collect()]
    return M.elbow_k(tr, ranked, folds=5)


@register("cross_validate")
def q_cross_validate(spark, sf):
    tr, _, feats = parts(spark, sf)
    return M.cross_validate(tr, feats, "tree_simple", folds=3)


@register("model_comparison_mllib")
def q_comparison_mllib(spark, sf):
    """Every classifier trained once on the train part and scored on both
    parts; the comparison table has the best model by test F1."""
    tr, te, feats = parts(spark, sf)
    return M.compare_models(tr, te, feats, M.MODEL_NAMES)


@register("model_comparison_cv")
def q_comparison_cv(spark, sf):
    """Classifiers with the gap of a threefold cross-validation in place of the hold-out's."""
    tr, te, feats = parts(spark, sf)
    return M.compare_models(tr, te, feats, ["logistic", "tree_simple", "tree_deep", "naive_bayes"], folds=3)
