"""Refit the best model on all rows and explain it."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import attribution as at
from folioscope.operators import metrics, models
from folioscope.operators import preprocess as pp
from folioscope.plans.reduction import with_clinical
from folioscope.session import cut_lineage


def refit_best(
    long: DataFrame, features: Sequence[str], labels: DataFrame, cv: DataFrame, task: str, n_classes: int = 0,
    limits: pp.Thresholds = pp.Thresholds(), seed: int = 42,
) -> tuple[models.Fitted, DataFrame, list[str]]:
    """(fitted model, transformed rows, their feature names): best mean score, most frequent
    parameters, no oversampling."""
    metric = "auc_roc" if task == "classification" else "rmse"
    best = metrics.best_model(cv, metric, lower_is_better=task == "regression").first()
    params = json.loads(best["best_params"])
    state = cut_lineage(pp.fit_filters(long, pp.whole_data(labels), features, limits))
    names = [r["feature"] for r in pp.kept_features(state).orderBy("position").collect()]  # schema-sized
    vec = pp.row_vectors(long, features).withColumn("fold", F.lit(0)).join(labels, "row_id")
    rows = cut_lineage(pp.transform_vectors(vec, state).select(
        "row_id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features")))
    if task == "classification":
        fitted = models.fit_classifier(best["model"], params, rows, n_classes, seed)
    else:
        fitted = models.fit_regressor(best["model"], params, rows, seed)
    return fitted, rows, names


def explain_best(
    long: DataFrame, features: Sequence[str], labels: DataFrame, cv: DataFrame, task: str, n_classes: int = 0,
    meta: DataFrame | None = None, limits: pp.Thresholds = pp.Thresholds(), seed: int = 42,
) -> dict[str, DataFrame]:
    fitted, rows, names = refit_best(long, features, labels, cv, task, n_classes, limits, seed)
    shap = at.attributions(fitted, rows, names, seed)
    out = {
        "shap_values": with_clinical(shap, meta),
        "shap_importance": at.importance(shap),
        "beeswarm": at.beeswarm(shap),
        "dependence": at.dependence(shap),
    }
    if task == "classification" and n_classes == 2:
        pred = fitted.predict(rows).select(F.lit(fitted.model_id).alias("model"), "row_id", F.col("label").cast("int").alias("y_true"), "y_prob")
        out["waterfall"] = at.waterfall(shap, metrics.representative_rows(cut_lineage(pred)))
    return out
