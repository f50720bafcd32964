"""Model registry, fitting, prediction and parameter search over Spark ML.

A training table is (row_id, features vector, label double); predictions add y_pred and, for
classes, an array of class probabilities. Parameter names and grids are the public ones;
each builder translates them to its Spark estimator.
"""

from __future__ import annotations

import itertools
import json
import logging
import math
import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.scalars import hash_unit
from folioscope.operators.splits import balanced_weights
from folioscope.session import bounded_batches

log = logging.getLogger(__name__)


def _logspace(lo: float, hi: float, n: int) -> list[float]:
    return [float(x) for x in np.logspace(lo, hi, n)]


# The searched parameter values of every model.
BOOSTED_GRID = {
    "n_estimators": [100, 300, 500],
    "max_depth": [3, 5, 7],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "min_child_weight": [1, 3, 5],
    "gamma": [0, 0.1, 0.3],
}
LEAFWISE_GRID = {
    "n_estimators": [100, 300, 500],
    "max_depth": [3, 5, 7, -1],
    "learning_rate": [0.01, 0.05, 0.1, 0.2],
    "num_leaves": [15, 31, 63],
    "subsample": [0.6, 0.8, 1.0],
    "colsample_bytree": [0.6, 0.8, 1.0],
    "min_child_samples": [5, 10, 20],
}
FOREST_GRID = {
    "max_depth": [None, 5, 10, 20],
    "min_samples_leaf": [1, 2, 4],
    "max_features": ["sqrt", "log2", 0.3, 0.5],
}
L1_RATIOS = [0.0, 0.25, 0.5, 0.75, 1.0]
GAMMAS = ["scale", "auto", *_logspace(-4, 0, 10)]
CLASSIFICATION_GRIDS = {
    "dt": {"max_depth": [2, 3, 4, 5, 6], "min_samples_leaf": [1, 2, 4, 8], "criterion": ["gini", "entropy"]},
    "lr": {"C": _logspace(-3, 2, 20), "l1_ratio": L1_RATIOS},
    "svm": {"C": _logspace(-2, 3, 20), "gamma": GAMMAS},
    "rf": FOREST_GRID,
    "xgb": BOOSTED_GRID,
    "lgbm": LEAFWISE_GRID,
}
REGRESSION_GRIDS = {
    # Spark regression trees split on variance only, so the criterion has one value.
    "dt": {"max_depth": [2, 3, 4, 5, 6], "min_samples_leaf": [1, 2, 4, 8], "criterion": ["squared_error"]},
    "ridge": {"alpha": _logspace(-3, 3, 20), "l1_ratio": L1_RATIOS},
    "svr": {"C": _logspace(-2, 3, 20), "gamma": GAMMAS, "epsilon": [0.01, 0.1, 0.5, 1.0]},
    "rf": FOREST_GRID,
    "xgb": BOOSTED_GRID,
    "lgbm": LEAFWISE_GRID,
}
FOREST_TREES = 500
DEEPEST = 30  # Spark's limit; stands for "no limit"
UNWEIGHTED = {"xgb"}
NO_OVERSAMPLING = {"lgbm"}
RANDOM_FEATURES = 256
MAX_ITERATIONS = 100  # every iteration is a pass over the data
TOLERANCE = 1e-4


def model_grids(task: str, model_filter: Sequence[str] | None = None) -> dict[str, dict]:
    """Available models and grids; unknown ids are reported, none left is an error."""
    grids = CLASSIFICATION_GRIDS if task == "classification" else REGRESSION_GRIDS
    if model_filter is None:
        return dict(grids)
    unknown = sorted(set(model_filter) - set(grids))
    if unknown:
        log.warning("models not available and skipped: %s", unknown)
    chosen = {m: g for m, g in grids.items() if m in set(model_filter)}
    if not chosen:
        raise ValueError(f"no valid {task} model in {list(model_filter)}")
    return chosen


def sample_candidates(grid: dict[str, list], n_iter: int, seed: int) -> list[dict]:
    """`n_iter` distinct parameter sets, or all of them when there are fewer."""
    names = list(grid)
    sizes = [len(grid[n]) for n in names]
    total = math.prod(sizes)
    picks = range(total) if total <= n_iter else random.Random(seed).sample(range(total), n_iter)
    out = []
    for p in picks:
        params = {}
        for name, size in zip(reversed(names), reversed(sizes)):
            p, i = divmod(p, size)
            params[name] = grid[name][i]
        out.append({n: params[n] for n in names})
    return out


def params_text(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


# ---- estimators ------------------------------------------------------------------------

def _depth(value) -> int:
    return DEEPEST if value in (None, -1) else int(value)


def _leaf_depth(params: dict) -> int:
    by_leaves = math.ceil(math.log2(params.get("num_leaves", 31)))
    depth = params.get("max_depth", -1)
    return by_leaves if depth in (None, -1) else min(int(depth), by_leaves)


def _forest(kind, params: dict, seed: int):
    return kind(
        numTrees=int(params.get("n_estimators", FOREST_TREES)), maxDepth=_depth(params.get("max_depth")),
        minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
        featureSubsetStrategy=str(params.get("max_features", "sqrt")), seed=seed)


def _boosted(kind, params: dict, seed: int, leafwise: bool):
    return kind(
        maxIter=int(params.get("n_estimators", 100)),
        maxDepth=_leaf_depth(params) if leafwise else _depth(params.get("max_depth", 6)),
        stepSize=float(params.get("learning_rate", 0.1 if leafwise else 0.3)),
        subsamplingRate=float(params.get("subsample", 1.0)),
        featureSubsetStrategy=str(float(params.get("colsample_bytree", 1.0))),
        minInstancesPerNode=int(params.get("min_child_samples", 20) if leafwise else params.get("min_child_weight", 1)),
        minInfoGain=0.0 if leafwise else float(params.get("gamma", 0.0)), seed=seed)


@dataclass
class Fitted:
    """A fitted model: `predict` adds y_pred and, for classes, `probs`."""

    model_id: str
    params: dict
    stages: list
    score: Callable[[DataFrame], DataFrame]
    n_classes: int

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.score(rows)


def _class_output(df: DataFrame, n_classes: int, probs: Column) -> DataFrame:
    """Probabilities as an array of n_classes and the most probable class."""
    out = df.withColumn("probs", probs)
    best = F.array_position("probs", F.array_max("probs")) - 1
    return out.withColumn("y_pred", best.cast("int")).withColumn(
        "y_prob", F.get("probs", F.lit(1)) if n_classes == 2 else F.array_max("probs"))


def random_fourier(df: DataFrame, gamma: float, seed: int, width: int, source: str = "features", out: str = "mapped") -> DataFrame:
    """Random features whose inner products approximate the RBF kernel exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(width, RANDOM_FEATURES))
    b = rng.uniform(0.0, 2.0 * math.pi, size=RANDOM_FEATURES)
    scale = math.sqrt(2.0 / RANDOM_FEATURES)

    bounded_batches(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def project(x: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        z = scale * np.cos(np.stack(x.to_numpy()) @ w + b)
        return pd.Series(list(z))

    return df.withColumn(out, array_to_vector(project(vector_to_array(source))))


def _gamma(value, train: DataFrame, width: int) -> float:
    if value == "auto":
        return 1.0 / width
    if value in (None, "scale"):
        flat = train.select(F.explode(vector_to_array("features")).alias("v")).agg(F.var_pop("v")).first()[0]
        return 1.0 / (width * flat) if flat else 1.0
    return float(value)


def fit_classifier(model_id: str, params: dict, train: DataFrame, n_classes: int, seed: int = 42) -> Fitted:
    if model_id in UNWEIGHTED:
        data, weight = train, {}
    else:
        w = balanced_weights(train, "label").select("label", "weight")
        data, weight = train.join(F.broadcast(w), "label"), {"weightCol": "weight"}  # one row per class
    if model_id == "dt":
        est = DecisionTreeClassifier(
            maxDepth=_depth(params.get("max_depth")), minInstancesPerNode=int(params.get("min_samples_leaf", 1)),
            impurity=params.get("criterion", "gini"), seed=seed, **weight)
    elif model_id == "lr":
        rows = train.count()  # balanced weights sum to the number of rows
        est = LogisticRegression(
            regParam=1.0 / (float(params.get("C", 1.0)) * rows), elasticNetParam=float(params.get("l1_ratio", 0.0)),
            standardization=False, maxIter=MAX_ITERATIONS, tol=TOLERANCE, **weight)
    elif model_id == "rf":
        est = _forest(RandomForestClassifier, params, seed)
        est.setWeightCol("weight")
    elif model_id in ("xgb", "lgbm"):
        est = _boosted(GBTClassifier, params, seed, model_id == "lgbm")
        if weight:
            est.setWeightCol("weight")
    elif model_id == "svm":
        return _fit_svm(params, data, n_classes, seed)
    else:
        raise ValueError(f"unknown classification model {model_id}")

    if n_classes > 2 and model_id in ("xgb", "lgbm"):
        ovr = OneVsRest(classifier=est, rawPredictionCol="rawPrediction", **weight)
        model = ovr.fit(data)

        def squash(df: DataFrame) -> DataFrame:
            raw = F.transform(vector_to_array("rawPrediction"), lambda v: 1.0 / (1.0 + F.exp(-2.0 * v)))
            scored = model.transform(df).withColumn("_s", raw)
            total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
            return _class_output(scored, n_classes, F.transform("_s", lambda v: v / total)).drop("_s", "rawPrediction", "prediction")

        return Fitted(model_id, params, [model], squash, n_classes)

    model = est.fit(data)

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        return _class_output(scored, n_classes, vector_to_array("probability")).drop(
            "rawPrediction", "probability", "prediction")

    return Fitted(model_id, params, [model], score, n_classes)


def _fit_svm(params: dict, data: DataFrame, n_classes: int, seed: int) -> Fitted:
    """Kernel machine as a linear one on random features; probabilities by a logistic fit of
    the margin on rows the margin model has not seen."""
    width = len(data.select(vector_to_array("features").alias("f")).first()[0])
    gamma = _gamma(params.get("gamma", "scale"), data, width)
    mapped = random_fourier(data, gamma, seed, width)
    reg = 1.0 / (float(params.get("C", 1.0)) * max(1, data.count()))
    svc = LinearSVC(featuresCol="mapped", regParam=reg, weightCol="weight", standardization=False)
    if n_classes > 2:
        model = OneVsRest(classifier=svc, featuresCol="mapped", weightCol="weight", rawPredictionCol="rawPrediction").fit(mapped)

        def squash(df: DataFrame) -> DataFrame:
            scored = model.transform(random_fourier(df, gamma, seed, width)).withColumn(
                "_s", F.transform(vector_to_array("rawPrediction"), lambda v: 1.0 / (1.0 + F.exp(-v))))
            total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
            return _class_output(scored, n_classes, F.transform("_s", lambda v: v / total)).drop("_s", "mapped", "rawPrediction", "prediction")

        return Fitted("svm", params, [model], squash, n_classes)

    held = hash_unit(F.lit(seed), F.lit("margin"), F.col("row_id")) < 0.25
    margin_model = svc.fit(mapped.where(~held))

    def margins(model, df: DataFrame) -> DataFrame:
        m = F.get(vector_to_array("rawPrediction"), F.lit(1))
        return model.transform(df).withColumn("margin", array_to_vector(F.array(m)))

    calibration = LogisticRegression(featuresCol="margin", weightCol="weight").fit(
        margins(margin_model, mapped.where(held)).drop("prediction", "rawPrediction"))
    final = svc.fit(mapped)

    def score(df: DataFrame) -> DataFrame:
        with_margin = margins(final, random_fourier(df, gamma, seed, width)).drop("prediction", "rawPrediction")
        return _class_output(calibration.transform(with_margin), 2, vector_to_array("probability")).drop(
            "mapped", "margin", "rawPrediction", "probability", "prediction")

    return Fitted("svm", params, [final, calibration], score, 2)


def fit_regressor(model_id: str, params: dict, train: DataFrame, seed: int = 42) -> Fitted:
    mapping = None
    if model_id == "dt":
        est = DecisionTreeRegressor(
            maxDepth=_depth(params.get("max_depth")), minInstancesPerNode=int(params.get("min_samples_leaf", 1)), seed=seed)
    elif model_id == "ridge":
        # Spark scales the label by its deviation, which reweights the quadratic penalty.
        alpha, l1 = float(params.get("alpha", 1.0)), float(params.get("l1_ratio", 0.5))
        sigma = train.agg(F.stddev_samp("label")).first()[0] or 1.0
        mix = l1 + sigma * (1.0 - l1)
        est = LinearRegression(regParam=alpha * mix, elasticNetParam=l1 / mix, standardization=False, maxIter=MAX_ITERATIONS)
    elif model_id == "svr":
        width = len(train.select(vector_to_array("features").alias("f")).first()[0])
        gamma = _gamma(params.get("gamma", "scale"), train, width)
        mapping = lambda df: random_fourier(df, gamma, seed, width)
        reg = 1.0 / (float(params.get("C", 1.0)) * max(1, train.count()))
        est = LinearRegression(featuresCol="mapped", loss="huber", epsilon=1.0 + float(params.get("epsilon", 0.1)),
                               regParam=reg, maxIter=200)
    elif model_id == "rf":
        est = _forest(RandomForestRegressor, params, seed)
    elif model_id in ("xgb", "lgbm"):
        est = _boosted(GBTRegressor, params, seed, model_id == "lgbm")
    else:
        raise ValueError(f"unknown regression model {model_id}")
    model = est.fit(mapping(train) if mapping else train)

    def score(df: DataFrame) -> DataFrame:
        return model.transform(mapping(df) if mapping else df).withColumn("y_pred", F.col("prediction")).drop("prediction", "mapped")

    return Fitted(model_id, params, [model], score, 0)
