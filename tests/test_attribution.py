from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from folioscope.operators import attribution as at
from folioscope.operators import models as md

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(160, 4))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id bigint, x array<double>, label double")
    return df.select("row_id", "label", array_to_vector("x").alias("features")).cache()


def shapley(f, width):
    out = np.zeros(width)
    for j in range(width):
        rest = [k for k in range(width) if k != j]
        for s in range(width):
            for group in combinations(rest, s):
                w = factorial(s) * factorial(width - s - 1) / factorial(width)
                out[j] += w * (f(set(group) | {j}) - f(set(group)))
    return out


def test_leaf_formula_is_shapley():
    rng = np.random.default_rng(1)
    features, low, high, share = [0, 2, 3], [-1.0, -np.inf, 0.0], [1.0, 0.5, np.inf], [0.3, 0.6, 0.8]
    leaf = [np.array([v]) for v in (features, low, high, share, [2.0])]
    for x in rng.normal(size=(6, 4)):
        hit = {f: float(lo < x[f] <= hi) for f, lo, hi in zip(features, low, high)}
        z = dict(zip(features, share))
        game = lambda s: 2.0 * np.prod([hit[f] if f in s else z[f] for f in z])
        got = at.leaf_attributions(x[None, :], *leaf)[0, :, 0]
        assert got == pytest.approx(shapley(game, 4), abs=1e-12)


@pytest.mark.parametrize("model_id,params", [
    ("dt", {"max_depth": 4}), ("rf", {"n_estimators": 5, "max_depth": 3}), ("xgb", {"n_estimators": 4, "max_depth": 3})])
def test_tree_attributions_add_up(rows, model_id, params):
    fitted = md.fit_classifier(model_id, params, rows, 2)
    long, base = at.tree_attributions(fitted, rows, NAMES)
    total = {r["row_id"]: r["s"] + base for r in long.groupBy("row_id").agg(F.sum("shap").alias("s")).collect()}
    for r in fitted.predict(rows).collect():
        p = r["y_prob"]
        want = np.log(p / (1 - p)) if model_id == "xgb" else p
        assert total[r["row_id"]] == pytest.approx(want, abs=1e-6)


def test_row_and_leaf_packs_change_nothing(rows, monkeypatch):
    fitted = md.fit_classifier("rf", {"n_estimators": 12, "max_depth": 5}, rows, 2)
    whole = {(r["row_id"], r["feature"]): r["shap"] for r in at.tree_attributions(fitted, rows, NAMES)[0].collect()}
    monkeypatch.setattr(at, "PACK_BYTES", 2000)
    named = rows.select(F.concat(F.lit("r"), "row_id").alias("row_id"), "label", "features")
    long, base = at.tree_attributions(fitted, named, NAMES)
    got = {(int(r["row_id"][1:]), r["feature"]): r["shap"] for r in long.collect()}
    assert got.keys() == whole.keys() and all(got[k] == pytest.approx(v, abs=1e-12) for k, v in whole.items())


def test_many_classes_average_their_sizes(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3))
    y = np.digitize(x[:, 0] + 0.3 * x[:, 1], [-0.5, 0.5]).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "row_id bigint, x array<double>, label double")
    rows = df.select("row_id", "label", array_to_vector("x").alias("features"))
    for model_id in ("dt", "xgb"):
        fitted = md.fit_classifier(model_id, {"max_depth": 3, "n_estimators": 2}, rows, 3)
        long, base = at.tree_attributions(fitted, rows, NAMES[:3])
        assert np.isnan(base) and long.count() == 360 and long.where("shap < 0").count() == 0
        assert at.top_features(long, 1).first()["feature"] == "a"


def test_kernel_agrees_with_linear(rows):
    fitted = md.fit_regressor("ridge", {"alpha": 0.001, "l1_ratio": 0.0}, rows)
    w = fitted.stages[0].coefficients.toArray()
    shap = at.kernel_attributions(fitted, rows.limit(20), NAMES, centres=20).collect()
    x = np.array([r["features"].toArray() for r in rows.limit(20).collect()])
    mean = x.mean(axis=0)
    for r in shap:
        j = NAMES.index(r["feature"])
        assert r["shap"] == pytest.approx(w[j] * (r["feature_value"] - mean[j]), abs=1e-6)


def test_candidates_are_distinct_and_seeded():
    grid = md.CLASSIFICATION_GRIDS["xgb"]
    a, b = md.sample_candidates(grid, 50, 1), md.sample_candidates(grid, 50, 1)
    assert a == b and len({md.params_text(p) for p in a}) == 50
    assert len(md.sample_candidates(md.CLASSIFICATION_GRIDS["dt"], 500, 1)) == 40
    with pytest.raises(ValueError):
        md.model_grids("classification", ["nope"])


def test_cross_correlations_match_numpy(spark, monkeypatch):
    monkeypatch.setattr(at, "BATCH_CELLS", 64)  # several blocks a task
    rng = np.random.default_rng(4)
    n, width = 90, 6
    v, s = rng.normal(size=(n, width)) * 3 + 1e4, rng.normal(size=(n, width))
    s[:, 1] += 0.8 * (v[:, 4] - 1e4)
    v[:, 2] = 0.1  # constant
    v[::7, 3] = np.nan
    s[::5, 1] = np.nan
    cells = [(i, f"f{j}", None if np.isnan(s[i, j]) else float(s[i, j]), None if j == 3 and np.isnan(v[i, j]) and i % 2 else float(v[i, j]))
             for i in range(n) for j in range(width) if (i, j) != (3, 5)]
    v[3, 5] = s[3, 5] = np.nan
    shap = spark.createDataFrame(cells, "row_id bigint, feature string, shap double, feature_value double").repartition(3)
    got = {(r["feature"], r["other"]): r["r"] for r in at.cross_correlations(shap, ["f1", "f5"]).collect()}
    assert len(got) == 2 * (width - 1)
    for (f, o), r in got.items():
        x, y = v[:, int(o[1])], s[:, int(f[1])]
        both = ~np.isnan(x) & ~np.isnan(y)
        want = 0.0 if o == "f2" else np.corrcoef(x[both], y[both])[0, 1]
        assert r == pytest.approx(want, abs=1e-9)
    best = {r["feature"]: r["interaction"] for r in at.dependence(shap, 6).select("feature", "interaction").distinct().collect()}
    assert best["f1"] == "f4"
    empty = shap.where("row_id < 0")
    assert at.cross_correlations(empty, []).count() == 0 and at.dependence(empty).count() == 0


def test_kernel_takes_string_ids(rows):
    named = rows.limit(12).withColumn("row_id", F.concat(F.lit("r"), "row_id"))
    fitted = md.fit_regressor("ridge", {"alpha": 0.001, "l1_ratio": 0.0}, rows)
    got = at.kernel_attributions(fitted, named, NAMES, centres=5)
    assert got.count() == 12 * len(NAMES) and got.where(~F.col("row_id").startswith("r")).count() == 0
