"""Queries that fit models: documents described by their own text statistics."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from folioscope.operators import models as md
from folioscope.operators import preprocess as pp
from folioscope.plans import evaluate as ev
from folioscope.session import cut_lineage, derived_once
from folioscope.sources import tables

QUERIES: dict = {}
SQL: dict = {}
DOC_FEATURES = ["n_chars", "n_words", "n_lines", "digit_share", "upper_share", "mark_share", "distinct_share"]


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn
    return register


def document_features(spark, sf):
    """(row_id, feature, value, quality): text statistics of the labelled documents."""
    def build():
        docs = tables.read_table(spark, sf, "documents", ["doc_id", "text", "n_chars"])
        labels = tables.read_table(spark, sf, "labels", ["doc_id", "quality"])
        words = F.split("text", r"\s+")
        n = F.greatest(F.length("text"), F.lit(1))
        wide = docs.join(labels, "doc_id").select(
            F.col("doc_id").alias("row_id"), F.col("quality").alias("label"),
            F.col("n_chars").cast("double"), F.size(words).cast("double").alias("n_words"),
            (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("double").alias("n_lines"),
            (F.length(F.regexp_replace("text", r"\D", "")) / n).alias("digit_share"),
            (F.length(F.regexp_replace("text", r"[^A-Z]", "")) / n).alias("upper_share"),
            (F.length(F.regexp_replace("text", r"[\w\s]", "")) / n).alias("mark_share"),
            (F.size(F.array_distinct(words)) / F.size(words)).alias("distinct_share"))
        return wide.unpivot(["row_id", "label"], DOC_FEATURES, "feature", "value")
    return derived_once(spark, f"document features {sf}", build)


def quality(spark, sf):
    long = document_features(spark, sf)
    return long.select("row_id", "feature", "value"), long.select("row_id", "label").distinct()


def length_target(spark, sf):
    """Predict the number of characters from the other statistics."""
    long = document_features(spark, sf).select("row_id", "feature", "value")
    target = long.where("feature = 'n_chars'").select("row_id", F.col("value").alias("label"))
    return long.where("feature <> 'n_chars'"), DOC_FEATURES[1:], target


def embedding_target(spark, sf):
    """Ten classes over 64 embedding components."""
    e = tables.read_table(spark, sf, "embeddings")
    wide = e.select(F.col("vec_id").alias("row_id"), "label", F.posexplode("embedding").alias("p", "value"))
    names = [f"e{i:02d}" for i in range(64)]
    long = wide.select("row_id", F.format_string("e%02d", "p").alias("feature"), F.col("value").cast("double").alias("value"))
    return long, names, e.select(F.col("vec_id").alias("row_id"), "label")


def training_table(spark, sf, long, features, labels):
    state = pp.fit_filters(long, pp.whole_data(labels), features)
    vec = pp.row_vectors(long, features).withColumn("fold", F.lit(0)).join(labels, "row_id")
    return pp.transform_vectors(vec, state).select(
        "row_id", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))


def _quality_table(spark, sf):
    long, labels = quality(spark, sf)
    return derived_once(spark, f"quality table {sf}", lambda: training_table(spark, sf, long, DOC_FEATURES, labels))


def _length_table(spark, sf):
    long, names, target = length_target(spark, sf)
    return derived_once(spark, f"length table {sf}", lambda: training_table(spark, sf, long, names, target))


def _class_query(name, model_id, params):
    def run(spark, sf):
        t = _quality_table(spark, sf)
        return md.fit_classifier(model_id, params, t, 2).predict(t).select("row_id", F.col("label").cast("int").alias("y_true"), "y_pred", "y_prob")
    query(name)(run)


def _value_query(name, model_id, params):
    def run(spark, sf):
        t = _length_table(spark, sf)
        return md.fit_regressor(model_id, params, t).predict(t).select("row_id", F.col("label").alias("y_true"), "y_pred")
    query(name)(run)


_class_query("m1_tree_classes", "dt", {"max_depth": 4, "min_samples_leaf": 2, "criterion": "gini"})
_value_query("m1_tree_values", "dt", {"max_depth": 5, "min_samples_leaf": 2})
_class_query("m2_logistic", "lr", {"C": 1.0, "l1_ratio": 0.5})
_value_query("m3_elastic_net", "ridge", {"alpha": 1.0, "l1_ratio": 0.5})
_class_query("m4_forest_classes", "rf", {"n_estimators": 20, "max_depth": 5})
_value_query("m4_forest_values", "rf", {"n_estimators": 20, "max_depth": 5})
_class_query("m5_boosted_classes", "xgb", {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.2})
_value_query("m5_boosted_values", "xgb", {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.2})
_class_query("m6_leafwise_classes", "lgbm", {"n_estimators": 10, "num_leaves": 15, "min_child_samples": 5})
_value_query("m6_leafwise_values", "lgbm", {"n_estimators": 10, "num_leaves": 15, "min_child_samples": 5})
_class_query("m7_kernel_classes", "svm", {"C": 1.0, "gamma": "scale"})
_value_query("m8_kernel_values", "svr", {"C": 100.0, "gamma": "scale", "epsilon": 0.1})


@query("m5_boosted_many_classes")
def m5_multi(spark, sf):
    long, names, labels = embedding_target(spark, sf)
    t = derived_once(spark, f"embedding table {sf}", lambda: training_table(spark, sf, long, names, labels))
    fitted = md.fit_classifier("xgb", {"n_estimators": 2, "max_depth": 3, "learning_rate": 0.2}, t, 10)
    return fitted.predict(t).select("row_id", F.col("label").cast("int").alias("y_true"), "y_pred", "y_prob")


SMALL = {"dt": {"max_depth": 3}, "lr": {"C": 1.0, "l1_ratio": 0.0}}


@query("r5_random_search")
def r5(spark, sf):
    long, labels = quality(spark, sf)
    plan = ev.Plan(n_outer=2, n_inner=2, n_iter=3, model_filter=["dt"], use_smote=False)
    named = labels.withColumn("stratum", F.col("label"))
    _, design = ev.build_design(long, DOC_FEATURES, named, plan, "stratum", "stratum", True)
    grid = md.model_grids("classification", ["dt"])["dt"]
    best, scores = ev.search_parameters("classification", "dt", grid, design, 0, 2, plan)
    return scores.withColumn("best_params", F.lit(md.params_text(best)))


@query("r6_fixed_parameters")
def r6(spark, sf):
    long, labels = quality(spark, sf)
    plan = ev.Plan(n_outer=2, n_inner=2, model_filter=list(SMALL), fixed_params=SMALL, use_smote=False)
    return ev.run_classification(long, DOC_FEATURES, labels, 2, plan)["cv_results"]


@query("r3_oversampled_fit")
def r3(spark, sf):
    t = _quality_table(spark, sf)
    grown = ev.with_oversampling(t, 42)
    return md.fit_classifier("dt", {"max_depth": 3}, grown, 2).predict(t).select("row_id", "y_pred", "y_prob")


@query("r7_learning_curve")
def r7(spark, sf):
    long, labels = quality(spark, sf)
    return ev.learning_curve(long, DOC_FEATURES, labels, ["rf"], params={"rf": {"n_estimators": 5, "max_depth": 4}}, plan=ev.Plan(use_smote=False, parallelism=6))


@query("g2_nested_classification")
def g2(spark, sf):
    long, labels = quality(spark, sf)
    # The tree is searched, the logistic model runs with given parameters; both are oversampled.
    plan = ev.Plan(n_outer=2, n_inner=2, n_iter=2, model_filter=["dt", "lr"], fixed_params={"lr": SMALL["lr"]})
    return ev.run_classification(long, DOC_FEATURES, labels, 2, plan)["cv_results"]


@query("g3_nested_regression")
def g3(spark, sf):
    long, names, target = length_target(spark, sf)
    plan = ev.Plan(n_outer=2, n_inner=2, n_iter=2, model_filter=["dt", "ridge"])
    return ev.run_regression(long, names, target, plan)["cv_results"]
