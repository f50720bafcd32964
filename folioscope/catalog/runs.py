"""Queries of whole multi-target runs over the labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.catalog import modelling as mo
from folioscope.plans.run import run_targets
from folioscope.plans.settings import RunSettings, TaskSettings
from folioscope.session import derived_once
from folioscope.sources import tables

QUERIES: dict = {}
SQL: dict = {}

_RUNS: dict = {}


def run(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        long = mo.document_features(spark, sf).select("row_id", "feature", "value").where("feature <> 'n_chars'")
        docs = tables.read_table(spark, sf, "documents", ["doc_id", "lang", "n_chars"])
        labels = tables.read_table(spark, sf, "labels", ["doc_id", "quality"])
        ent = derived_once(spark, f"document entities {sf}", lambda: docs.join(labels, "doc_id").select(
            F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("grade"),
            F.col("n_chars").cast("double").alias("length"), F.lit("same").alias("constant")))
        fixed = TaskSettings(n_outer=2, n_inner=2, model_filter=["dt"], fixed_params={"dt": {"max_depth": 3}}, use_smote=False)
        settings = RunSettings(
            classification=fixed, regression=fixed, skip_reduction=True, skip_explain=True,
            targets=["grade", "length", "constant", "absent"])
        _RUNS[key] = run_targets(long, mo.DOC_FEATURES[1:], ent, settings)
    return _RUNS[key]


def g6(spark, sf):
    return run(spark, sf).status


def g7(spark, sf):
    return run(spark, sf).leaderboard


QUERIES["g6_target_status"] = g6
QUERIES["g7_leaderboard"] = g7
