"""Whole runs: selection report, reduction, then every target in turn."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import clean_double
from folioscope.operators import metrics
from folioscope.operators import preprocess as pp
from folioscope.operators import splits as sp
from folioscope.plans.evaluate import Plan, run_classification, run_regression
from folioscope.plans.explain import explain_best
from folioscope.plans.reduction import reduce_dimensions
from folioscope.plans.settings import RunSettings, TaskSettings
from folioscope.session import cut_lineage
from folioscope.sources.sinks import label_map, write_results, write_table

log = logging.getLogger(__name__)


@dataclass
class RunResult:
    """`status` is (target, task, status, reason); the rest is keyed by target."""

    status: DataFrame
    leaderboard: DataFrame | None
    targets: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    explanations: dict[str, dict[str, DataFrame]] = field(default_factory=dict)
    selection: DataFrame | None = None
    reduction: dict[str, DataFrame] = field(default_factory=dict)


def _plan(s: RunSettings, t: TaskSettings) -> Plan:
    return Plan(
        n_outer=t.n_outer, n_inner=t.n_inner, n_iter=t.n_iter, model_filter=t.model_filter, fixed_params=t.fixed_params,
        use_smote=t.use_smote, limits=pp.Thresholds(correlation=s.corr_threshold), seed=s.seed, parallelism=s.parallelism)


def run_targets(
    long: DataFrame, features: Sequence[str], entities: DataFrame, settings: RunSettings, key: str = "row_id",
    output: str | None = None,
) -> RunResult:
    """`long` is (key, feature, value); `entities` holds the key, the targets and the clinical
    columns. A target that fails is reported and does not stop the others."""
    spark = long.sparkSession
    limits = pp.Thresholds(correlation=settings.corr_threshold)
    result = RunResult(status=None, leaderboard=None)
    everyone = long.select(key).distinct()
    state = cut_lineage(pp.fit_filters(long, pp.whole_data(everyone, key), features, limits))
    result.selection = pp.selection_report(state, limits)
    if not settings.skip_reduction:
        names = [r["feature"] for r in pp.kept_features(state).orderBy("position").collect()]  # schema-sized
        vec = pp.transform_vectors(pp.row_vectors(long, features, key).withColumn("fold", F.lit(0)), state)
        rows = cut_lineage(vec.select(key, array_to_vector("features").alias("features")))
        result.reduction = reduce_dimensions(
            rows, names, entities, settings.methods, settings.n_neighbors, settings.min_dist, settings.seed)

    present = [t for t in settings.targets if t in entities.columns]
    status = [(t, None, "skipped", "no such column") for t in settings.targets if t not in present]
    boards = []
    if present:
        tasks = {r["target"]: r["task"] for r in sp.target_types(entities, present).collect()}  # one row per target
        gates = {r["target"]: r for r in sp.target_gate(entities, tasks).collect()}
        for target in present:
            task, gate = tasks[target], gates[target]
            chosen = settings.classification if task == "classification" else settings.regression
            if not chosen.enabled:
                status.append((target, task, "skipped", "task disabled"))
                continue
            if gate["skip_reason"]:
                status.append((target, task, "skipped", gate["skip_reason"]))
                continue
            try:
                cv, n_classes = _run_one(result, long, features, entities, settings, key, target, task, gate, output)
            except Exception as exc:  # isolate one target's failure
                log.exception("target %s failed", target)
                status.append((target, task, "failed", str(exc)[:500]))
                continue
            status.append((target, task, "done", None))
            boards.append(_board(cv, target, task))
            if not settings.skip_explain and target in settings.explain_targets:
                try:
                    labels = _labels(entities, key, target, task)
                    result.explanations[target] = explain_best(
                        long, features, labels, cv, task, n_classes, entities, limits, settings.seed)
                except Exception as exc:
                    log.exception("explanation of %s failed", target)
                    status.append((target, task, "explanation failed", str(exc)[:500]))
    result.status = spark.createDataFrame(status, "target string, task string, status string, reason string")
    board = None
    for b in boards:
        board = b if board is None else board.unionByName(b)
    result.leaderboard = board
    if output:
        write_table(result.selection, output, "feature_selection_report")
        for kind, df in result.reduction.items():
            write_table(df, output, kind)
        for target, tables in result.explanations.items():
            write_results(tables, output + "/explain", tasks[target], target)
    return result


def _labels(entities: DataFrame, key: str, target: str, task: str) -> DataFrame:
    valid = entities.where(sp.valid_target(target, task))
    if task == "regression":
        return valid.select(key, clean_double(target).alias("label"))
    codes = label_map(valid, target).withColumnRenamed("label", "_text")
    return valid.join(codes, F.col(target).cast("string") == F.col("_text")).select(key, F.col("encoded").alias("label"))


def _run_one(result, long, features, entities, settings, key, target, task, gate, output):
    labels = cut_lineage(_labels(entities, key, target, task))
    mine = long.join(labels.select(key), key, "left_semi")
    if task == "classification":
        n_classes = int(gate["n_classes"])
        tables = run_classification(mine, features, labels, n_classes, _plan(settings, settings.classification))
        tables["label_encoding"] = label_map(entities.where(sp.valid_target(target, task)), target)
    else:
        n_classes = 0
        tables = run_regression(mine, features, labels, _plan(settings, settings.regression))
    result.targets[target] = tables
    if output:
        write_results(tables, output, task, target)
    return tables["cv_results"], n_classes


def _board(cv: DataFrame, target: str, task: str) -> DataFrame:
    """(target, task, model, metric, value, r2): the best model of one target."""
    metric = "auc_roc" if task == "classification" else "rmse"
    best = metrics.best_model(cv, metric, lower_is_better=task == "regression")
    if task == "regression":
        r2 = cv.groupBy("model").agg(F.avg("r2").alias("r2"))
    else:
        r2 = cv.select("model").distinct().withColumn("r2", F.lit(None).cast("double"))
    return best.join(r2, "model").select(
        F.lit(target).alias("target"), F.lit(task).alias("task"), "model", F.lit(metric).alias("metric"), "value", "r2")
