"""Nested cross-validated classification and regression.

Preprocessing is fitted once for all outer and inner training sets; the transformed rows are
written as one table partitioned by split, and every model, candidate and fold reads its split
from there. The driver only loops over job parameters.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import hash_unit
from folioscope.operators import compare, metrics, models, neighbors, splits
from folioscope.operators import preprocess as pp
from folioscope.operators.foldsums import TrainingCells, cells_of_nested
from folioscope.session import cut_lineage, shared_folder


@dataclass
class Plan:
    """Job parameters of one evaluation."""

    n_outer: int = 5
    n_inner: int = 3
    n_iter: int = 50
    model_filter: Sequence[str] | None = None
    fixed_params: dict[str, dict] = field(default_factory=dict)
    use_smote: bool = True
    limits: pp.Thresholds = pp.Thresholds()
    seed: int = 42
    parallelism: int = 4


@dataclass
class Design:
    """Transformed rows of all splits: (split, row_id, role, label, features)."""

    table: DataFrame
    n_inner: int
    grown: dict[int, DataFrame] = field(default_factory=dict)

    def grow(self, split_numbers: Sequence[int], plan: Plan) -> None:
        """Oversample the training rows of splits; models and candidates share the result."""
        def one(split: int) -> None:
            self.grown[split] = with_oversampling(self.rows(split, "train"), plan.seed)
        with ThreadPoolExecutor(plan.parallelism) as pool:
            list(pool.map(one, split_numbers))

    def training(self, split: int, model_id: str) -> DataFrame:
        plain = model_id in models.NO_OVERSAMPLING or split not in self.grown
        return self.rows(split, "train") if plain else self.grown[split]

    def split_of(self, outer: int, inner: int | None = None) -> int:
        return outer * (self.n_inner + 1) + (0 if inner is None else 1 + inner)

    def rows(self, split: int, role: str) -> DataFrame:
        return self.table.where((F.col("split") == split) & (F.col("role") == role)).select("row_id", "label", "features")


def build_design(
    long: DataFrame, features: Sequence[str], labelled: DataFrame, plan: Plan, stratum: str,
    inner_stratum: str | None, search: bool,
) -> tuple[DataFrame, Design]:
    """(rows with their outer fold, design). `labelled` is (row_id, label, stratum)."""
    folded = splits.stratified_folds(labelled, "row_id", stratum, plan.n_outer, plan.seed, "outer_fold")
    folded = cut_lineage(folded)
    step = plan.n_inner + 1
    every = folded.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(plan.n_outer - 1))))
    outer = every.select(
        "row_id", (F.col("o") * step).alias("split"),
        F.when(F.col("outer_fold") == F.col("o"), "test").otherwise("train").alias("role"))
    roles = outer
    step_cells = [(o * step, f) for o in range(plan.n_outer) for f in range(plan.n_outer) if f != o]
    cells = TrainingCells(folded.select("row_id", F.col("outer_fold").alias("cell")), tuple(step_cells))
    if search:
        train = every.where(F.col("outer_fold") != F.col("o")).select("row_id", stratum, "o")
        if inner_stratum:
            inner = splits.stratified_folds(train, "row_id", inner_stratum, plan.n_inner, plan.seed, "i", ["o"])
        else:
            inner = splits.shuffled_folds(train, "row_id", plan.n_inner, plan.seed, "i", ["o"])
        inner = cut_lineage(inner)
        cells = cells_of_nested(inner, plan.n_outer, plan.n_inner)
        each = inner.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(plan.n_inner - 1))))
        roles = roles.unionByName(each.select(
            "row_id", (F.col("o") * step + 1 + F.col("s")).alias("split"),
            F.when(F.col("i") == F.col("s"), "test").otherwise("train").alias("role")))
    roles = cut_lineage(roles)
    state = pp.fit_filters(long, cells, features, plan.limits)
    vectors = pp.row_vectors(long, features).join(roles, "row_id").join(folded.select("row_id", "label"), "row_id")
    ready = pp.transform_vectors(vectors.withColumnRenamed("split", "fold"), cut_lineage(state))
    path = f"{shared_folder(long.sparkSession)}/design-{uuid.uuid4().hex}"
    ready.select(F.col("fold").alias("split"), "row_id", "role", F.col("label").cast("double").alias("label"), "features").write.partitionBy("split").parquet(path)
    table = long.sparkSession.read.parquet(path).withColumn("features", array_to_vector("features"))
    return folded, Design(table, plan.n_inner)


def with_oversampling(train: DataFrame, seed: int) -> DataFrame:
    """Training rows grown to equal classes; new rows get ids of their own."""
    k = splits.oversampling_neighbours(train, "label", most=neighbors.SMOTE_NEIGHBOURS).first()["k_neighbors"]
    pts = train.select(F.col("row_id").alias("id"), "label", vector_to_array("features").alias("vec"))
    grown = cut_lineage(neighbors.oversample(pts, "label", k, seed))
    return grown.select(
        F.when(F.col("synthetic"), -F.monotonically_increasing_id() - 1).otherwise(F.col("id")).alias("row_id"),
        "label", array_to_vector("vec").alias("features"))


def _fit(task: str, model_id: str, params: dict, train: DataFrame, n_classes: int, plan: Plan) -> models.Fitted:
    if task == "classification":
        return models.fit_classifier(model_id, params, train, n_classes, plan.seed)
    return models.fit_regressor(model_id, params, train, plan.seed)


def _scored(fitted: models.Fitted, test: DataFrame, task: str) -> DataFrame:
    out = fitted.predict(test)
    if task == "classification":
        return out.select("row_id", F.col("label").cast("int").alias("y_true"), "y_pred", "y_prob", "probs")
    return out.select("row_id", F.col("label").alias("y_true"), "y_pred")


def search_parameters(
    task: str, model_id: str, grid: dict, design: Design, outer: int, n_classes: int, plan: Plan
) -> tuple[dict, DataFrame]:
    """Best of `n_iter` sampled parameter sets by mean inner score, and all candidates' scores.

    A candidate that fails, or has no score, on any inner fold has none and never wins.
    """
    candidates = models.sample_candidates(grid, plan.n_iter, plan.seed)

    def one(job: tuple[int, int]) -> DataFrame | None:
        c, inner = job
        split = design.split_of(outer, inner)
        try:
            fitted = _fit(task, model_id, candidates[c], design.training(split, model_id), n_classes, plan)
            scored = _scored(fitted, design.rows(split, "test"), task)
            return cut_lineage(scored.withColumn("candidate", F.lit(c)).withColumn("inner", F.lit(inner)))
        except Exception as exc:  # a failing candidate must not stop the search
            models.log.warning("candidate %s of %s failed: %s", candidates[c], model_id, str(exc)[:200])
            return None

    jobs = [(c, i) for c in range(len(candidates)) for i in range(plan.n_inner)]
    with ThreadPoolExecutor(plan.parallelism) as pool:
        parts = [p for p in pool.map(one, jobs) if p is not None]
    if not parts:
        raise RuntimeError(f"no candidate of {model_id} could be fitted")
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    pred = cut_lineage(pred)
    keys = ["candidate", "inner"]
    if task == "regression":
        scores = metrics.regression_errors(pred, keys).select(*keys, (-F.col("rmse")).alias("score"))
    elif n_classes == 2:
        scores = metrics.auc(pred, keys).withColumnRenamed("auc_roc", "score")
    else:
        scores = metrics.auc_one_vs_rest(pred, "probs", n_classes, keys).withColumnRenamed("auc_roc", "score")
    complete = F.when(F.count("score") == plan.n_inner, F.avg("score"))
    board = scores.groupBy("candidate").agg(complete.alias("score")).where("score IS NOT NULL").collect()  # one row per candidate
    if not board:
        raise RuntimeError(f"no candidate of {model_id} has a score on every inner fold")
    ranked = sorted(board, key=lambda r: (-r["score"], r["candidate"]))
    return candidates[ranked[0]["candidate"]], scores


def _evaluate(
    task: str, long: DataFrame, features: Sequence[str], labelled: DataFrame, stratum: str,
    inner_stratum: str | None, n_classes: int, plan: Plan,
) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions, best parameters per fold and model)."""
    grids = models.model_grids(task, plan.model_filter)
    search = any(m not in plan.fixed_params for m in grids)
    folded, design = build_design(long, features, labelled, plan, stratum, inner_stratum, search)
    spark = long.sparkSession
    if task == "classification" and plan.use_smote and set(grids) - models.NO_OVERSAMPLING:
        inner = [design.split_of(o, i) for o in range(plan.n_outer) for i in range(plan.n_inner)] if search else []
        design.grow([design.split_of(o) for o in range(plan.n_outer)] + inner, plan)

    def one(job: tuple[int, str]) -> tuple[DataFrame, tuple]:
        outer, model_id = job
        if model_id in plan.fixed_params:
            params = plan.fixed_params[model_id]
        else:
            params, _ = search_parameters(task, model_id, grids[model_id], design, outer, n_classes, plan)
        split = design.split_of(outer)
        fitted = _fit(task, model_id, params, design.training(split, model_id), n_classes, plan)
        pred = _scored(fitted, design.rows(split, "test"), task)
        tagged = pred.withColumn("fold", F.lit(outer)).withColumn("model", F.lit(model_id))
        return tagged, (outer, model_id, models.params_text(params))

    results = [one((o, m)) for o in range(plan.n_outer) for m in grids]
    pred = results[0][0]
    for p, _ in results[1:]:
        pred = pred.unionByName(p)
    chosen = spark.createDataFrame([r[1] for r in results], "fold int, model string, best_params string")
    return cut_lineage(pred), chosen


def run_classification(
    long: DataFrame, features: Sequence[str], labels: DataFrame, n_classes: int, plan: Plan = Plan(),
    stratum: str | None = None,
) -> dict[str, DataFrame]:
    """`labels` is (row_id, label 0..n-1[, stratum]); folds are stratified by label by default."""
    named = labels.withColumn("stratum", F.col(stratum) if stratum else F.col("label"))
    pred, chosen = _evaluate(
        "classification", long, features, named.select("row_id", "label", "stratum"), "stratum", "stratum", n_classes, plan)
    scores = metrics.classification_scores(pred, n_classes, probs="probs").join(chosen, ["fold", "model"])
    scores = cut_lineage(scores)
    ids = list(models.model_grids("classification", plan.model_filter))
    out = {
        "cv_results": scores,
        "predictions": pred.select("fold", "model", "row_id", "y_true", "y_pred", "y_prob"),
        "confusion": metrics.confusion_matrix(pred, n_classes),
        "comparison": compare.comparison_table(scores, "auc_roc", ids),
    }
    if n_classes == 2:
        steps = metrics.score_steps(pred)
        out["roc_points"] = metrics.roc_points(steps).select("fold", "model", "fpr", "tpr", "threshold")
        out["mean_roc"] = metrics.mean_roc(pred)
    return out


def run_regression(
    long: DataFrame, features: Sequence[str], labels: DataFrame, plan: Plan = Plan(), bins: int = 5,
) -> dict[str, DataFrame]:
    """Outer folds stratified by quantile bin of the target, inner folds plain."""
    binned = splits.quantile_bins(labels.select("row_id", "label"), "label", bins, "stratum")
    pred, chosen = _evaluate("regression", long, features, binned, "stratum", None, 0, plan)
    scores = cut_lineage(metrics.regression_scores(pred).join(chosen, ["fold", "model"]))
    ids = list(models.model_grids("regression", plan.model_filter))
    return {
        "cv_results": scores,
        "predictions": metrics.residual_rows(pred),
        "pooled": metrics.regression_errors(pred, ["model"]).join(metrics.spearman(pred, ["model"]), "model"),
        "fitted_line": metrics.fitted_line(pred),
        "residual_histogram": metrics.residual_histogram(pred),
        "comparison": compare.comparison_table(scores, "rmse", ids, lower_is_better=True),
    }


def learning_curve(
    long: DataFrame, features: Sequence[str], labels: DataFrame, model_ids: Sequence[str] = ("rf", "xgb"),
    n_classes: int = 2, sizes: Sequence[float] = tuple(0.2 + 0.8 * i / 7 for i in range(8)), folds: int = 3,
    params: dict[str, dict] | None = None, plan: Plan = Plan(),
) -> DataFrame:
    """(model, size, split, auc_mean, auc_std): area on training and held-out rows by training size.

    A size takes the training rows whose hash falls below it, so larger sets contain smaller ones.
    """
    one = Plan(n_outer=folds, n_inner=plan.n_inner, use_smote=plan.use_smote, limits=plan.limits, seed=plan.seed)
    named = labels.withColumn("stratum", F.col("label")).select("row_id", "label", "stratum")
    _, design = build_design(long, features, named, one, "stratum", None, search=False)

    def job(spec: tuple[str, float, int]) -> DataFrame:
        model_id, size, fold = spec
        split = design.split_of(fold)
        train = design.rows(split, "train").where(hash_unit(F.lit(plan.seed), F.lit("size"), F.col("row_id")) <= size)
        if plan.use_smote and model_id not in models.NO_OVERSAMPLING:
            train = with_oversampling(train, plan.seed)
        fitted = _fit("classification", model_id, (params or {}).get(model_id, {}), train, n_classes, one)
        shown = [
            _scored(fitted, rows, "classification").withColumn("split", F.lit(name))
            for name, rows in (("train", train), ("validation", design.rows(split, "test")))
        ]
        return shown[0].unionByName(shown[1]).withColumn("model", F.lit(model_id)).withColumn(
            "size", F.lit(float(size))).withColumn("fold", F.lit(fold))

    jobs = [(m, s, f) for m in model_ids for s in sizes for f in range(folds)]
    with ThreadPoolExecutor(plan.parallelism) as pool:
        parts = list(pool.map(job, jobs))
    pred = parts[0]
    for p in parts[1:]:
        pred = pred.unionByName(p)
    keys = ["model", "size", "split", "fold"]
    area = metrics.auc(cut_lineage(pred), keys) if n_classes == 2 else metrics.auc_one_vs_rest(cut_lineage(pred), "probs", n_classes, keys)
    return area.groupBy("model", "size", "split").agg(F.avg("auc_roc").alias("auc_mean"), F.stddev_pop("auc_roc").alias("auc_std"))
