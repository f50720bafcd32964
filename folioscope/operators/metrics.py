"""Exact evaluation metrics over prediction tables.

Classification predictions: (fold, model, row_id, y_true, y_pred, y_prob); regression
predictions have doubles for y_true and y_pred. Curves and ranks run over distinct scores
with counts, spread over score ranges (see `ordered`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import safe_divide, two_sided_t_p
from folioscope.operators.ordered import average_ranks, combined, exact_quantiles, running_sums_and_offsets
from folioscope.session import cut_lineage

GRID_STEPS = 100
HISTOGRAM_BINS = 20
RUN = ["fold", "model"]


# ---- curves ----------------------------------------------------------------------------

def score_cells(known: DataFrame, keys: Sequence[str], label: str, score: str) -> DataFrame:
    """Positives and negatives of every distinct score of a group."""
    return combined(known, keys, score, {
        "pos": F.sum(F.col(label)).cast("bigint"), "neg": F.sum(1 - F.col(label)).cast("bigint")})


def score_steps(pred: DataFrame, keys: Sequence[str] = RUN, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    """One row per distinct score, best first: its positives and negatives, the sums of both
    before it and overall, and the counts of the next step (for dropping collinear points)."""
    keys = list(keys)
    known = pred.where(F.col(score).isNotNull())
    cells = score_cells(known.select(*keys, label, score), keys, label, score)
    steps, _ = running_sums_and_offsets(cells, keys, score, ["pos", "neg"], descending=True)
    heads = cells.groupBy(*keys, "shard").agg(
        F.max_by("pos", score).alias("_hp"), F.max_by("neg", score).alias("_hn")
    )
    by_shard = Window.partitionBy(*keys).orderBy(F.col("shard").desc())
    heads = heads.select(
        *keys, "shard", F.lead("_hp").over(by_shard).alias("_hp"), F.lead("_hn").over(by_shard).alias("_hn")
    )
    inside = Window.partitionBy(*keys, "shard").orderBy(F.col(score).desc())
    steps = steps.join(heads, [*keys, "shard"])
    return steps.withColumn("next_pos", F.coalesce(F.lead("pos").over(inside), "_hp")).withColumn(
        "next_neg", F.coalesce(F.lead("neg").over(inside), "_hn")
    ).drop("_hp", "_hn", "shard")


def auc_of_steps(steps: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Mann-Whitney area with ties counted half; NULL for one-class groups."""
    below = F.col("neg_all") - F.col("neg_before") - F.col("neg")
    won = F.sum(F.col("pos") * below + F.col("pos") * F.col("neg") / F.lit(2.0))
    return steps.groupBy(*keys).agg(
        safe_divide(won, F.max("pos_all").cast("double") * F.max("neg_all")).alias("auc_roc")
    )


def auc(pred: DataFrame, keys: Sequence[str] = RUN, label: str = "y_true", score: str = "y_prob") -> DataFrame:
    keys = list(keys)
    known = pred.where(F.col(score).isNotNull())
    cells = score_cells(known.select(*keys, label, score), keys, label, score)
    steps, _ = running_sums_and_offsets(cells, keys, score, ["pos", "neg"], descending=True)
    return auc_of_steps(steps, keys)


def roc_points(steps: DataFrame, keys: Sequence[str] = RUN, score: str = "y_prob", drop_collinear: bool = True) -> DataFrame:
    """(keys, fp, tp, n_neg, n_pos, fpr, tpr, threshold) with the start at (0, 0, infinity).

    Groups with one class have no curve.
    """
    two = steps.where((F.col("pos_all") > 0) & (F.col("neg_all") > 0))
    fp, tp = F.col("neg_before") + F.col("neg"), F.col("pos_before") + F.col("pos")
    first = (F.col("neg_before") + F.col("pos_before")) == 0
    last = F.col("next_pos").isNull()
    bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = two.where(first | last | bends) if drop_collinear else two
    points = kept.select(*keys, fp.alias("fp"), tp.alias("tp"), F.col("neg_all").alias("n_neg"),
                         F.col("pos_all").alias("n_pos"), F.col(score).alias("threshold"))
    start = two.where(first).select(
        *keys, F.lit(0).cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("tp"),
        F.col("neg_all").alias("n_neg"), F.col("pos_all").alias("n_pos"),
        F.lit(float("inf")).alias("threshold"),
    )
    return points.unionByName(start).withColumn("fpr", F.col("fp") / F.col("n_neg")).withColumn(
        "tpr", F.col("tp") / F.col("n_pos")
    )


def tpr_on_grid(points: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, step, tpr): the curve interpolated at step/100 false positive rate.

    Each curve point is the left neighbour of the first grid step at or after it and the right
    neighbour of the last step before it. Reducing the points to one per step and side first
    leaves at most 101 rows per curve for the fill, whatever the number of points; the
    comparison uses counts, so it is exact.
    """
    keys = list(keys)
    scaled = F.col("fp") * GRID_STEPS
    up = F.expr(f"(fp * {GRID_STEPS} + n_neg - 1) div n_neg")
    down = F.expr(f"(fp * {GRID_STEPS} - 1) div n_neg")
    at = F.struct(F.col("fp").cast("double").alias("x"), "tp")
    left = points.groupBy(*keys, up.alias("step")).agg(
        F.max(at).alias("l"), F.max("n_neg").alias("n_neg"), F.max("n_pos").alias("n_pos"))
    right = points.where(scaled > 0).groupBy(*keys, down.alias("step")).agg(F.min(at).alias("r"))
    curves = points.groupBy(*keys).agg(F.max("n_neg").alias("n_neg"), F.max("n_pos").alias("n_pos"))
    grid = curves.withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(GRID_STEPS).cast("bigint"))))
    joined = grid.join(left.select(*keys, "step", "l"), [*keys, "step"], "left").join(right, [*keys, "step"], "left")
    order = Window.partitionBy(*keys).orderBy("step")
    filled = joined.select(
        *keys, "step", "n_neg", "n_pos",
        F.max("l").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("l"),
        F.min("r").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("r"),
    )
    x = F.col("step") * F.col("n_neg") / F.lit(float(GRID_STEPS))
    slope = safe_divide(F.col("r.tp") - F.col("l.tp"), F.col("r.x") - F.col("l.x"))
    tp = F.col("l.tp") + F.coalesce(slope * (x - F.col("l.x")), F.lit(0.0))
    return filled.select(
        *keys, "step", F.when(F.col("step") == 0, 0.0).otherwise(tp / F.col("n_pos")).alias("tpr")
    )


def mean_roc(pred: DataFrame, fold: str = "fold", group: Sequence[str] = ("model",)) -> DataFrame:
    """(group, fpr, mean_tpr, std_tpr, mean_auc, std_auc) over the folds that have both classes."""
    group = list(group)
    keys = [fold, *group]
    # Read by the curve points, both sides of the grid and the areas: written once.
    steps = cut_lineage(score_steps(pred, keys))
    curve = tpr_on_grid(roc_points(steps, keys), keys).groupBy(*group, "step").agg(
        F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr"))
    area = auc_of_steps(steps, keys).where(F.col("auc_roc").isNotNull()).groupBy(*group).agg(
        F.avg("auc_roc").alias("mean_auc"), F.stddev_pop("auc_roc").alias("std_auc"))
    return curve.join(area, group).select(
        *group, (F.col("step") / F.lit(float(GRID_STEPS))).alias("fpr"),
        F.when(F.col("step") == GRID_STEPS, 1.0).otherwise(F.col("mean_tpr")).alias("mean_tpr"),
        "std_tpr", "mean_auc", "std_auc",
    )


def auc_one_vs_rest(pred: DataFrame, probs: str, n_classes: int, keys: Sequence[str] = RUN) -> DataFrame:
    """Macro mean of the one-vs-rest areas; NULL when a class is absent from a group."""
    keys = list(keys)
    # Tasks of even size first: a row becomes n_classes rows, and few small partitions would hold them all.
    dealt = pred.select(*keys, "y_true", probs).hint("rebalance")
    each = dealt.select(*keys, "y_true", F.posexplode(probs).alias("class", "y_prob")).withColumn(
        "y_true", (F.col("y_true") == F.col("class")).cast("int"))
    per_class = auc(each, [*keys, "class"])
    return per_class.groupBy(*keys).agg(
        F.when(F.count("auc_roc") == n_classes, F.avg("auc_roc")).alias("auc_roc"))


# ---- confusion and what follows from it ------------------------------------------------

def confusion_counts(pred: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, n_classes: int, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Counts summed over folds with every cell present."""
    keys = list(keys)
    cells = F.sequence(F.lit(0), F.lit(n_classes - 1))
    counts = confusion_counts(pred, keys)
    grid = counts.select(*keys).distinct().withColumn("y_true", F.explode(cells)).withColumn("y_pred", F.explode(cells))
    return grid.join(counts, [*keys, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_scores(pred: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """(keys, class, support, tp, predicted, recall, f1) for classes seen or predicted."""
    keys = list(keys)
    c = confusion_counts(pred, keys)
    hit = F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0)
    true = c.select(*keys, F.col("y_true").alias("class"), F.col("n").alias("support"), hit.alias("tp"), F.lit(0).cast("bigint").alias("predicted"))
    guess = c.select(*keys, F.col("y_pred").alias("class"), F.lit(0).cast("bigint").alias("support"), F.lit(0).cast("bigint").alias("tp"), F.col("n").alias("predicted"))
    per = true.unionByName(guess).groupBy(*keys, "class").agg(
        F.sum("support").alias("support"), F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"))
    return per.withColumn("recall", safe_divide(F.col("tp"), F.col("support"))).withColumn(
        "f1", F.coalesce(safe_divide(2 * F.col("tp"), F.col("support") + F.col("predicted")), F.lit(0.0)))


def classification_scores(pred: DataFrame, n_classes: int, keys: Sequence[str] = RUN, probs: str | None = None) -> DataFrame:
    """One row per (fold, model): area, balanced accuracy, F1s, sensitivity and specificity."""
    keys = list(keys)
    per = class_scores(pred, keys)
    binary = n_classes == 2

    def recall_of(label: int) -> Column:
        return F.max(F.when(F.col("class") == label, F.col("recall"))) if binary else F.lit(None).cast("double")

    table = per.groupBy(*keys).agg(
        F.avg("recall").alias("balanced_acc"), F.avg("f1").alias("f1_macro"),
        safe_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"),
        recall_of(1).alias("sensitivity"), recall_of(0).alias("specificity"),
    )
    area = auc(pred, keys) if binary else auc_one_vs_rest(pred, probs, n_classes, keys)
    return table.join(area, keys, "left").withColumn("n_classes", F.lit(n_classes))


# ---- regression ------------------------------------------------------------------------

def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate that is NULL, not an error, for constant input."""
    return safe_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def regression_errors(pred: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    err = F.col("y_pred") - F.col("y_true")
    return pred.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(F.abs(err)).alias("mae"),
        (1 - safe_divide(F.avg(err * err), F.var_pop("y_true"))).alias("r2"),
        pearson(F.col("y_true"), F.col("y_pred")).alias("pearson_r"),
    )


def spearman(pred: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    """Pearson correlation of average-tie ranks."""
    keys = list(keys)
    pairs = pred.groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    for c in ("y_true", "y_pred"):
        ranks = average_ranks(pred, keys, c, f"rank_{c}").select(*keys, c, f"rank_{c}", F.col("cnt_all").alias(f"all_{c}"))
        pairs = pairs.join(ranks, [*keys, c])
    # Average ranks always have mean (N + 1) / 2, so centred sums need no second pass.
    middle = (F.col("all_y_true") + 1) / F.lit(2.0)
    a, b = F.col("rank_y_true") - middle, F.col("rank_y_pred") - middle
    n = F.col("n")
    return pairs.groupBy(*keys).agg(
        safe_divide(F.sum(n * a * b), F.sqrt(F.sum(n * a * a)) * F.sqrt(F.sum(n * b * b))).alias("spearman_r"))


def regression_scores(pred: DataFrame, keys: Sequence[str] = RUN) -> DataFrame:
    keys = list(keys)
    both = regression_errors(pred, keys).join(spearman(pred, keys), keys)
    n = F.col("n").cast("double")
    return both.withColumn("spearman_p", two_sided_t_p(F.col("spearman_r"), n)).withColumn(
        "pearson_p", two_sided_t_p(F.col("pearson_r"), n))


def residual_rows(pred: DataFrame) -> DataFrame:
    return pred.withColumn("residual", F.col("y_pred") - F.col("y_true"))


def fitted_line(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Least-squares line of the prediction on the truth."""
    slope = safe_divide(F.covar_pop("y_true", "y_pred"), F.var_pop("y_true"))
    return pred.groupBy(*keys).agg(slope.alias("slope"), F.avg("y_pred").alias("_p"), F.avg("y_true").alias("_t")).select(
        *keys, "slope", (F.col("_p") - F.col("slope") * F.col("_t")).alias("intercept"))


def residual_histogram(pred: DataFrame, keys: Sequence[str] = ("model",), bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width counts; the largest residual belongs to the last bin."""
    keys = list(keys)
    res = residual_rows(pred)
    span = res.groupBy(*keys).agg(F.min("residual").alias("lo"), F.max("residual").alias("hi"))
    placed = res.join(span, keys).withColumn(
        "bin", F.when(F.col("lo") == F.col("hi"), F.lit(1)).otherwise(
            F.least(F.width_bucket("residual", F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))))
    return placed.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))


# ---- results over folds ----------------------------------------------------------------

def metric_summary(cv: DataFrame, metric: str) -> DataFrame:
    return cv.groupBy("model").agg(
        F.avg(metric).alias(f"{metric}_mean"), F.stddev_pop(metric).alias(f"{metric}_std"),
        F.stddev_samp(metric).alias(f"{metric}_std_sample"))


def leaderboard(cv: DataFrame, metric: str, lower_is_better: bool = False) -> DataFrame:
    board = metric_summary(cv, metric).drop(f"{metric}_std_sample")
    mean = F.col(f"{metric}_mean")
    return board.orderBy(mean.asc() if lower_is_better else mean.desc(), "model")


def best_model(cv: DataFrame, metric: str, lower_is_better: bool = False) -> DataFrame:
    """(model, value, best_params): best mean; ties by name; most frequent parameters."""
    means = cv.groupBy("model").agg(
        F.avg(metric).alias("value"), F.mode("best_params", True).alias("best_params"))
    sign = 1.0 if lower_is_better else -1.0
    return means.where(F.col("value").isNotNull()).agg(
        F.min(F.struct((F.col("value") * sign).alias("k"), "model", "value", "best_params")).alias("b")
    ).select("b.model", "b.value", "b.best_params")


def representative_rows(pred: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Per outcome (TP, TN, FP, FN) the row closest to the outcome's median probability."""
    keys = list(keys)
    guess = F.col("y_prob") >= 0.5
    outcome = (
        F.when((F.col("y_true") == 1) & guess, "TP").when((F.col("y_true") == 0) & ~guess, "TN")
        .when(F.col("y_true") == 0, "FP").otherwise("FN")
    )
    rows = pred.withColumn("outcome", outcome)
    med = exact_quantiles(rows, [*keys, "outcome"], "y_prob", {"median_prob": 0.5}).drop("n")
    away = F.abs(F.col("y_prob") - F.col("median_prob"))
    return rows.join(med, [*keys, "outcome"]).groupBy(*keys, "outcome").agg(
        F.min(F.struct(F.round(away, 12).alias("d"), "row_id", "y_prob", "median_prob")).alias("b")
    ).select(*keys, "outcome", "b.row_id", "b.y_prob", "b.median_prob")
