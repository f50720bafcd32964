"""Paired comparison of models over folds. Inputs are (fold, model, metric) tables, one row
per fold and model, so every list below holds at most one entry per fold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def model_pairs(cv: DataFrame, metric: str) -> DataFrame:
    """(fold, m1, m2, v1, v2) for m1 < m2, paired by fold."""
    a = cv.select("fold", F.col("model").alias("m1"), F.col(metric).alias("v1"))
    b = cv.select("fold", F.col("model").alias("m2"), F.col(metric).alias("v2"))
    return a.join(b, "fold").where(F.col("m1") < F.col("m2"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """Two-sided signed-rank p per pair of models.

    Fewer than two folds, or values that are all close, give p = 1. Zero differences are
    dropped. The p-value is exact for any number of folds: the distribution of the rank sum
    under random signs is built up rank by rank (doubled, so that average ranks are whole).
    """
    d = F.round(F.col("v1") - F.col("v2"), 12)
    close = F.abs(F.col("v1") - F.col("v2")) <= 1e-8 + 1e-5 * F.abs(F.col("v2"))
    marked = pairs.withColumn("d", d).withColumn("_close", close)
    w = Window.partitionBy("m1", "m2", F.col("d") != 0).orderBy(F.abs("d"))
    same = Window.partitionBy("m1", "m2", F.col("d") != 0, F.abs("d"))
    ranked = marked.withColumn(
        "r", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / F.lit(2.0))
    used = F.col("d") != 0
    per = ranked.groupBy("m1", "m2").agg(
        F.count(F.lit(1)).alias("folds"), F.bool_and("_close").alias("all_close"),
        F.count_if(used).alias("n"),
        F.coalesce(F.sum(F.when(F.col("d") > 0, F.col("r"))), F.lit(0.0)).alias("w_plus"),
        F.collect_list(F.when(used, F.col("r"))).alias("ranks"),
    )
    doubled = F.transform("ranks", lambda r: F.round(2 * r).cast("int"))
    per = per.withColumn("doubled", doubled).withColumn(
        "total", F.aggregate("doubled", F.lit(0), lambda acc, r: acc + r))
    plus = F.round(2 * F.col("w_plus")).cast("int")
    far = F.greatest(plus, F.col("total") - plus)
    none = F.transform(F.sequence(F.lit(0), F.col("total")), lambda s: F.when(s == 0, 1.0).otherwise(0.0))

    def with_rank(chances, r):
        return F.transform(chances, lambda c, s: 0.5 * c + F.when(s >= r, 0.5 * F.get(chances, s - r)).otherwise(0.0))

    tail = F.slice(F.aggregate("doubled", none, with_rank), far + 1, F.col("total") + 1)
    exact = F.least(F.lit(1.0), 2.0 * F.aggregate(tail, F.lit(0.0), lambda acc, c: acc + c))
    return per.select(
        "m1", "m2",
        F.when((F.col("folds") < 2) | F.col("all_close") | (F.col("n") == 0), F.lit(1.0))
        .otherwise(exact).alias("p"),
    )


def bonferroni(pvalues: DataFrame) -> DataFrame:
    n_pairs = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return pvalues.withColumn("p_bonf", F.least(F.col("p") * n_pairs, F.lit(1.0)))


def comparison_table(cv: DataFrame, metric: str, models: Sequence[str], lower_is_better: bool = False) -> DataFrame:
    """(model, mean, std, p_vs_{other}_bonf …), best model first."""
    adjusted = bonferroni(wilcoxon(model_pairs(cv, metric)))
    both = adjusted.select(F.col("m1").alias("model"), F.col("m2").alias("other"), "p_bonf").unionByName(
        adjusted.select(F.col("m2").alias("model"), F.col("m1").alias("other"), "p_bonf"))
    wide = both.groupBy("model").pivot("other", list(models)).agg(F.first("p_bonf"))
    wide = wide.select("model", *[F.col(m).alias(f"p_vs_{m}_bonf") for m in models])
    mean = cv.groupBy("model").agg(F.avg(metric).alias(f"{metric}_mean"), F.stddev_pop(metric).alias(f"{metric}_std"))
    order = F.col(f"{metric}_mean")
    return mean.join(wide, "model", "left").orderBy(order.asc() if lower_is_better else order.desc(), "model")
