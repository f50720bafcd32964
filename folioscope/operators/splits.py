"""Target checks, strata, folds and class weights.

Folds come from an md5 of the seed and the row id, so the same rows always land in the same
fold, in any engine and after any re-run. Row numbers are built in two levels: inside one of
4096 hash slots of a stratum and over the slot sizes, so no window ever holds a whole stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.scalars import clean_double, is_label
from folioscope.operators.ordered import exact_quantiles

# Gates, bin names and the suffix of rows without a score.
MIN_ROWS = 10
MIN_CLASSES = 2
TERTILES = ["low", "med", "high"]
NO_SCORE = "noados"


def attach_single(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a table that is one row by construction."""
    return df.withColumn("_one", F.lit(1)).join(
        F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


# ---- targets ---------------------------------------------------------------------------

def target_types(df: DataFrame, targets: Sequence[str]) -> DataFrame:
    """(target, task): text columns and columns without a single number are class labels."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType))}
    counted = df.agg(*[F.count(clean_double(t)).alias(t) for t in targets])
    long = counted.unpivot([], list(targets), "target", "n_numbers")
    return long.select(
        "target",
        F.when(F.col("target").isin(*text, "") | (F.col("n_numbers") == 0), "classification")
        .otherwise("regression").alias("task"),
    )


def valid_target(c: str, task: str) -> Column:
    return is_label(c) if task == "classification" else clean_double(c).isNotNull()


def target_gate(df: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """(target, task, n_valid, n_classes, skip_reason), all targets in one pass."""
    aggs = []
    for t, task in tasks.items():
        ok = valid_target(t, task)
        aggs.append(F.count_if(ok).alias(f"n:{t}"))
        classes = F.count_distinct(F.when(ok, F.col(t).cast("string"))) if task == "classification" else F.lit(None).cast("bigint")
        aggs.append(classes.alias(f"c:{t}"))
    one = df.agg(*aggs)
    parts = []
    for t, task in tasks.items():
        parts += [F.lit(t), F.lit(task), F.col(f"`n:{t}`"), F.col(f"`c:{t}`")]
    rows = one.select(F.stack(F.lit(len(tasks)), *parts).alias("target", "task", "n_valid", "n_classes"))
    return rows.withColumn(
        "skip_reason",
        F.when(F.col("n_valid") < MIN_ROWS, F.lit("too few valid rows"))
        .when(F.col("n_classes") < MIN_CLASSES, F.lit("only one class")),
    )


# ---- strata ----------------------------------------------------------------------------

def _equal_width(v: Column, lo: Column, hi: Column, bins: int) -> Column:
    width = (hi - lo) / bins
    inside = sum((F.when(v > lo + width * i, 1).otherwise(0) for i in range(1, bins)), F.lit(0))
    return F.when(lo == hi, F.lit(bins // 2)).otherwise(inside)


def _bin_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    probs = {f"_e{i}": i / bins for i in range(bins + 1)}
    return exact_quantiles(df, [], value, probs).select(F.array(*probs).alias("_edges"))


def tertile_bins(df: DataFrame, value: str, out: str = "bin") -> DataFrame:
    """low / med / high by interpolated tertiles, right-closed; ties stay together.

    Coinciding edges leave fewer than three quantile bins; then equal widths are used.
    """
    joined = attach_single(df, _bin_edges(df, value, 3))
    e = [F.get("_edges", F.lit(i)) for i in range(4)]
    v = F.col(value)
    by_quantile = F.when(v <= e[1], 0).when(v <= e[2], 1).otherwise(2)
    distinct = F.size(F.array_distinct("_edges")) == 4
    number = F.when(distinct, by_quantile).otherwise(_equal_width(v, e[0], e[3], 3))
    names = F.array(*[F.lit(t) for t in TERTILES])
    return joined.withColumn(out, F.when(v.isNotNull(), F.get(names, number))).drop("_edges")


def quantile_bins(df: DataFrame, value: str, bins: int = 5, out: str = "bin") -> DataFrame:
    """0-based quantile bin; coinciding edges collapse, missing values get -1."""
    joined = attach_single(df, _bin_edges(df, value, bins))
    edges = F.array_distinct("_edges")
    v = F.col(value)
    number = sum(
        (F.when(v > F.get("_distinct", F.lit(i)), 1).otherwise(0) for i in range(1, bins)), F.lit(0)
    )
    return (
        joined.withColumn("_distinct", edges)
        .withColumn(out, F.when(v.isNull() | (F.size("_distinct") < 2), F.lit(-1)).otherwise(number))
        .drop("_edges", "_distinct")
    )


def joint_stratum(df: DataFrame, label: str, score: str, out: str = "stratum") -> DataFrame:
    """`{label}_{tertile}`; rows without a score get their own suffix."""
    binned = tertile_bins(df.withColumn("_score", clean_double(score)), "_score", "_bin")
    return binned.withColumn(
        out, F.concat_ws("_", F.col(label), F.coalesce(F.col("_bin"), F.lit(NO_SCORE)))
    ).drop("_score", "_bin")


# ---- folds -----------------------------------------------------------------------------

def stratified_folds(
    rows: DataFrame, key: str, stratum: str, k: int, seed: int = 42, fold: str = "fold",
    within: Sequence[str] = (),
) -> DataFrame:
    """Seeded shuffled folds; class counts of two folds differ by at most one.

    `within` splits each of its groups separately (inner folds of every outer fold).
    """
    within = list(within)
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    tagged = rows.withColumn("_h", digest).withColumn(
        "_slot", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")
    )
    slots = tagged.groupBy(*within, stratum, "_slot").agg(F.count(F.lit(1)).alias("_n"))
    classes = slots.groupBy(*within, stratum).agg(F.sum("_n").alias("_class_n"))
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    before = (Window.unboundedPreceding, -1)
    classes = classes.select(
        *within, stratum,
        F.coalesce(F.sum("_class_n").over(group.orderBy(stratum).rowsBetween(*before)), F.lit(0)).alias("_class_base"),
    )
    slots = slots.select(
        *within, stratum, "_slot",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(*within, stratum).orderBy("_slot").rowsBetween(*before)), F.lit(0)
        ).alias("_slot_base"),
    ).join(classes, [*within, stratum])
    in_slot = Window.partitionBy(*within, stratum, "_slot").orderBy("_h", key)
    numbered = tagged.withColumn("_rn", F.row_number().over(in_slot) - 1).join(
        slots, [*within, stratum, "_slot"]
    )
    position = F.col("_class_base") + F.col("_slot_base") + F.col("_rn")
    return numbered.withColumn(fold, F.pmod(position, F.lit(k)).cast("int")).select(*rows.columns, fold)


def shuffled_folds(rows: DataFrame, key: str, k: int, seed: int = 42, fold: str = "fold", within: Sequence[str] = ()) -> DataFrame:
    one = stratified_folds(rows.withColumn("_all", F.lit(0)), key, "_all", k, seed, fold, within)
    return one.drop("_all")


def training_rows(folded: DataFrame, k: int, fold: str = "fold", out: str = "outer_fold") -> DataFrame:
    """Every row once per fold it trains in."""
    others = F.array_except(F.sequence(F.lit(0), F.lit(k - 1)), F.array(fold))
    return folded.withColumn(out, F.explode(others))


def nested_folds(
    rows: DataFrame, key: str, stratum: str | None, n_outer: int, n_inner: int, seed: int = 42,
    inner_stratum: str | None = None,
) -> DataFrame:
    """(key, outer_fold, inner_fold) of every training row of every outer fold."""
    outer = stratified_folds(rows, key, stratum, n_outer, seed, "_fold")
    train = training_rows(outer, n_outer, "_fold", "outer_fold")
    if inner_stratum is None:
        return shuffled_folds(train, key, n_inner, seed, "inner_fold", ["outer_fold"]).drop("_fold")
    return stratified_folds(train, key, inner_stratum, n_inner, seed, "inner_fold", ["outer_fold"]).drop("_fold")


# ---- class sizes -----------------------------------------------------------------------

def class_counts(rows: DataFrame, label: str, within: Sequence[str] = ()) -> DataFrame:
    return rows.groupBy(*within, label).agg(F.count(F.lit(1)).alias("n"))


def balanced_weights(rows: DataFrame, label: str, within: Sequence[str] = (), out: str = "weight") -> DataFrame:
    """(within, label, n, weight) with weight = rows / (classes x class rows)."""
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    n = class_counts(rows, label, within)
    return n.withColumn(
        out, F.sum("n").over(group) / (F.count(F.lit(1)).over(group) * F.col("n"))
    )


def oversampling_neighbours(rows: DataFrame, label: str, within: Sequence[str] = (), most: int = 5) -> DataFrame:
    """Neighbour count for oversampling: at most `most`, below the smallest class, at least 1."""
    n = class_counts(rows, label, within)
    return n.groupBy(*within).agg(F.min("n").alias("smallest_class")).withColumn(
        "k_neighbors", F.greatest(F.lit(1), F.least(F.lit(most), F.col("smallest_class") - 1)).cast("int")
    )
