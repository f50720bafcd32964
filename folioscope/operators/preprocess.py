"""Leakage-safe feature selection and scaling.

The fitted state is a small table, one row per (fold, feature): missing share, median, scale,
the step that dropped the feature and its partner. All folds are fitted together from sums over
disjoint cells of rows (see `foldsums`); the fit depends neither on the model nor on its
parameters, so every candidate reuses it.

Input is long (row_id, feature, value). Feature names come from the schema, so a list of them
is metadata; anything of size features x features is bounded by the schema, not by the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import safe_divide
from folioscope.operators.foldsums import Marked, TrainingCells, block_products, cells_of_rows, fold_blocks, marked, pandas_blocks, picked_values
from folioscope.session import cut_lineage

# Thresholds and the texts of the report.
MAX_MISSING = 0.30
MAX_SAME_SHARE = 0.95
MAX_CORRELATION = 0.95
REASON_MISSING = "high_missingness (frac=%.2f)"
REASON_FLAT = "near_zero_variance"
REASON_CORRELATED = "high_correlation (|r|>%s)"
SCALE_FLOOR = 10 * 2.220446049250313e-16


@dataclass(frozen=True)
class Thresholds:
    missing: float = MAX_MISSING
    same_share: float = MAX_SAME_SHARE
    correlation: float = MAX_CORRELATION


def feature_list(long: DataFrame, features: Sequence[str]) -> DataFrame:
    spark = long.sparkSession
    return spark.createDataFrame([(f, i) for i, f in enumerate(features)], "feature string, position int")


# ---- column profile --------------------------------------------------------------------

def training_cells(rows: DataFrame | TrainingCells, fold: str = "fold") -> TrainingCells:
    return rows if isinstance(rows, TrainingCells) else cells_of_rows(rows, fold)


def column_profile(
    long: DataFrame, rows: DataFrame | TrainingCells, features: Sequence[str], fold: str = "fold"
) -> DataFrame:
    """Per (fold, feature): counts, median of the present values, quartiles after the median
    has replaced the missing ones, and the largest share of one value after and before that.
    """
    held = marked(row_vectors(long, features), training_cells(rows, fold), len(features))
    return profile_of(held, features, fold)


def profile_of(held: Marked, features: Sequence[str], fold: str = "fold") -> DataFrame:
    """Sorting `n` present values and `m` copies of their median gives positions that follow
    from n and m alone, so one pass serves before and after imputation."""
    spark = held.vectors.sparkSession
    totals: dict[int, int] = {f: 0 for f in held.cells.folds}
    for f, c in held.cells.members:
        totals[f] += held.sizes.get(c, 0)
    sizes = spark.createDataFrame(list(totals.items()), "fold int, n_rows bigint")
    n, m = F.col("n"), F.col("n_rows") - F.col("n")
    low = F.floor((n - 1) / 2).cast("bigint")
    high = F.ceil((n - 1) / 2).cast("bigint")

    def present_index(t: Column) -> Column:
        return F.when(t <= low, t).when(t > low + m, t - m)

    wanted = {"x_low": low, "x_high": high}
    for q in (25, 75):
        h = (F.col("n_rows") - 1) * (q / 100)
        wanted[f"q{q}_lo"] = present_index(F.floor(h).cast("bigint"))
        wanted[f"q{q}_hi"] = present_index(F.ceil(h).cast("bigint"))
    picked = picked_values(held, wanted, sizes)

    frac = {q: (F.col("n_rows") - 1) * (q / 100) for q in (25, 75)}

    def quartile(q: int) -> Column:
        lo = F.coalesce(F.col(f"q{q}_lo"), F.col("median"))
        hi = F.coalesce(F.col(f"q{q}_hi"), F.col("median"))
        return lo + (hi - lo) * (frac[q] - F.floor(frac[q]))

    missing = F.col("n_rows") - F.col("n")
    at_median = F.when(F.col("x_low") == F.col("x_high"), F.col("cnt_low")).otherwise(0)
    imputed_top = F.when(missing > 0, F.greatest(F.col("top"), at_median + missing)).otherwise(F.col("top"))
    grid = F.broadcast(feature_list(held.vectors, features))
    every = sizes.withColumn("_one", F.lit(1)).join(grid.withColumn("_one", F.lit(1)), "_one").drop("_one")
    full = every.join(picked, ["fold", "position"], "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn(
        "median", (F.col("x_low") + F.col("x_high")) / 2)
    return full.select(
        F.col("fold").alias(fold), "feature", "position", "n_rows", "n", "median",
        (missing / F.col("n_rows")).alias("missing_frac"),
        safe_divide(F.col("top"), F.col("n")).alias("same_share"),
        safe_divide(imputed_top, F.col("n_rows")).alias("imputed_same_share"),
        quartile(25).alias("q25"), quartile(75).alias("q75"),
    )


# ---- correlation -----------------------------------------------------------------------

def row_vectors(long: DataFrame, features: Sequence[str], key: str = "row_id") -> DataFrame:
    """(key, x): one array per row in feature order, NULL where a value is missing.

    Present values are sorted by position and the gaps between them filled, which is linear in
    the number of features. A feature given twice for a row is an error.
    """
    places = feature_list(long, features)
    cells = long.select(key, "feature", "value").where(F.col("value").isNotNull())
    packed = cells.join(F.broadcast(places), "feature").groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("position", F.col("value").cast("double").alias("value")))).alias("_e"))
    empty = F.lit(None).cast("double")

    def with_gap(e: Column, k: Column) -> Column:
        gap = e["position"] - F.coalesce(F.get(F.col("_e"), k - 1)["position"], F.lit(-1)) - 1
        return F.when(gap < 0, F.raise_error(F.lit("a feature occurs twice in a row"))).otherwise(
            F.concat(F.array_repeat(empty, gap), F.array(e["value"])))

    rest = F.lit(len(features) - 1) - F.element_at("_e", -1)["position"]
    return packed.select(key, F.concat(F.flatten(F.transform("_e", with_gap)), F.array_repeat(empty, rest)).alias("x"))


def correlations(n, sx, sy, sxx, syy, sxy) -> np.ndarray:
    """Pearson r from sums; NaN when either side is constant."""
    with np.errstate(invalid="ignore", divide="ignore"):
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        # A variance below the rounding error of its two terms is zero.
        flat = (vx <= 1e-12 * n * sxx) | (vy <= 1e-12 * n * syy)
        return np.where(flat, np.nan, (n * sxy - sx * sy) / (np.sqrt(np.maximum(vx, 0)) * np.sqrt(np.maximum(vy, 0))))


def pearson_matrix(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, r) over the rows where both are present, a before b."""
    width = len(features)
    held = marked(row_vectors(long, features), cells_of_rows(long.select("row_id").distinct().withColumn("fold", F.lit(0))), width)
    block = held.block
    means = {r["feature"]: r["c"] for r in long.groupBy("feature").agg(F.avg("value").alias("c")).collect()}  # schema-sized
    products = block_products(held, [means.get(f) or 0.0 for f in features], squares=True)

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        _, i, j, (uu, ub, bu, bb, uub, buu) = pandas_blocks(pdf, width, block)
        r = correlations(bb, ub, bu, uub, buu, uu)
        a, b = (x.ravel() for x in np.indices(r.shape))
        a, b, r = a + i, b + j, r.ravel()
        out = pd.DataFrame({"i": a.astype(np.int32), "j": b.astype(np.int32), "r": r})[a < b]
        return out.astype({"r": object}).where(out.notna(), None) if out["r"].isna().any() else out

    found = fold_blocks(products, held).groupBy("fold", "i", "j").applyInPandas(pairs, "i int, j int, r double")
    names = feature_list(long, features)
    a = names.select(F.col("feature").alias("feature_a"), F.col("position").alias("i"))
    b = names.select(F.col("feature").alias("feature_b"), F.col("position").alias("j"))
    return found.join(F.broadcast(a), "i").join(F.broadcast(b), "j").select("feature_a", "feature_b", F.nanvl("r", F.lit(None).cast("double")).alias("r"))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Keep features in order, dropping the later neighbours of every kept one."""
    order = pdf.sort_values(["rank_a", "rank_b"], kind="stable")
    gone: dict[int, int] = {}
    for a, b in zip(order["rank_a"], order["rank_b"]):
        if a not in gone and b not in gone:
            gone[b] = a
    fold = pdf.iloc[0, 0]
    return pd.DataFrame({
        pdf.columns[0]: np.full(len(gone), fold, dtype=np.int32),
        "rank_b": np.array(list(gone.keys()), dtype=np.int32),
        "rank_a": np.array(list(gone.values()), dtype=np.int32),
    })


def correlated_features(held: Marked, base: DataFrame, features: Sequence[str], threshold: float, fold: str = "fold") -> DataFrame:
    """(fold, feature, correlated_with) of the features to drop.

    `base` has (fold, feature, position, median, n_rows, _step); features without a _step are in
    play, missing values stand at the fold's median. Features are visited by falling variance,
    ties in feature order; the edges one task walks are at most features squared, whatever the
    number of rows.
    """
    spark, width, block = base.sparkSession, len(features), held.block
    state = base.select(fold, "position", "median", "n_rows", F.col("_step").isNull().alias("free")).toPandas()  # folds x features
    centres = np.array([state["median"][state["position"] == p].dropna().mean() for p in range(width)])
    centres = np.nan_to_num(centres)
    # Read twice below; cells x features squared at most.
    products = cut_lineage(block_products(held, centres))
    shifts, counts, free = {}, {}, {}
    for f, part in state.sort_values("position").groupby(fold):
        shifts[int(f)] = np.nan_to_num(part["median"].to_numpy(float) - centres)
        counts[int(f)] = float(part["n_rows"].iloc[0])
        free[int(f)] = part["free"].to_numpy(bool)

    def own_sums(pdf: pd.DataFrame) -> pd.DataFrame:
        """Sums of x and x squared about the fold's median, from the diagonal blocks."""
        f, i, _, (uu, ub, _, bb) = pandas_blocks(pdf, width, block)
        d, n, s = shifts[f][i:i + len(uu)], np.diag(bb), np.diag(ub)
        return pd.DataFrame({"fold": np.int32(f), "position": np.arange(i, i + len(uu), dtype=np.int32),
                             "s1": s - d * n, "s2": np.diag(uu) - 2 * d * s + d * d * n})

    blocks = fold_blocks(products, held)
    sums = blocks.where("i = j").groupBy("fold", "i", "j").applyInPandas(own_sums, "fold int, position int, s1 double, s2 double").toPandas()
    order: dict[int, np.ndarray] = {}
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for f, part in sums.sort_values("position").groupby("fold"):
        s1, s2 = part["s1"].to_numpy(), part["s2"].to_numpy()
        ones[int(f)] = s1, s2
        var = s2 / counts[int(f)] - (s1 / counts[int(f)]) ** 2
        # Eleven digits, so rounding noise cannot reorder features of equal variance.
        level = np.array([float("%.10e" % v) for v in var])
        rank = np.zeros(width, np.int32)
        rank[np.lexsort((np.arange(width), -level))] = np.arange(1, width + 1)
        order[int(f)] = rank

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        f, i, j, (uu, ub, bu, bb) = pandas_blocks(pdf, width, block)
        left, right = slice(i, i + uu.shape[0]), slice(j, j + uu.shape[1])
        d, e = shifts[f][left][:, None], shifts[f][right][None, :]
        sxy = uu - e * ub - d * bu + d * e * bb
        (s1, s2), n = ones[f], counts[f]
        r = correlations(n, s1[left][:, None], s1[right][None, :], s2[left][:, None], s2[right][None, :], sxy)
        strong = (np.abs(np.nan_to_num(r)) > threshold) & free[f][left][:, None] & free[f][right][None, :]
        if i == j:
            strong = np.triu(strong, 1)
        a, b = np.nonzero(strong)
        ra, rb = order[f][left][a], order[f][right][b]
        return pd.DataFrame({"fold": np.full(len(a), f, np.int32), "rank_a": np.minimum(ra, rb), "rank_b": np.maximum(ra, rb)})

    strong = blocks.groupBy("fold", "i", "j").applyInPandas(edges, "fold int, rank_a int, rank_b int")
    dropped = strong.groupBy("fold").applyInPandas(_walk, "fold int, rank_b int, rank_a int")
    ranked = spark.createDataFrame(
        [(f, int(r), features[p]) for f, rank in order.items() for p, r in enumerate(rank)], "fold int, rank int, feature string")
    b = ranked.select("fold", F.col("rank").alias("rank_b"), "feature")
    a = ranked.select("fold", F.col("rank").alias("rank_a"), F.col("feature").alias("correlated_with"))
    return dropped.join(b, ["fold", "rank_b"]).join(a, ["fold", "rank_a"]).select(F.col("fold").alias(fold), "feature", "correlated_with")


# ---- the chain -------------------------------------------------------------------------

def fit_filters(
    long: DataFrame, rows: DataFrame | TrainingCells, features: Sequence[str], limits: Thresholds = Thresholds(),
    fold: str = "fold",
) -> DataFrame:
    """Fit all five steps for every fold at once.

    `long` is (row_id, feature, value); `rows` the disjoint cells of rows and the folds they make
    up, or (row_id, fold) with one row per row and fold it trains in. Returns (fold, feature, position, missing_frac, same_share, median, scale,
    dropped_by, correlated_with); `dropped_by` is NULL for kept features.
    """
    held = marked(row_vectors(long, features), training_cells(rows, fold), len(features))
    profile = profile_of(held, features, fold)
    iqr = F.col("q75") - F.col("q25")
    step = (
        F.when(F.col("missing_frac") > limits.missing, "missingness")
        .when(F.col("imputed_same_share") > limits.same_share, "near_constant")
    )
    # Read by later steps and no larger than folds x features: written once.
    base = cut_lineage(profile.select(
        fold, "feature", "position", "n_rows", "missing_frac", F.col("imputed_same_share").alias("same_share"), "median",
        F.when(iqr > SCALE_FLOOR, iqr).otherwise(F.lit(1.0)).alias("scale"), step.alias("_step"),
    ))
    linked = correlated_features(held, base, features, limits.correlation, fold)
    return base.join(linked, [fold, "feature"], "left").select(
        fold, "feature", "position", "missing_frac", "same_share", "median", "scale",
        F.coalesce("_step", F.when(F.col("correlated_with").isNotNull(), "correlation")).alias("dropped_by"),
        "correlated_with",
    )


def apply_filters(long: DataFrame, rows: DataFrame, state: DataFrame, fold: str = "fold") -> DataFrame:
    """(fold, row_id, feature, value): imputed, filtered and scaled values.

    `rows` names the (row_id, fold) to produce; missing cells of `long` are filled in.
    """
    kept = state.where(F.col("dropped_by").isNull()).select(fold, "feature", "position", "median", "scale")
    # One row per fold and feature: the schema bounds it, so it is small whatever the rows.
    cells = rows.select("row_id", fold).join(F.broadcast(kept), fold)
    joined = cells.join(long, ["row_id", "feature"], "left")
    return joined.select(
        fold, "row_id", "feature", "position",
        ((F.coalesce("value", "median") - F.col("median")) / F.col("scale")).alias("value"))


def transform_vectors(vectors: DataFrame, state: DataFrame, fold: str = "fold", out: str = "features") -> DataFrame:
    """Apply the state to array rows (fold, x, …) without a shuffle: adds `out` as array."""
    arrays = state.where(F.col("dropped_by").isNull()).groupBy(fold).agg(
        F.array_sort(F.collect_list(F.struct("position", "median", "scale"))).alias("_kept"))
    joined = vectors.join(F.broadcast(arrays), fold)
    filled = F.transform("_kept", lambda k: (
        F.coalesce(F.get(F.col("x"), k["position"]), k["median"]) - k["median"]) / k["scale"])
    return joined.withColumn(out, filled).drop("_kept")


def kept_features(state: DataFrame, fold: str = "fold") -> DataFrame:
    """Feature names that survive every step, in input order."""
    return state.where(F.col("dropped_by").isNull()).select(fold, "position", "feature")


def selection_report(state: DataFrame, limits: Thresholds = Thresholds(), fold: str = "fold") -> DataFrame:
    """(feature, reason, correlated_with) of every dropped feature."""
    reason = (
        F.when(F.col("dropped_by") == "missingness", F.format_string(REASON_MISSING, "missing_frac"))
        .when(F.col("dropped_by") == "near_constant", F.lit(REASON_FLAT))
        .otherwise(F.lit(REASON_CORRELATED % limits.correlation))
    )
    return state.where(F.col("dropped_by").isNotNull()).select(
        "feature", reason.alias("reason"), F.coalesce("correlated_with", F.lit("")).alias("correlated_with"))


def whole_data(rows: DataFrame, key: str = "row_id", fold: str = "fold") -> DataFrame:
    """All rows as the training rows of a single fold 0."""
    return rows.select(key, F.lit(0).alias(fold))
