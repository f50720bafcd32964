"""SHAP-style attributions and the tables read off them.

Attributions are long: (row_id, feature, shap, feature_value). Trees are read back from the
saved model as node rows and turned into one row per leaf by tasks; a leaf contributes
val * (o_j - z_j) * integral over t in [0, 1] of prod_{k != j} (z_k + (o_k - z_k) t) to feature
j, where o is 1 if the row satisfies the leaf's conditions on a feature and z is the share of
training rows that does. The integrand is a polynomial, so Gauss-Legendre points are exact.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import hash_int, safe_divide, shorten
from folioscope.operators.models import Fitted
from folioscope.session import cut_lineage, shared_folder

# How many features each view shows.
TOP_GLOBAL = 20
TOP_DEPENDENCE = 5
TOP_WATERFALL = 15
BACKGROUND_ROWS = 100
BACKGROUND_CENTRES = 50
COALITIONS = 200


# ---- trees -----------------------------------------------------------------------------

PACK_BYTES = 32 << 20
PACK_ROWS = 64

# Matrix cells of rows x features that the correlation sums hold at a time.
BATCH_CELLS = 1 << 21


def tree_nodes(model, spark) -> DataFrame:
    """Node rows of a fitted tree ensemble, read back from its saved form."""
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select("treeID", "nodeData.*")
    else:
        data = data.withColumn("treeID", F.lit(0))
    return data.select(
        "treeID", "id", "prediction", "impurityStats", "rawCount", "leftChild", "rightChild",
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
    )


LEAF = "member int, tree int, leaf int, features array<int>, low array<double>, high array<double>, share array<double>, value array<double>"


def leaf_rows(nodes: DataFrame, member: int, weights: Sequence[float], classes: bool) -> DataFrame:
    """A row for each leaf: per feature on its path an open-closed interval and the share of
    training rows that meets it, and the leaf's outputs. Each tree is walked by one task."""

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = {int(r.id): r for r in pdf.itertuples(index=False)}
        tree = int(pdf["treeID"].iloc[0])

        def cover(r) -> float:
            return float(np.sum(r.impurityStats)) if classes else float(r.rawCount)

        out, stack = [], [(0, {})]
        while stack:
            at, seen = stack.pop()
            r = rows[at]
            if r.leftChild < 0:
                value = np.asarray(r.impurityStats, float) / max(np.sum(r.impurityStats), 1e-300) if classes else np.array([r.prediction])
                names = sorted(seen)
                out.append((member, tree, len(out), names, *([seen[f][k] for f in names] for k in range(3)), (value * weights[tree]).tolist()))
                continue
            whole = cover(r)
            for child, left in ((int(r.leftChild), True), (int(r.rightChild), False)):
                lo, hi, share = seen.get(int(r.feature), (-np.inf, np.inf, 1.0))
                share *= cover(rows[child]) / whole if whole else 0.5
                bounds = (lo, min(hi, r.threshold), share) if left else (max(lo, r.threshold), hi, share)
                stack.append((child, {**seen, int(r.feature): bounds}))
        return pd.DataFrame(out, columns=[c.split()[0] for c in LEAF.split(", ")])

    return nodes.groupBy("treeID").applyInPandas(walk, LEAF)


def leaf_attributions(x: np.ndarray, features: np.ndarray, low: np.ndarray, high: np.ndarray, share: np.ndarray, value: np.ndarray) -> np.ndarray:
    """(rows, features, outputs) attributions of leaves that have equally many features: arrays
    (leaves, features on the path) and (leaves, outputs)."""
    n_leaves, d = features.shape
    width, outputs = x.shape[1], value.shape[1]
    t, w = np.polynomial.legendre.leggauss(d // 2 + 1)
    t, w = (t + 1) / 2, w / 2
    phi = np.zeros((len(x), width, outputs))
    step = max(1, (1 << 21) // (len(x) * d * len(t)))
    for start in range(0, n_leaves, step):
        some = slice(start, start + step)
        at = features[some]
        v = x[:, at]  # rows, leaves, path
        gap = ((v > low[some]) & (v <= high[some])) - share[some]
        factor = share[some][None, :, :, None] + gap[..., None] * t
        part = ((factor.prod(axis=2)[:, :, None, :] / factor) @ w) * gap
        spread = np.zeros((at.size, width))
        spread[np.arange(at.size), at.ravel()] = 1.0
        for k in range(outputs):
            phi[:, :, k] += (part * value[some][None, :, None, k]).reshape(len(x), -1) @ spread
    return phi


def tree_attributions(fitted: Fitted, rows: DataFrame, features: Sequence[str]) -> tuple[DataFrame, float]:
    """Path-dependent attributions of dt, rf, xgb and lgbm models and the base value.

    Explained output: the class probability for trees and forests (positive class; mean
    absolute value over classes beyond two), the log-odds for boosted classes, the prediction
    for values. The base value is NaN where signs were averaged away.

    Rows and leaves are dealt to a grid of packs of about `PACK_BYTES`; a task multiplies one
    pack of rows by one of leaves, and the parts of a row are summed. Neither rows nor leaves
    are gathered.
    """
    spark = rows.sparkSession
    model = fitted.stages[0]
    boosted = fitted.model_id in ("xgb", "lgbm")
    if boosted and fitted.n_classes > 2:
        members = [(m, 2.0) for m in model.models]
    else:
        members = [(model, 2.0 if boosted and fitted.n_classes else 1.0)]
    classes = bool(fitted.n_classes) and not boosted
    leaves = None
    for number, (m, scale) in enumerate(members):
        n_trees = m.getNumTrees if hasattr(m, "getNumTrees") else 1
        n_trees = n_trees() if callable(n_trees) else n_trees
        weights = list(m.treeWeights) if hasattr(m, "treeWeights") else [1.0]
        share = 1.0 if boosted else 1.0 / n_trees
        own = leaf_rows(tree_nodes(m, spark), number, [w * share * scale for w in weights], classes)
        leaves = own if leaves is None else leaves.unionAll(own)
    leaves = cut_lineage(leaves)
    per = fitted.n_classes if classes else 1
    outputs = per * len(members)
    names, width = list(features), len(features)
    signed = len(members) == 1 and outputs <= 2

    size = leaves.agg(F.sum(28 * F.size("features") + 8 * F.size("value") + 32)).first()[0] or 0
    n = rows.count()
    leaf_packs = -(-size // PACK_BYTES) or 1
    row_packs = max(1, -(-n * width * 8 // PACK_BYTES), min(spark.sparkContext.defaultParallelism, n // PACK_ROWS))
    row_type = rows.schema["row_id"].dataType.simpleString()
    left = rows.select("row_id", vector_to_array("features").alias("x")).withColumn("a", F.pmod(F.xxhash64("row_id"), F.lit(row_packs))).withColumn(
        "b", F.explode(F.sequence(F.lit(0), F.lit(leaf_packs - 1))))
    right = leaves.withColumn("b", F.pmod(F.xxhash64("member", "tree", "leaf"), F.lit(leaf_packs)).cast("int")).withColumn(
        "a", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(row_packs - 1).cast("long"))))

    def explain(some, packed):
        if not some.num_rows or not packed.num_rows:
            return pa.table({"row_id": some["row_id"].slice(0, 0), "position": pa.array([], pa.int32()), "output": pa.array([], pa.int32()), "shap": pa.array([], pa.float64())})
        x = some["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, width)
        phi = np.zeros((len(x), width, outputs))
        depth, member = pc.list_value_length(packed["features"]).to_numpy(), packed["member"].to_numpy()
        for d, k in sorted(set(zip(depth.tolist(), member.tolist()))):
            if not d:
                continue  # a tree of one leaf adds to the base only
            part = packed.filter(pa.array((depth == d) & (member == k)))
            arrays = [part[c].combine_chunks().flatten().to_numpy().reshape(part.num_rows, -1) for c in ("features", "low", "high", "share", "value")]
            phi[:, :, k * per:(k + 1) * per] += leaf_attributions(x, *arrays)
        shown = phi[:, :, -1:] if signed else phi
        one = shown.shape[2]
        at = np.repeat(np.arange(len(x)), width * one)
        return pa.table({
            "row_id": some["row_id"].take(pa.array(at)), "position": pa.array(np.tile(np.repeat(np.arange(width, dtype=np.int32), one), len(x))),
            "output": pa.array(np.tile(np.arange(one, dtype=np.int32), len(x) * width)), "shap": pa.array(shown.ravel())})

    parts = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(explain, f"row_id {row_type}, position int, output int, shap double")
    if leaf_packs > 1:
        parts = parts.groupBy("row_id", "position", "output").agg(F.sum("shap").alias("shap"))
    if not signed:
        parts = parts.groupBy("row_id", "position").agg(F.avg(F.abs("shap")).alias("shap"))
    label = F.get(F.array(*[F.lit(f) for f in names]), F.col("position"))
    values = rows.select("row_id", F.posexplode(vector_to_array("features")).alias("position", "feature_value"))
    long = parts.join(values, ["row_id", "position"]).select("row_id", label.alias("feature"), "shap", "feature_value")
    if not signed:
        return long, float("nan")
    whole = F.aggregate("share", F.lit(1.0), lambda acc, z: acc * z) * F.element_at("value", -1)
    return long, float(leaves.agg(F.sum(whole)).first()[0])


# ---- linear ----------------------------------------------------------------------------

def linear_attributions(long: DataFrame, weights: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """w_j (x_j - mean_j) for long rows (row_id, feature, value) and weights (feature, weight).

    The mean is over `background`, the rows themselves when none is given.
    """
    means = (background if background is not None else long).groupBy("feature").agg(F.avg("value").alias("_mean"))
    # Both lookups have one row per feature.
    joined = long.join(F.broadcast(weights), "feature").join(F.broadcast(means), "feature")
    return joined.select(
        "row_id", "feature", (F.col("weight") * (F.col("value") - F.col("_mean"))).alias("shap"),
        F.col("value").alias("feature_value"))


def linear_model_attributions(fitted: Fitted, rows: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    spark = rows.sparkSession
    model = fitted.stages[0]
    names = F.array(*[F.lit(f) for f in features])
    long = rows.select("row_id", F.posexplode(vector_to_array("features")).alias("p", "value")).select(
        "row_id", F.get(names, F.col("p")).alias("feature"), "value")
    picked = rows.orderBy(hash_int(F.lit(seed), F.col("row_id"))).limit(BACKGROUND_ROWS).select("row_id")
    background = long.join(picked, "row_id", "left_semi")
    if fitted.n_classes > 2:
        matrix = model.coefficientMatrix.toArray()
        parts = [
            linear_attributions(long, spark.createDataFrame(list(zip(features, map(float, row))), "feature string, weight double"), background)
            for row in matrix
        ]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every.groupBy("row_id", "feature").agg(F.avg(F.abs("shap")).alias("shap"), F.first("feature_value").alias("feature_value"))
    weights = spark.createDataFrame(list(zip(features, map(float, model.coefficients.toArray()))), "feature string, weight double")
    return linear_attributions(long, weights, background)


# ---- any model -------------------------------------------------------------------------

def coalition_masks(width: int, budget: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions and their kernel weights: all of them if they fit the budget, else whole
    sizes from the outside in, then a seeded sample of the rest."""
    masks, weights = [], []
    left = budget

    def size_weight(s: int) -> float:
        return (width - 1) / (s * (width - s))

    open_sizes = []
    for s in range(1, width // 2 + 1):
        sizes = sorted({s, width - s})
        count = sum(comb(width, z) for z in sizes)
        if count <= left:
            for z in sizes:
                for group in combinations(range(width), z):
                    m = np.zeros(width)
                    m[list(group)] = 1
                    masks.append(m)
                    weights.append(size_weight(z) / comb(width, z))
            left -= count
        else:
            open_sizes += sizes
    if open_sizes and left > 0:
        rng = np.random.default_rng(seed)
        mass = np.array([size_weight(z) for z in open_sizes])
        for z in rng.choice(open_sizes, size=left, p=mass / mass.sum()):
            m = np.zeros(width)
            m[rng.choice(width, size=int(z), replace=False)] = 1
            masks.append(m)
            weights.append(mass.sum() / left)
    return np.array(masks), np.array(weights)


def kernel_attributions(
    fitted: Fitted, rows: DataFrame, features: Sequence[str], centres: int = BACKGROUND_CENTRES,
    budget: int = COALITIONS, seed: int = 42,
) -> DataFrame:
    """Kernel attributions of any model against k-means centres weighted by their size.

    Every row meets every coalition and centre as a row of its own, scored by the model in one
    job; the weighted averages are plain aggregations, and the regression that turns coalition
    values into attributions is one fixed matrix applied to each row's array of values.
    """
    spark = rows.sparkSession
    row_type = rows.schema["row_id"].dataType.simpleString()
    width = len(features)
    n = rows.count()
    clusters = KMeans(k=min(centres, n), seed=seed, featuresCol="features").fit(rows.select("features"))
    sizes = clusters.summary.clusterSizes
    total = float(sum(sizes))
    table = [(float(s) / total, [float(v) for v in c]) for s, c in zip(sizes, clusters.clusterCenters()) if s > 0]
    masks, kernel = coalition_masks(width, budget, seed)
    plans = np.vstack([masks, np.zeros(width), np.ones(width)])

    back = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*[F.lit(v) for v in c]).alias("c")) for w, c in table])
    each = rows.select("row_id", vector_to_array("features").alias("x")).withColumn("_b", F.explode(back))
    codes = spark.createDataFrame([(i, [float(v) for v in m]) for i, m in enumerate(plans)], "coalition int, mask array<double>")
    numbered = each.withColumn("coalition", F.explode(F.sequence(F.lit(0), F.lit(len(plans) - 1))))
    mixed = numbered.join(F.broadcast(codes), "coalition").select(  # at most budget + 2 rows
        "row_id", "coalition", F.col("_b.w").alias("w"),
        array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(
            F.get("mask", i) > 0, F.get("x", i)).otherwise(F.get(F.col("_b.c"), i)))).alias("features"))
    scored = fitted.predict(mixed)
    value = F.col("y_prob") if fitted.n_classes else F.col("y_pred")
    means = scored.groupBy("row_id", "coalition").agg((F.sum(F.col("w") * value) / F.sum("w")).alias("f"))
    arrays = means.groupBy("row_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("coalition", "f"))), lambda s: s["f"]).alias("f"))

    # Weighted least squares with the attributions forced to sum to f(all) - f(none).
    z = masks[:, :-1] - masks[:, -1:]
    solve = np.linalg.pinv(z * np.sqrt(kernel)[:, None]) * np.sqrt(kernel)[None, :] if width > 1 else None
    last = masks[:, -1]
    names = list(features)

    def attribute(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            f = np.array([np.asarray(v, float) for v in pdf["f"]])
            none, full = f[:, -2], f[:, -1]
            gap = full - none
            if width == 1:
                phi = gap[:, None]
            else:
                y = f[:, :-2] - none[:, None] - last[None, :] * gap[:, None]
                front = y @ solve.T
                phi = np.hstack([front, (gap - front.sum(axis=1))[:, None]])
            yield pd.DataFrame({"row_id": np.repeat(pdf["row_id"].to_numpy(), width), "feature": names * len(pdf), "shap": phi.ravel()})

    shap = arrays.mapInPandas(attribute, f"row_id {row_type}, feature string, shap double")
    labels = F.array(*[F.lit(f) for f in names])
    values = rows.select("row_id", F.posexplode(vector_to_array("features")).alias("p", "feature_value")).select(
        "row_id", F.get(labels, F.col("p")).alias("feature"), "feature_value")
    return shap.join(values, ["row_id", "feature"])


def attributions(fitted: Fitted, rows: DataFrame, features: Sequence[str], seed: int = 42) -> DataFrame:
    """Attributions by the method that fits the model family, written once."""
    if fitted.model_id in ("dt", "rf", "xgb", "lgbm"):
        return cut_lineage(tree_attributions(fitted, rows, features)[0])
    if fitted.model_id in ("lr", "ridge"):
        return cut_lineage(linear_model_attributions(fitted, rows, features, seed))
    return cut_lineage(kernel_attributions(fitted, rows, features, seed=seed))


# ---- views -----------------------------------------------------------------------------

def importance(shap: DataFrame) -> DataFrame:
    """(rank, feature, mean_abs_shap); one row per feature."""
    means = shap.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.round("mean_abs_shap", 12).desc(), "feature")
    return means.withColumn("rank", F.row_number().over(order))


def top_features(shap: DataFrame, k: int) -> DataFrame:
    return importance(shap).where(F.col("rank") <= k)


def scaled_in_feature(shap: DataFrame, value: str = "feature_value", out: str = "scaled") -> DataFrame:
    """Min-max position of a value within its feature, one half for constants."""
    span = shap.groupBy("feature").agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = safe_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return shap.join(F.broadcast(span), "feature").withColumn(
        out, F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(0.5))).drop("_lo", "_hi")


def beeswarm(shap: DataFrame, k: int = TOP_GLOBAL) -> DataFrame:
    chosen = F.broadcast(top_features(shap, k).select("feature", "rank"))
    return scaled_in_feature(shap.join(chosen, "feature")).withColumn("label", shorten("feature"))


def cross_correlations(shap: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """(feature, other, r): attributions of the chosen features against the values of every other.

    A row's cells meet once, as one list; tasks turn lists into matrices and keep the sums of
    their products, so only features x chosen sums are shuffled. A missing or NaN side leaves
    its pair out; constant sides and pairs met less than twice give 0.
    """
    spark = shap.sparkSession

    if not chosen:
        return spark.createDataFrame([], "feature string, other string, r double")

    def known(name):
        return F.nullif(F.col(name).cast("double"), F.lit(float("nan")))

    centres = shap.groupBy("feature").agg(
        F.coalesce(F.avg(known("feature_value")), F.lit(0.0)).alias("v"), F.coalesce(F.avg(known("shap")), F.lit(0.0)).alias("s"),
        (F.min(known("feature_value")) < F.max(known("feature_value"))).alias("v_varies"),
        (F.min(known("shap")) < F.max(known("shap"))).alias("s_varies")).orderBy("feature").collect()  # one row a feature
    names = [r["feature"] for r in centres]
    at, width, tops = {f: i for i, f in enumerate(names)}, len(names), list(chosen)
    v_mean, v_moves = np.array([r["v"] for r in centres]), np.array([bool(r["v_varies"]) for r in centres])
    s_mean = np.array([centres[at[f]]["s"] for f in tops])
    s_moves = np.array([bool(centres[at[f]]["s_varies"]) for f in tops])
    top_at = np.array([at[f] for f in tops], int)
    numbers = spark.createDataFrame(list(at.items()), "feature string, position int")
    lists = shap.join(F.broadcast(numbers), "feature").groupBy("row_id").agg(F.collect_list(
        F.struct("position", known("feature_value").alias("v"), known("shap").alias("s"))).alias("cells"))
    some = max(1, BATCH_CELLS // max(1, width))

    def sums(batches):
        total = np.zeros((6, width, len(tops)))
        for whole in batches:
            for start in range(0, whole.num_rows, some):
                cells = whole.column(0).slice(start, some)
                row = np.repeat(np.arange(len(cells)), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
                flat = cells.flatten()
                column = flat.field("position").to_numpy(zero_copy_only=False)
                v, s = np.full((len(cells), width), np.nan), np.full((len(cells), width), np.nan)
                v[row, column] = flat.field("v").to_numpy(zero_copy_only=False)
                s[row, column] = flat.field("s").to_numpy(zero_copy_only=False)
                v, s = v - v_mean, s[:, top_at] - s_mean
                has_v, has_s = (~np.isnan(v)).astype(float), (~np.isnan(s)).astype(float)
                v, s = np.nan_to_num(v, nan=0.0) * v_moves, np.nan_to_num(s, nan=0.0) * s_moves
                total += [has_v.T @ has_s, v.T @ has_s, has_v.T @ s, (v * v).T @ has_s, has_v.T @ (s * s), v.T @ s]
        flat = total.reshape(6, -1)
        yield pa.RecordBatch.from_pydict({
            "p": pa.array(np.repeat(np.arange(width, dtype=np.int32), len(tops))),
            "t": pa.array(np.tile(np.arange(len(tops), dtype=np.int32), width)),
            **{m: pa.array(x) for m, x in zip(("n", "v", "s", "vv", "ss", "vs"), flat)}})

    met = lists.select("cells").mapInArrow(sums, "p int, t int, n double, v double, s double, vv double, ss double, vs double")
    added = met.groupBy("p", "t").agg(*[F.sum(m).alias(m) for m in ("n", "v", "s", "vv", "ss", "vs")])
    own_v = F.col("vv") - F.col("v") * safe_divide(F.col("v"), F.col("n"))
    own_s = F.col("ss") - F.col("s") * safe_divide(F.col("s"), F.col("n"))
    both = F.col("vs") - F.col("v") * safe_divide(F.col("s"), F.col("n"))
    r = F.when((own_v > 0) & (own_s > 0), both / F.sqrt(own_v * own_s)).otherwise(F.lit(0.0))
    return added.where(F.col("p") != F.get(F.array(*[F.lit(int(i)) for i in top_at]), F.col("t"))).select(
        F.get(F.array(*[F.lit(f) for f in tops]), F.col("t")).alias("feature"),
        F.get(F.array(*[F.lit(f) for f in names]), F.col("p")).alias("other"), r.alias("r"))


def dependence(shap: DataFrame, k: int = TOP_DEPENDENCE) -> DataFrame:
    """(rank, feature, row_id, feature_value, shap, interaction, interaction_value, scaled).

    The interaction is the other feature whose values correlate most with the attributions.
    """
    top = {r["feature"]: r["rank"] for r in top_features(shap, k).collect()}  # k rows
    ranks = shap.sparkSession.createDataFrame(list(top.items()), "feature string, rank int")
    strength = cross_correlations(shap, list(top))
    best = ranks.join(strength.groupBy("feature").agg(
        F.min(F.struct(F.round(-F.abs("r"), 12).alias("k"), "other")).alias("b")), "feature").select(
        "rank", "feature", F.col("b.other").alias("interaction"))
    mine = shap.join(F.broadcast(best), "feature").select("rank", "feature", "row_id", "feature_value", "shap", "interaction")
    others = shap.select("row_id", F.col("feature").alias("interaction"), F.col("feature_value").alias("interaction_value")).join(
        F.broadcast(best.select("interaction").distinct()), "interaction")
    joined = mine.join(others, ["row_id", "interaction"])
    span = joined.groupBy("feature").agg(F.min("interaction_value").alias("_lo"), F.max("interaction_value").alias("_hi"))
    place = safe_divide(F.col("interaction_value") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return joined.join(F.broadcast(span), "feature").withColumn(
        "scaled", F.when(F.col("_hi") > F.col("_lo"), place).otherwise(F.lit(0.5))).drop("_lo", "_hi")


def waterfall(shap: DataFrame, chosen: DataFrame, k: int = TOP_WATERFALL) -> DataFrame:
    """(outcome, step, feature, shap, start, total) of representative rows (outcome, row_id).

    The k most important features of all rows, smallest contribution first. Grouped by the few
    chosen rows, so each running total covers at most k rows.
    """
    top = F.broadcast(top_features(shap, k).select("feature"))
    part = shap.join(F.broadcast(chosen.select("outcome", "row_id")), "row_id").join(top, "feature")
    order = Window.partitionBy("outcome", "row_id").orderBy(F.round(F.abs("shap"), 12), "feature")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return part.withColumn("step", F.row_number().over(order)).withColumn("total", F.sum("shap").over(running)).withColumn(
        "start", F.col("total") - F.col("shap"))
