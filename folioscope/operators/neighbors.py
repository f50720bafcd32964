"""Nearest neighbours, oversampling, neighbour graphs and neighbourhood scores.

The exact search never forms all pairs of rows as rows. Points are assigned to the nearest of
a few pivots and cut into blocks; an unordered block pair is compared once, inside one task, and
only the k best per row leave it. A matrix product in single precision gives all squared distances
up to a known rounding error; those that may be among the k best are made again by plain differences. Block
pairs that the triangle inequality rules out are not compared, and a cell holding very many
points is simply cut into more blocks. Up to `BLOCKS` x `LARGEST` rows the number of blocks is
bounded, so a row is sent to a bounded number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.scalars import hash_unit
from folioscope.session import staged

# Rows of a block: n / BLOCKS, at least BLOCK_ROWS and at most LARGEST. A task holds STRIP
# squared distances and HITS differences at once.
BLOCK_ROWS = 1024
BLOCKS, LARGEST = 24, 65_536
STRIP, HITS = 2_000_000, 2_000
MAX_PIVOTS = 512
TASKS = 128
SMOTE_NEIGHBOURS = 5
BINS = 4096  # of the squares of a row when ranks are counted


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array([np.asarray(v, dtype=float) for v in column])


def _packed(x: np.ndarray) -> list[bytes]:
    """One value per row: doubles that Spark moves without looking at them."""
    raw, size = np.ascontiguousarray(x, float).tobytes(), 8 * x.shape[1]
    return [raw[size * i:size * (i + 1)] for i in range(len(x))]


def _unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column)).reshape(len(column), len(column.iloc[0]) // 8)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by plain differences, so equal points are exactly at 0."""
    out = np.empty((len(a), len(b)))
    step = max(1, int(4_000_000 // max(1, b.size)))
    for start in range(0, len(a), step):
        diff = a[start:start + step, None, :] - b[None, :, :]
        out[start:start + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


def _ordered(ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The ids of two blocks as numbers in the order of the ids, and the number of a missing id."""
    codes, kinds = pd.factorize(np.concatenate([ids_a, ids_b]), sort=True)
    codes = np.where(codes < 0, len(kinds), codes)
    return codes[:len(ids_a)], codes[len(ids_a):], len(kinds)


def _usable(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.flatnonzero(np.isfinite((x * x).sum(axis=1)))


def _factors(x: np.ndarray, y: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray, float]:
    """Two matrices whose product holds all squared distances, and a bound of its rounding error.
    Single precision is left where squares could leave its range."""
    a, b = x - y.mean(axis=0), y - y.mean(axis=0)
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    size = float(aa.max() + bb.max())
    if not 1e-20 < size < 1e30:
        kind = np.float64
    slack = 16 * (x.shape[1] + 4) * float(np.finfo(kind).eps) * size
    left, right = np.column_stack([a, aa, np.ones(len(a))]), np.column_stack([-2 * b, np.ones(len(b)), bb]).T
    return left.astype(kind, copy=False), right.astype(kind, copy=False), slack


def _exact(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Distances of some pairs by plain differences, so equal points are exactly at 0."""
    out = np.empty(len(rows))
    for start in range(0, len(rows), HITS):
        diff = x[rows[start:start + HITS]] - y[cols[start:start + HITS]]
        out[start:start + HITS] = np.sqrt((diff * diff).sum(axis=1))
    return out


def _first(owner: np.ndarray, dist: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k first pairs of every owner by distance, ties by order."""
    if not len(owner) or np.bincount(owner).max() <= k:
        return np.arange(len(owner))
    at = np.lexsort((order, dist, owner))
    own = owner[at]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    place = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return at[place < k]


def _limits(squares: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The next larger numbers of the squares' precision; infinity is beyond all of them."""
    top = np.finfo(squares.dtype).max
    return np.minimum(np.nextafter(np.minimum(bound, top).astype(squares.dtype), squares.dtype.type(np.inf)), top)


def _hits(squares: np.ndarray, bound: np.ndarray, k: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of all squares that may be among the k best of their row and within its
    bound. Rows with many are held to their k-th square; pairs that don't count are at infinity."""
    def kth(rows: np.ndarray) -> np.ndarray:
        return _limits(squares, np.partition(squares[rows], k - 1, axis=1)[:, k - 1].astype(float) + 2 * slack)

    with np.errstate(over="ignore"):
        limit = _limits(squares, bound * bound * (1 + 1e-15) + slack)
    free = np.flatnonzero(limit == np.finfo(squares.dtype).max) if squares.shape[1] > 4 * k else []
    if len(free):
        limit[free] = kth(free)
    hits = squares <= limit[:, None]
    if hits.flags.c_contiguous:
        rows, cols = np.divmod(np.flatnonzero(hits), hits.shape[1])
    else:
        cols, rows = np.divmod(np.flatnonzero(hits.T), hits.shape[0])
    many = np.flatnonzero(np.bincount(rows, minlength=len(limit)) > 4 * k)
    if len(many):
        limit[many] = np.minimum(limit[many], kth(many))
        keep = squares[rows, cols] <= limit[rows]
        rows, cols = rows[keep], cols[keep]
    return rows, cols


def _nearest(
    x: np.ndarray, ids_x: np.ndarray, bound_x: np.ndarray, y: np.ndarray, ids_y: np.ndarray, k: int,
    bound_y: np.ndarray | None = None, barred=None,
) -> pd.DataFrame:
    """(id, nn_id, distance): the k nearest of y for every x within its bound, ties by id, a point
    never its own neighbour; with bound_y also those of x for every y. `barred(a, b)` marks the
    pairs of some rows of x with some of y that don't count."""
    use_x, use_y = _usable(x), _usable(y)
    order = np.argsort(ids_y[use_y], kind="stable")
    use_y = use_y[order]
    if not len(use_x) or not len(use_y):
        return pd.DataFrame({"id": ids_x[:0], "nn_id": ids_y[:0], "distance": np.zeros(0)})
    x, ids_x, bound_x, y, ids_y = x[use_x], ids_x[use_x], bound_x[use_x], y[use_y], ids_y[use_y]
    code_x, code_y, missing = _ordered(ids_x, ids_y)
    left, right, slack = _factors(x, y, np.float32)
    same, after = np.searchsorted(code_y, code_x, "left"), np.searchsorted(code_y, code_x, "right")
    after = np.where(code_x == missing, same, after)
    step = max(1, STRIP // len(y))
    found, back = [], []
    for start in range(0, len(x), step):
        squares = left[start:start + step] @ right
        first, last = same[start:start + step], after[start:start + step]
        for copy in range(int((last - first).max(initial=0))):
            rows = np.flatnonzero(first + copy < last)
            squares[rows, first[rows] + copy] = np.inf
        if barred is not None:
            squares[barred(use_x[start:start + step], use_y)] = np.inf
        rows, cols = _hits(squares, bound_x[start:start + step], k, slack)
        rows += start
        dist = _exact(x, y, rows, cols)
        ok = np.flatnonzero(dist <= bound_x[rows])
        rows, cols, dist = rows[ok], cols[ok], dist[ok]
        keep = _first(rows, dist, code_y[cols], k)
        found.append((rows[keep], cols[keep], dist[keep]))
        if bound_y is not None:
            bound = bound_y[use_y]
            cols, rows = _hits(squares.T, bound, k, slack)
            rows += start
            dist = _exact(x, y, rows, cols)
            ok = np.flatnonzero(dist <= bound[cols])
            rows, cols, dist = rows[ok], cols[ok], dist[ok]
            keep = _first(cols, dist, code_x[rows], k)
            back.append((rows[keep], cols[keep], dist[keep]))
    rows, cols, dist = (np.concatenate(c) for c in zip(*found))
    out = [pd.DataFrame({"id": ids_x[rows], "nn_id": ids_y[cols], "distance": dist})]
    if back:
        rows, cols, dist = (np.concatenate(c) for c in zip(*back))
        keep = _first(cols, dist, code_x[rows], k)
        out.append(pd.DataFrame({"id": ids_y[cols[keep]], "nn_id": ids_x[rows[keep]], "distance": dist[keep]}))
    return pd.concat(out, ignore_index=True) if len(out) > 1 else out[0]


def rows_of_block(n: int, least: int = BLOCK_ROWS) -> int:
    return max(least, min(LARGEST, -(-n // BLOCKS)))


class BlockedPoints:
    """Points (id, vec) cut into blocks: `rows` (block, cell, id, vec, grp), vectors packed, and one
    row of `blocks` per block with its pivot cell and radius."""

    def __init__(self, points: DataFrame, block_rows: int = BLOCK_ROWS):
        n = points.count()
        block_rows = rows_of_block(n, block_rows)
        m = int(min(MAX_PIVOTS, max(1, -(-n // block_rows))))
        # Any pivots give the right answer; a seeded spread of ids gives well separated cells.
        chosen = points.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(m).collect()
        self.pivots = np.array([list(r["vec"]) for r in chosen], dtype=float)
        self.block_rows = block_rows
        pivots = self.pivots

        def assign(batches):
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                x = _matrix(pdf["vec"])
                d = _distances(x, pivots)
                cell = d.argmin(axis=1)
                yield pdf.assign(vec=_packed(x), cell=cell.astype("int32"), to_pivot=d[np.arange(len(d)), cell])

        typed = points.select("id", "grp", F.col("vec").cast("array<double>").alias("vec"))
        schema = f"id {id_type(points)}, grp string, vec binary, cell int, to_pivot double"
        located = staged(typed.mapInPandas(assign, schema), "located")
        sizes = located.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("_n"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("_n") / block_rows))
        self.rows = located.join(sizes, ["grp", "cell"]).withColumn(
            "block", F.concat_ws("/", "grp", F.col("cell").cast("string"), F.pmod(F.xxhash64("id"), parts).cast("string"))
        ).drop("_n")
        self.blocks = self.rows.groupBy("grp", "cell", "block").agg(
            F.max("to_pivot").alias("radius"), F.count(F.lit(1)).alias("n"))

    def block_pairs(self, reach: DataFrame) -> DataFrame:
        """(block_a, block_b) that may hold a pair within `reach` (block, reach) of block_a.

        Built from cell distances and radii only; a block meets the cells in reach of its own
        cell through an equi-join on the cell.
        """
        spark = self.rows.sparkSession
        between = _distances(self.pivots, self.pivots)
        table = spark.createDataFrame(
            [(a, [float(x) for x in between[a]]) for a in range(len(between))], "cell int, gaps array<double>")
        a = self.blocks.join(reach, "block").join(F.broadcast(table), "cell")  # at most 512 rows
        a = a.select("grp", F.col("block").alias("block_a"), F.col("radius").alias("radius_a"), "reach",
                     F.posexplode("gaps").alias("cell", "gap"))
        b = self.blocks.select("grp", "cell", F.col("block").alias("block_b"), F.col("radius").alias("radius_b"))
        slack = 1e-9 * (1 + F.col("gap"))
        return a.join(b, ["grp", "cell"]).where(
            F.col("gap") - F.col("radius_a") - F.col("radius_b") <= F.col("reach") + slack
        ).select("block_a", "block_b")


def id_type(df: DataFrame, column: str = "id") -> str:
    """Type of an id column as schema text; ids may be numbers or strings."""
    return df.schema[column].dataType.simpleString()


def _unordered(pairs: DataFrame) -> DataFrame:
    """Each pair of different blocks once, whichever of the two reaches the other."""
    return pairs.where("block_a <> block_b").select(
        F.least("block_a", "block_b").alias("block_a"), F.greatest("block_a", "block_b").alias("block_b")).distinct()


def _other_side(held: DataFrame, pairs: DataFrame, *more: Column) -> DataFrame:
    """Rows of block_b for every pair, under names of their own for the co-grouping."""
    return held.withColumnRenamed("block", "block_b").join(pairs, "block_b").select(
        F.col("block_a").alias("to_a"), F.col("block_b").alias("to_b"),
        F.col("id").alias("other"), F.col("vec").alias("other_vec"), *more)


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt to TASKS tasks by blocks: work follows the square of a block's rows, but adaptive
    execution joins tasks by bytes, and short vectors all met in a few."""
    return rows.repartition(TASKS, *keys)


def _met(a: DataFrame, b: DataFrame, compare, schema: str) -> DataFrame:
    """`compare` of the rows of each block pair (block_a, block_b), (to_a, to_b)."""
    left, right = _dealt(a, "block_a", "block_b"), _dealt(b, "to_a", "to_b")
    return left.groupBy("block_a", "block_b").cogroup(right.groupBy("to_a", "to_b")).applyInPandas(compare, schema)


def knn_exact(points: DataFrame, k: int, group: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, nn_id, distance, rank): exact k nearest neighbours, ties by id.

    `points` is (id, vec[, group]); with `group` only rows of the same group are neighbours.
    """
    grouped = points.withColumn("grp", F.col(group).cast("string") if group else F.lit(""))
    blocked = BlockedPoints(grouped, block_rows)
    held = blocked.rows.select("block", "id", "vec")

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = _unpacked(pdf["vec"]), pdf["id"].to_numpy()
        return _nearest(x, ids, np.full(len(x), np.inf), x, ids, k)

    kind = id_type(points)
    schema = f"id {kind}, nn_id {kind}, distance double"
    first = staged(_dealt(held, "block").groupBy("block").applyInPandas(own, schema), "own-block")
    # Distance to the k-th neighbour inside the own block bounds the search outside it.
    bound = first.groupBy("id").agg(
        F.when(F.count(F.lit(1)) >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = staged(held.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bounded")
    reach = bounded.groupBy("block").agg(F.max("bound").alias("reach"))
    pairs = _unordered(blocked.block_pairs(reach))

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id": [], "nn_id": [], "distance": []}, dtype=object)
        return _nearest(
            _unpacked(left["vec"]), left["id"].to_numpy(), left["bound"].to_numpy(),
            _unpacked(right["other_vec"]), right["other"].to_numpy(), k, right["other_bound"].to_numpy())

    a = bounded.withColumnRenamed("block", "block_a").join(pairs, "block_a").select("block_a", "block_b", "id", "vec", "bound")
    b = _other_side(bounded, pairs, F.col("bound").alias("other_bound"))
    others = _met(a, b, across, schema)
    nearest = Window.partitionBy("id").orderBy("distance", "nn_id")
    return first.unionByName(others).withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def knn_approximate(
    points: DataFrame, k: int, radius: float, tables: int = 6, bucket: float | None = None, seed: int = 42,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Neighbours within `radius` found by random projections, the k nearest of them kept.

    Rows that share a bucket of a projection are compared; a bucket is cut into blocks and its
    block pairs are compared as in `knn_exact`. A pair counts in the first projection it shares.
    """
    vectors = points.where("id IS NOT NULL").select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(
        inputCol="v", outputCol="h", bucketLength=bucket or radius, numHashTables=tables, seed=seed).fit(vectors)
    marks = F.array(*[F.get(vector_to_array(F.get("h", F.lit(t))), F.lit(0)) for t in range(tables)])
    hashed = staged(model.transform(vectors).select("id", vector_to_array("v").alias("vec"), marks.alias("marks")).distinct(), "hashed")
    most = rows_of_block(hashed.count(), block_rows)
    entries = hashed.select("id", "vec", "marks", F.posexplode("marks").alias("t", "mark"))
    sizes = entries.groupBy("t", "mark").agg(F.ceil(F.count(F.lit(1)) / most).alias("_parts"))
    part = F.pmod(F.xxhash64("id"), F.col("_parts"))
    held = entries.join(sizes, ["t", "mark"]).select(
        F.concat_ws("/", "t", "mark", part).alias("block"), F.concat_ws("/", "t", "mark").alias("bucket"), "t", "id", "vec", "marks")
    kind = id_type(points)
    schema = f"id {kind}, nn_id {kind}, distance double"

    def earlier(t, marks_a, marks_b):
        """Marks the pairs that share a projection before the t-th."""
        def barred(a, b):
            out = np.zeros((len(a), len(b)), bool)
            for e in range(t):
                out |= marks_a[a, e][:, None] == marks_b[b, e][None, :]
            return out
        return barred

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids, at = _matrix(pdf["vec"]), pdf["id"].to_numpy(), _matrix(pdf["marks"])
        return _nearest(x, ids, np.full(len(x), float(radius)), x, ids, k, None, earlier(int(pdf["t"].iloc[0]), at, at))

    first = staged(_dealt(held, "block").groupBy("block").applyInPandas(own, schema), "own-block")
    bound = first.groupBy("id").agg(F.get(F.array_sort(F.collect_list("distance")), F.lit(k - 1)).alias("bound"))
    bounded = held.join(bound, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float(radius))))
    blocks = held.select("bucket", "block").distinct()
    pairs = blocks.withColumnRenamed("block", "block_a").join(
        blocks.withColumnRenamed("block", "block_b"), "bucket").where("block_a < block_b").select("block_a", "block_b")

    def across(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id": [], "nn_id": [], "distance": []}, dtype=object)
        return _nearest(
            _matrix(left["vec"]), left["id"].to_numpy(), left["bound"].to_numpy(),
            _matrix(right["other_vec"]), right["other"].to_numpy(), k, right["other_bound"].to_numpy(),
            earlier(int(left["t"].iloc[0]), _matrix(left["marks"]), _matrix(right["other_marks"])))

    a = bounded.withColumnRenamed("block", "block_a").join(pairs, "block_a").select(
        "block_a", "block_b", "t", "id", "vec", "marks", "bound")
    b = _other_side(bounded, pairs, F.col("bound").alias("other_bound"), F.col("marks").alias("other_marks"))
    others = _met(a, b, across, schema)
    nearest = Window.partitionBy("id").orderBy("distance", "nn_id")
    return first.unionByName(others).where(F.col("distance") < radius).withColumn(
        "rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


# ---- oversampling ----------------------------------------------------------------------

def oversample(
    points: DataFrame, label: str, k: int = SMOTE_NEIGHBOURS, seed: int = 42, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(id, label, vec, synthetic): every class grown to the size of the largest.

    A new point lies on the segment from a row to one of its k nearest rows of the same class.
    A class of one row cannot be grown. Rows take turns as the start, in a seeded order, so a
    class of n rows that lacks m gives floor(m/n) new points per row and one more for some.
    """
    base = points.select("id", F.col(label).alias("label"), F.col("vec").cast("array<double>").alias("vec"))
    counts = base.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.agg(F.max("n").alias("top")).withColumn("_one", F.lit(1))
    needs = counts.withColumn("_one", F.lit(1)).join(F.broadcast(top), "_one").where(
        (F.col("n") < F.col("top")) & (F.col("n") > 1)).select("label", "n", (F.col("top") - F.col("n")).alias("missing"))
    small = base.join(F.broadcast(needs), "label")  # one row per class
    # Position of a row within its class, without a window over the class.
    turn = _class_positions(small, seed)
    extra = F.floor(F.col("missing") / F.col("n")) + F.when(
        F.col("turn") < F.col("missing") % F.col("n"), 1).otherwise(0)
    starts = turn.where(extra > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), extra)))
    near = knn_exact(small.select("id", "vec", "label"), k, "label", block_rows)
    options = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "nn_id"))).alias("_near"))
    picked = starts.join(options, "id")
    draw = hash_unit(F.lit(seed), F.lit("pick"), F.col("id"), F.col("copy"))
    picked = picked.withColumn("nn_id", F.get(
        "_near", F.floor(draw * F.size("_near")).cast("int"))["nn_id"])
    ends = base.select(F.col("id").alias("nn_id"), F.col("vec").alias("_end"))
    u = hash_unit(F.lit(seed), F.lit("step"), F.col("id"), F.col("copy"))
    made = picked.join(ends, "nn_id").withColumn("_u", u)
    grown = made.select(
        "id", "label", F.zip_with("vec", "_end", lambda x, y: x + F.col("_u") * (y - x)).alias("vec"),
        F.lit(True).alias("synthetic"))
    return base.withColumn("synthetic", F.lit(False)).unionByName(grown)


def _class_positions(rows: DataFrame, seed: int) -> DataFrame:
    """0-based position of each row in its class in md5 order, in two levels of counting."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string")))
    tagged = rows.withColumn("_h", h).withColumn("_slot", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    slots = tagged.groupBy("label", "_slot").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy("label").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("label", "_slot", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("label", "_slot").orderBy("_h", "id")
    return tagged.withColumn("_rn", F.row_number().over(inside) - 1).join(slots, ["label", "_slot"]).withColumn(
        "turn", F.col("_base") + F.col("_rn")).drop("_h", "_slot", "_base", "_rn")


# ---- neighbour graph -------------------------------------------------------------------

def fuzzy_weights(neighbours: DataFrame, k: int) -> DataFrame:
    """Symmetric edge weights (src, dst, weight) of the fuzzy neighbour graph.

    Per row the distance to its closest neighbour is the offset and a bandwidth is found by
    bisection so that the memberships sum to log2(k); both directions join as a + b - ab.
    """
    lists = neighbours.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("distance", "nn_id"))).alias("near"))
    lists = lists.select("id", F.transform("near", lambda s: s["nn_id"]).alias("nn"),
                         F.transform("near", lambda s: s["distance"]).alias("d"))
    target = float(np.log2(k))

    def weigh(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            width = max(len(v) for v in pdf["d"])
            d = np.full((len(pdf), width), np.inf)
            for i, v in enumerate(pdf["d"]):
                d[i, :len(v)] = v
            positive = np.where((d > 0) & np.isfinite(d), d, np.inf)
            rho = np.where(np.isfinite(positive.min(axis=1)), positive.min(axis=1), 0.0)
            gap = np.maximum(d - rho[:, None], 0.0)
            lo, hi = np.zeros(len(d)), np.full(len(d), np.inf)
            sigma = np.ones(len(d))
            for _ in range(64):
                total = np.exp(-gap / sigma[:, None]).sum(axis=1)
                high = total > target
                hi = np.where(high, sigma, hi)
                lo = np.where(high, lo, sigma)
                sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
            floor = 1e-3 * np.where(np.isfinite(d), d, 0).sum(axis=1) / np.isfinite(d).sum(axis=1)
            sigma = np.maximum(sigma, np.maximum(floor, 1e-12))
            w = np.exp(-gap / sigma[:, None])
            yield pd.DataFrame({
                "src": np.repeat(pdf["id"].to_numpy(), [len(v) for v in pdf["nn"]]),
                "dst": np.concatenate([np.asarray(v) for v in pdf["nn"]]),
                "w": np.concatenate([w[i, :len(v)] for i, v in enumerate(pdf["nn"])]),
            })

    one_way = lists.mapInPandas(weigh, f"src {id_type(lists)}, dst {id_type(lists)}, w double")
    both = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg(
        (F.sum("w") - F.when(F.count(F.lit(1)) == 2, F.product("w")).otherwise(0.0)).alias("weight"))


# ---- neighbourhood preservation --------------------------------------------------------

def trustworthiness(
    points: DataFrame, embedding: DataFrame, k: int, block_rows: int = BLOCK_ROWS, original: DataFrame | None = None
) -> DataFrame:
    """One row (n, k, trustworthiness) for points (id, vec) and embedding (id, vec).

    For each neighbour in the embedding that is not one in the original space, its original
    rank is counted block by block: a block pair adds how many of its points are closer. A row
    takes the distances of its wrong neighbours along, not their vectors. `original` holds the
    k nearest neighbours of the points where they are already known.
    """
    return trustworthiness_of(points, [embedding], k, block_rows, original).drop("embedding")


def trustworthiness_of(
    points: DataFrame, embeddings: Sequence[DataFrame], k: int, block_rows: int = BLOCK_ROWS, original: DataFrame | None = None
) -> DataFrame:
    """`trustworthiness` of several embeddings, a row each with its number in `embedding`. A wrong
    neighbour's original rank is counted once, whichever of them have it."""
    n_rows = points.count()
    if original is None:
        original = knn_exact(points, k, block_rows=block_rows)
    right = original.select("id", "nn_id")
    each = [knn_exact(e, k, block_rows=block_rows).select("id", "nn_id").join(right, ["id", "nn_id"], "left_anti") for e in embeddings]
    wrong = each[0]
    if len(each) > 1:
        each = [staged(e, "wrong").withColumn("embedding", F.lit(i)) for i, e in enumerate(each)]
        of_each = each[0]
        for e in each[1:]:
            of_each = of_each.unionByName(e)
        wrong = of_each.select("id", "nn_id").distinct()
    blocked = BlockedPoints(points.withColumn("grp", F.lit("")), block_rows)
    held = blocked.rows.select("block", "id", "vec")
    ends = held.select(F.col("id").alias("nn_id"), F.col("vec").alias("end"))
    kind = id_type(points)

    def gaps(batches):
        for pdf in batches:
            if len(pdf):
                at = np.arange(len(pdf))
                gap = _exact(_unpacked(pdf["vec"]), _unpacked(pdf["end"]), at, at)
                yield pdf[["block", "id", "nn_id"]].assign(gap=gap)

    asked = staged(held.join(wrong, "id").join(ends, "nn_id").select("block", "id", "nn_id", "vec", "end").mapInPandas(
        gaps, f"block string, id {kind}, nn_id {kind}, gap double"), "asked")
    reach = asked.groupBy("block").agg(F.max("gap").alias("reach"))
    pairs = blocked.block_pairs(reach)
    packed = asked.groupBy("block", "id").agg(F.collect_list(F.struct("nn_id", "gap")).alias("nn")).select(
        "block", "id", F.transform("nn", lambda s: s["nn_id"]).alias("nn"), F.transform("nn", lambda s: s["gap"]).alias("gaps"))
    packed = packed.join(held.groupBy("block", "id").agg(F.first("vec").alias("vec")), ["block", "id"])

    def closer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"id": [], "nn_id": [], "closer": []}, dtype=object)
        return _closer(_unpacked(left["vec"]), left["id"].to_numpy(), left["nn"].tolist(), left["gaps"].tolist(),
                       _unpacked(right["other_vec"]), right["other"].to_numpy())

    a = packed.withColumnRenamed("block", "block_a").join(pairs, "block_a").select("block_a", "block_b", "id", "vec", "nn", "gaps")
    b = _other_side(held, pairs)
    counted = _met(a, b, closer, f"id {kind}, nn_id {kind}, closer bigint")
    ranks = counted.groupBy("id", "nn_id").agg((F.sum("closer") + 1).alias("r"))
    over = F.greatest(F.col("r") - k, F.lit(0))
    norm = 2.0 / (n_rows * k * (2.0 * n_rows - 3 * k - 1))
    score = (1 - F.lit(norm) * F.col("s")).alias("trustworthiness")
    if len(each) == 1:
        penalty = ranks.agg(F.coalesce(F.sum(over), F.lit(0)).alias("s")).withColumn("embedding", F.lit(0))
    else:
        numbers = points.sparkSession.range(len(each)).select(F.col("id").cast("int").alias("embedding"))
        sums = of_each.join(ranks, ["id", "nn_id"]).groupBy("embedding").agg(F.sum(over).alias("s"))
        penalty = numbers.join(sums, "embedding", "left").select("embedding", F.coalesce("s", F.lit(0)).alias("s"))
    return penalty.select("embedding", F.lit(n_rows).cast("bigint").alias("n"), F.lit(k).alias("k"), score)


def _below(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """How many values are below each limit: values are counted in bins up to the last limit, and
    only those in the bin of a limit are compared with it."""
    first, last = float(limits.min()), float(limits.max())
    scale = BINS / (last - first) if last > first else 0.0
    if len(values) < 4 * len(limits) or not 0.0 < scale < np.inf:
        return np.searchsorted(np.sort(values), limits, "left")

    def bins(x: np.ndarray) -> np.ndarray:  # never falls as x grows
        return np.clip((x - first) * scale, -1.0, BINS + 1.0).astype(np.int64) + 1

    at, own = bins(values), bins(limits)
    counts = np.bincount(at, minlength=BINS + 3)
    held = np.zeros(BINS + 3, bool)
    held[own] = True
    close = np.flatnonzero(held[at])
    order = np.sort(values[close])
    upto = np.searchsorted(order, limits, "left")
    counts[held] = 0  # those are compared one by one
    return (np.cumsum(counts) - counts)[own] + upto


def _closer(x: np.ndarray, ids: np.ndarray, wanted: list, gaps: list, y: np.ndarray, others: np.ndarray) -> pd.DataFrame:
    """(id, nn_id, closer): how many of y, but the row itself, stand before each of a row's wanted
    neighbours by distance, ties by id. Squares that the rounding error leaves open are made again."""
    use_x, use_y = _usable(x), _usable(y)
    if not len(use_x) or not len(use_y):
        return pd.DataFrame({"id": ids[:0], "nn_id": ids[:0], "closer": np.zeros(0, np.int64)})
    use_y = use_y[np.argsort(others[use_y], kind="stable")]
    x, ids, y, others = x[use_x], ids[use_x], y[use_y], others[use_y]
    code_x, code_y, missing = _ordered(ids, others)
    same, after = np.searchsorted(code_y, code_x, "left"), np.searchsorted(code_y, code_x, "right")
    left, right, slack = _factors(x, y)
    step = max(1, STRIP // len(y))
    src, dst, count = [], [], []
    for start in range(0, len(x), step):
        squares = left[start:start + step] @ right
        for i in range(len(squares)):
            squares[i, same[start + i]:after[start + i]] = np.inf
        for i in range(len(squares)):
            row = start + i
            gap, back = np.unique(np.asarray(gaps[use_x[row]], float), return_inverse=True)
            margin = slack + 1e-15 * gap * gap
            low, high = np.split(_below(squares[i], np.concatenate([gap * gap - margin, gap * gap + margin])), 2)
            met: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for at in np.flatnonzero(high > low).tolist():
                cols = np.flatnonzero((squares[i] >= gap[at] * gap[at] - margin[at]) & (squares[i] <= gap[at] * gap[at] + margin[at]))
                met[at] = cols, _exact(x, y, np.full(len(cols), row), cols)
            for j, at in zip(wanted[use_x[row]], back.tolist()):
                more = 0
                if at in met:
                    cols, dist = met[at]
                    more = int(((dist < gap[at]) | ((dist == gap[at]) & (others[cols] < j))).sum())
                src.append(ids[row])
                dst.append(j)
                count.append(int(low[at]) + more)
    return pd.DataFrame({"id": src, "nn_id": dst, "closer": count})
