"""Sums that many training sets share, made once.

Rows lie in disjoint cells (the test folds of a split, or the inner test folds of every outer
training set) and a training set is a union of cells. Value counts and products are made once for
each cell; what a training set needs is the sum over its cells. No row is copied into the training
sets it belongs to.

Order statistics: present values are counted by (feature, value range, value, cells), the ranges
being bounds that only spread the work; counts by range say which range holds a wanted position,
and one pass over the sorted counts reads it off. Products: tasks multiply blocks of `BLOCK`
features, and partial sums are merged `FAN_IN` at a time as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import cut_lineage

BLOCK = 256
FAN_IN = 16
RANGE_ROWS = 1 << 17
SKETCH_ROWS = 200_000


@dataclass(frozen=True)
class TrainingCells:
    """rows: (row_id, cell), a row once for each cell that holds it. members: (fold, cell)."""

    rows: DataFrame
    members: tuple[tuple[int, int], ...]

    @property
    def folds(self) -> list[int]:
        return sorted({f for f, _ in self.members})

    @property
    def cells(self) -> list[int]:
        return sorted({c for _, c in self.members})

    def matrix(self) -> np.ndarray:
        """(cells, folds) of zeros and ones."""
        cells, folds = {c: i for i, c in enumerate(self.cells)}, {f: i for i, f in enumerate(self.folds)}
        out = np.zeros((len(cells), len(folds)), np.int64)
        for f, c in self.members:
            out[cells[c], folds[f]] = 1
        return out

    def pairs(self) -> DataFrame:
        return self.rows.sparkSession.createDataFrame(list(self.members), "fold int, cell int")


def cells_of_folds(folded: DataFrame, k: int, fold: str = "fold", key: str = "row_id") -> TrainingCells:
    """Training set f holds all rows but those of test fold f."""
    return TrainingCells(folded.select(F.col(key).alias("row_id"), F.col(fold).alias("cell")), tuple((f, c) for f in range(k) for c in range(k) if c != f))


def cells_of_nested(inner: DataFrame, n_outer: int, n_inner: int) -> TrainingCells:
    """inner: (row_id, o, i), the inner test fold of each row in each outer training set it is in.
    Fold o * (n_inner + 1) is the outer training set, the next n_inner leave out one i each."""
    step = n_inner + 1
    members = [(o * step, o * n_inner + i) for o in range(n_outer) for i in range(n_inner)]
    members += [(o * step + 1 + s, o * n_inner + i) for o in range(n_outer) for s in range(n_inner) for i in range(n_inner) if i != s]
    return TrainingCells(inner.select("row_id", (F.col("o") * n_inner + F.col("i")).cast("int").alias("cell")), tuple(members))


def cells_of_rows(rows: DataFrame, fold: str = "fold") -> TrainingCells:
    """Training sets given as (row_id, fold): each is a cell of its own."""
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect())  # a job parameter
    return TrainingCells(rows.select("row_id", F.col(fold).alias("cell")), tuple((f, f) for f in folds))


@dataclass
class Marked:
    """Packed rows with their cells, written once: (x array, cells 'c,c,…')."""

    vectors: DataFrame
    cells: TrainingCells
    sizes: dict[int, int]  # rows of each cell
    width: int
    n: int
    block: int  # features a block of products


def marked(vectors: DataFrame, cells: TrainingCells, width: int) -> Marked:
    """vectors: (row_id, x). Rows without a vector only count as rows."""
    own = cells.rows.groupBy("row_id").agg(F.array_sort(F.collect_set("cell")).alias("cells"))  # at most the cells of a row
    joined = own.join(vectors, "row_id", "left").select("row_id", "x", F.array_join(F.transform("cells", lambda c: c.cast("string")), ",").alias("cells"))
    kept = cut_lineage(joined)
    counts = kept.groupBy("cells").agg(F.count(F.lit(1)).alias("n"))
    sizes = counts.select(F.explode(F.split("cells", ",")).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    return Marked(kept.where("x IS NOT NULL"), cells, {int(r["c"]): r["n"] for r in sizes.collect()}, width, kept.count(), BLOCK)


def membership(names: pa.Array, cells: Sequence[int]) -> np.ndarray:
    """(rows, cells) of zeros and ones from 'c,c,…'."""
    coded = names.dictionary_encode()
    place = {str(c): i for i, c in enumerate(cells)}
    table = np.zeros((len(coded.dictionary), len(cells)), np.int64)
    for i, text in enumerate(coded.dictionary.to_pylist()):
        table[i, [place[c] for c in text.split(",") if c in place]] = 1
    return table[coded.indices.to_numpy()]


# ---- order statistics ------------------------------------------------------------------

def ranged_values(m: Marked) -> DataFrame:
    """(position, shard, value, cells) of every present value."""
    long = m.vectors.select("cells", F.posexplode("x").alias("position", "value")).where("value IS NOT NULL")
    n_ranges = -(-m.n // RANGE_ROWS)
    if n_ranges == 1:
        return long.withColumn("shard", F.lit(0))
    marks = F.array(*[F.lit(i / n_ranges) for i in range(1, n_ranges)])
    some = long if m.n <= SKETCH_ROWS else m.vectors.sample(SKETCH_ROWS / m.n, seed=1).select(F.posexplode("x").alias("position", "value"))
    bounds = some.groupBy("position").agg(F.percentile_approx("value", marks, 100 * n_ranges).alias("_b"))
    joined = long.join(F.broadcast(bounds), "position", "left")  # a row for each feature of the schema
    below = F.size(F.filter(F.coalesce("_b", F.array().cast("array<double>")), lambda b: b < F.col("value")))
    return joined.withColumn("shard", below).drop("_b")


def fold_counts(values: DataFrame, m: Marked) -> DataFrame:
    """(position, fold, shard, cnt): present values of each training set by range."""
    some = values.groupBy("position", "shard", "cells").agg(F.count(F.lit(1)).alias("cnt"))
    each = some.select("position", "shard", F.explode(F.split("cells", ",").cast("array<int>")).alias("cell"), "cnt")
    return each.join(F.broadcast(m.cells.pairs()), "cell").groupBy("position", "fold", "shard").agg(F.sum("cnt").alias("cnt"))


def picked_values(m: Marked, wanted: dict[str, Column], sizes: DataFrame, tops: str = "top", counted: str = "x_low") -> DataFrame:
    """(position, fold, n, one column for each name of `wanted`, cnt_low, top).

    wanted: 0-based positions in the sorted present values as columns over n and n_rows, null for
    none; cnt_low: how often the value at `counted` occurs; top: largest count of one value.
    sizes: (fold, n_rows)."""
    values = ranged_values(m)
    per_range = fold_counts(values, m)
    group = Window.partitionBy("position", "fold")
    ladder = per_range.select(
        "position", "fold", "shard", "cnt", F.sum("cnt").over(group).alias("n"),
        F.coalesce(F.sum("cnt").over(group.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    ).join(F.broadcast(sizes), "fold")
    ladder = cut_lineage(ladder)
    entries = F.filter(F.array(*[F.struct(F.lit(name).alias("name"), (at - F.col("before")).cast("long").alias("k")) for name, at in wanted.items()]),
                       lambda e: (e["k"] >= 0) & (e["k"] < F.col("cnt")))
    # At most features x folds x names rows, whatever the number of rows.
    needed = ladder.select("position", "shard", "fold", F.inline(entries)).toPandas()
    names, folds, all_cells = list(wanted), m.cells.folds, m.cells.cells
    place = {f: i for i, f in enumerate(folds)}
    asks: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for position, shard, fold, name, k in needed.itertuples(index=False):
        asks.setdefault((position, shard), []).append((place[fold], names.index(name), k))
    sent = m.vectors.sparkSession.sparkContext.broadcast(asks)
    member = m.cells.matrix().astype(float)  # counts stay whole below 2**53
    low = names.index(counted)

    def read_off(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now: tuple[int, int] | None = None

        def rows_of(key: tuple[int, int]) -> pa.RecordBatch:
            value = np.concatenate([v for v, _ in held])
            counts = np.concatenate([c for _, c in held])
            starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            counts = np.add.reduceat(counts, starts, axis=0) @ member  # (values, folds)
            value = value[starts]
            fold, name, number = list(range(len(folds))), [len(names)] * len(folds), counts.max(0).tolist()
            ends = np.cumsum(counts, axis=0)
            for f, which, k in sent.value.get(key, []):
                at = int(np.searchsorted(ends[:, f], k, "right"))
                fold.append(f)
                name.append(which)
                number.append(float(value[at]))
                if which == low:
                    fold.append(f)
                    name.append(len(names) + 1)
                    number.append(float(counts[at, f]))
            size = len(fold)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * size, pa.int32()), pa.array([folds[f] for f in fold], pa.int32()), pa.array(name, pa.int32()), pa.array(number, pa.float64())],
                ["position", "fold", "what", "number"])

        for batch in batches:
            if not batch.num_rows:
                continue
            position, shard = batch.column("position").to_numpy(), batch.column("shard").to_numpy()
            counts = membership(batch.column("cells"), all_cells) * batch.column("cnt").to_numpy().astype(float)[:, None]
            value = batch.column("value").to_numpy()
            cuts = np.flatnonzero((position[1:] != position[:-1]) | (shard[1:] != shard[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(value)]):
                key = int(position[a]), int(shard[a])
                if now is not None and key != now:
                    yield rows_of(now)
                    held = []
                now = key
                held.append((value[a:b], counts[a:b]))
        if now is not None:
            yield rows_of(now)

    counts = values.groupBy("position", "shard", "value", "cells").agg(F.count(F.lit(1)).alias("cnt"))
    sorted_counts = counts.repartition("position", "shard").sortWithinPartitions("position", "shard", "value").select("position", "shard", "value", "cells", "cnt")
    found = sorted_counts.mapInArrow(read_off, "position int, fold int, what int, number double")
    best = {name: i for i, name in enumerate([*names, tops, "cnt_low"])}
    wide = found.groupBy("position", "fold").agg(*[F.max(F.when(F.col("what") == i, F.col("number"))).alias(name) for name, i in best.items()])
    return wide.join(ladder.groupBy("position", "fold").agg(F.max("n").alias("n")), ["position", "fold"])


# ---- products --------------------------------------------------------------------------

def _merge(key, table):
    """Sum of the arrays of one (cell, i, j)."""
    total = None
    for raw in table.column("data"):
        part = np.frombuffer(raw.as_buffer(), np.float64)
        total = part.copy() if total is None else total + part
    first = table.slice(0, 1)
    return pa.table({"cell": first["cell"], "i": first["i"], "j": first["j"], "part": pa.array([first["part"][0].as_py() // FAN_IN], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def block_products(m: Marked, centres: Sequence[float], squares: bool = False) -> DataFrame:
    """(cell, i, j, part, data): sums of products over the rows of each cell for blocks i <= j of
    features, one row each. With u the value less its centre (0 where missing) and b its presence:
    u'u, u'b, b'u and b'b and, with `squares`, uu'b and b'uu, one after the other."""
    step, n_blocks = m.block, -(-m.width // m.block)
    n_chunks = max(1, m.n // max(4096, 64 * m.width))
    spot = F.pmod(F.xxhash64("row_id"), F.lit(n_chunks))
    sliced = m.vectors.select(spot.alias("chunk"), "cells", "x", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("i"))
    sliced = sliced.select("chunk", "i", "cells", F.slice("x", F.col("i") * step + 1, F.lit(m.width)).alias("x"))
    spread = sliced.repartition(n_chunks * n_blocks, "chunk", "i").select("i", "cells", "x")
    all_cells, centre = m.cells.cells, np.asarray(centres, float)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            number = batch.column("i").to_numpy()
            inside = membership(batch.column("cells"), all_cells)
            for block in np.unique(number).tolist():
                rows = np.flatnonzero(number == block)
                x = batch.column("x").take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
                there = ~np.isnan(x)
                u = np.where(there, x - centre[block * step:], 0.0)
                b = there.astype(float)
                whole = bool(there.all())
                for c in range(len(all_cells)):
                    own = np.flatnonzero(inside[rows, c])
                    if not len(own):
                        continue
                    uo, bo = u[own], b[own]
                    ul, bl = uo[:, :step], bo[:, :step]
                    shape = ul.shape[1], uo.shape[1]
                    if whole:  # every product with a presence is a column sum
                        s = uo.sum(0)
                        sums = [ul.T @ uo, np.broadcast_to(s[:shape[0], None], shape), np.broadcast_to(s, shape), np.full(shape, float(len(own)))]
                        if squares:
                            s = (uo * uo).sum(0)
                            sums += [np.broadcast_to(s[:shape[0], None], shape), np.broadcast_to(s, shape)]
                    else:
                        sums = [ul.T @ uo, ul.T @ bo, bl.T @ uo, bl.T @ bo]
                        if squares:
                            sums += [(ul * ul).T @ bo, bl.T @ (uo * uo)]
                    old = held.get((block, c))
                    if old is None:
                        held[block, c] = [np.array(s) for s in sums]
                    else:
                        for a, s in zip(old, sums):
                            a += s
        for (block, c), sums in held.items():
            for j in range(block, n_blocks):
                at = slice((j - block) * step, (j - block + 1) * step)
                data = np.concatenate([s[:, at].ravel() for s in sums]).tobytes()
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v], pa.int32()) for v in (all_cells[c], block, j, part)), pa.array([data], pa.binary())], ["cell", "i", "j", "part", "data"])

    schema = "cell int, i int, j int, part int, data binary"
    out = spread.mapInArrow(multiply, schema)
    left = n_chunks * n_blocks
    while left > 1:
        out = out.groupBy("cell", "i", "j", (F.col("part") / FAN_IN).cast("int").alias("_to")).applyInArrow(_merge, schema)
        left = -(-left // FAN_IN)
    return out


def fold_blocks(products: DataFrame, m: Marked) -> DataFrame:
    """(fold, cell, i, j, data): the blocks of each training set's cells."""
    return products.join(F.broadcast(m.cells.pairs()), "cell").select("fold", "cell", "i", "j", "data")


def block_parts(data: Sequence[bytes], i: int, j: int, width: int, block: int) -> list[np.ndarray]:
    """The sums of some rows of block (i, j), as matrices."""
    shape = min(block, width - i * block), min(block, width - j * block)
    total = np.frombuffer(data[0], np.float64).copy()
    for raw in data[1:]:
        total += np.frombuffer(raw, np.float64)
    return list(total.reshape(-1, *shape))


def pandas_blocks(pdf: pd.DataFrame, width: int, block: int) -> tuple[int, int, int, list[np.ndarray]]:
    """Fold, first features of the two blocks and their sums, of the rows of one (fold, i, j)."""
    fold, i, j = (int(pdf[c].iloc[0]) for c in ("fold", "i", "j"))
    return fold, i * block, j * block, block_parts(list(pdf["data"]), i, j, width, block)
