"""Exact order statistics without ever holding one group in one task.

Rows are reduced to distinct values with their counts. Groups are counted in hash buckets first;
those of a bucket of up to `CELL_ROWS` rows are one cell each and their rows are moved once. The
values of the others are combined before the shuffle and fall into `SHARDS` value ranges whose
bounds are approximate quantiles of the column, so a (group, shard) cell can hold only about
1/SHARDS of the column however large the group is. Running sums inside a cell plus the sums
of the earlier cells give exact running sums over the group; buckets and bounds only decide how
the work is spread and never change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_SIDE = 8
SHARDS = SHARD_SIDE * SHARD_SIDE
SKETCH_ACCURACY = 2000
# Rows one cell may hold without value ranges, and the buckets groups are counted in.
CELL_ROWS = 1_000_000
BUCKETS = 65_536


def with_shard(df: DataFrame, value: str, within: Sequence[str] = (), shard: str = "shard") -> DataFrame:
    """Add the value-range number of `value`.

    `within` names columns whose values get separate bounds; their combinations must be
    bounded by the schema (metric or feature names), never by the data, because the bounds
    table is broadcast.
    """
    marks = F.array(*[F.lit(i / SHARDS) for i in range(1, SHARDS)])
    bounds = df.groupBy(*within).agg(
        F.percentile_approx(value, marks, SKETCH_ACCURACY).alias("_bounds")
    )
    if within:
        joined = df.join(F.broadcast(bounds), list(within), "left")
    else:
        # One row of bounds, joined through a literal key.
        joined = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(bounds.withColumn("_one", F.lit(1))), "_one", "left"
        ).drop("_one")

    def passed(position: Column) -> Column:
        return F.when(F.col(value) > F.get(F.col("_bounds"), position), 1).otherwise(0)

    coarse = sum((passed(F.lit(SHARD_SIDE * i - 1)) for i in range(1, SHARD_SIDE)), F.lit(0))
    fine = sum(
        (passed(F.col("_coarse") * SHARD_SIDE + j) for j in range(SHARD_SIDE - 1)), F.lit(0)
    )
    return (
        joined.withColumn("_coarse", coarse)
        .withColumn(shard, F.col("_coarse") * SHARD_SIDE + fine)
        .drop("_bounds", "_coarse")
    )


def combined(
    df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], within: Sequence[str] = ()
) -> DataFrame:
    """One row per (keys, shard, value) with the aggregates `sums` of its rows.

    The driver sees the numbers of the crowded buckets only, `BUCKETS` at most.
    """
    keys = list(keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)) if keys else F.lit(0)
    marked = df.withColumn("_bucket", bucket.cast("int"))
    crowded = marked.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > CELL_ROWS).select("_bucket").collect()

    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys, "shard", value).agg(*[e.alias(m) for m, e in sums.items()])

    def whole(rows: DataFrame) -> DataFrame:
        # Partitioned as the windows and joins over cells need it, so that no row moves again.
        dealt = rows.repartition(*keys) if keys else rows
        return summed(dealt.withColumn("shard", F.lit(0)))

    if not crowded:
        return whole(df)
    listed = F.broadcast(df.sparkSession.createDataFrame([(r["_bucket"],) for r in crowded], "_bucket int"))
    spread = summed(with_shard(marked.join(listed, "_bucket", "left_semi").drop("_bucket"), value, within))
    return spread.unionByName(whole(marked.join(listed, "_bucket", "left_anti").drop("_bucket")))


def shard_offsets(
    cells: DataFrame, keys: Sequence[str], shard: str, sums: dict[str, Column], descending: bool = False
) -> DataFrame:
    """Per (keys, shard): each sum over the earlier shards (`{m}_base`) and the group (`{m}_all`)."""
    per_shard = cells.groupBy(*keys, shard).agg(*[e.alias(m) for m, e in sums.items()])
    order = F.col(shard).desc() if descending else F.col(shard)
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = group.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return per_shard.select(
        *keys,
        shard,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"{m}_base") for m in sums],
        *[F.sum(m).over(group).alias(f"{m}_all") for m in sums],
    )


def running_sums(
    cells: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], shard: str = "shard",
    descending: bool = False, totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Add, for cells with one row per (keys, order), `{m}_before` and `{m}_all` of each sum.

    `totals` are further aggregates of which only the group value `{t}_all` is wanted.
    """
    return running_sums_and_offsets(cells, keys, order, sums, shard, descending, totals)[0]


def running_sums_and_offsets(
    cells: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], shard: str = "shard",
    descending: bool = False, totals: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    totals = totals or {}
    offsets = shard_offsets(
        cells, keys, shard, {**{m: F.sum(m) for m in sums}, **totals}, descending
    )
    by = F.col(order).desc() if descending else F.col(order)
    inside = (
        Window.partitionBy(*keys, shard).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    )
    stepped = cells.select("*", *[
        F.coalesce(F.sum(m).over(inside), F.lit(0)).alias(f"{m}_inside") for m in sums
    ])
    joined = stepped.join(offsets, [*keys, shard])
    for m in sums:
        joined = joined.withColumn(f"{m}_before", F.col(f"{m}_inside") + F.col(f"{m}_base"))
    extra = [f"{m}_inside" for m in sums] + [f"{m}_base" for m in [*sums, *totals]]
    return joined.drop(*extra), offsets


def value_cells(
    df: DataFrame, keys: Sequence[str], value: str, within: Sequence[str] = (),
    keep_missing: bool = False,
) -> DataFrame:
    """Distinct values per group with their counts: (keys, shard, value, cnt).

    `keep_missing` adds one cell per group for its NULLs, with cnt 0 and their number in
    `missing`, so that groups without any value stay in the result.
    """
    rows = df.select(*keys, value)
    if not keep_missing:
        rows = rows.where(F.col(value).isNotNull())
    if not keep_missing:
        return combined(rows, keys, value, {"cnt": F.count(F.lit(1))}, within)
    missing = F.count(F.lit(1)) - F.count(value)
    return combined(rows, keys, value, {"cnt": F.count(value), "missing": missing}, within)


def value_at(index: Column, value: str) -> Column:
    """Aggregate: the value that covers a 0-based position of the sorted group."""
    covers = (F.col("cnt_before") <= index) & (index < F.col("cnt_before") + F.col("cnt"))
    return F.max(F.when(covers, F.col(value)))


def interpolate(lo: Column, hi: Column, position: Column) -> Column:
    return lo + (hi - lo) * (position - F.floor(position))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
    within: Sequence[str] = (),
) -> DataFrame:
    """Linearly interpolated quantiles per group: one column per entry of `probs`, plus `n`."""
    ladder = running_sums(value_cells(df, keys, value, within), keys, value, ["cnt"])
    return quantiles_of_ladder(ladder, keys, value, probs)


def quantiles_of_ladder(
    ladder: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
    carry: Sequence[str] = (),
) -> DataFrame:
    """Quantiles from the output of `running_sums` on value cells; `carry` keeps group sums."""
    n = F.col("cnt_all")
    at = {name: (n - 1) * F.lit(p) for name, p in probs.items()}
    positions = [f(h).cast("bigint") for h in at.values() for f in (F.floor, F.ceil)]
    hit = F.col(value).isNull()  # keeps groups without any value
    for p in positions:
        hit = hit | ((F.col("cnt_before") <= p) & (p < F.col("cnt_before") + F.col("cnt")))
    aggs = [F.max("cnt_all").alias("n")] + [F.max(c).alias(c) for c in carry]
    for name, h in at.items():
        aggs.append(value_at(F.floor(h).cast("bigint"), value).alias(f"_{name}_lo"))
        aggs.append(value_at(F.ceil(h).cast("bigint"), value).alias(f"_{name}_hi"))
    picked = ladder.where(hit).groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys, "n", *carry,
        *[
            interpolate(F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), (F.col("n") - 1) * F.lit(p)).alias(name)
            for name, p in probs.items()
        ],
    )


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rank: str = "avg_rank",
    within: Sequence[str] = (),
) -> DataFrame:
    """Average-tie rank of every distinct value: (keys, shard, value, cnt, rank, cnt_all)."""
    ladder = running_sums(value_cells(df, keys, value, within), keys, value, ["cnt"])
    return ladder.withColumn(
        rank, F.col("cnt_before").cast("double") + (F.col("cnt") + 1) / F.lit(2.0)
    ).drop("cnt_before")
