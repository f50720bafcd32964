"""Robust per-entity summary statistics of frame logs.

Frames stay wide until after the only shuffle of the data, by entity; unpivoting first would
ship the metric names with every value. Entities too long for one task take a second path
that spreads each of their metrics over value ranges (see `ordered`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import NAME_SEPARATOR, clip, feature_name, safe_divide
from folioscope.operators.ordered import (
    quantiles_of_ladder,
    running_sums_and_offsets,
    value_cells,
)
from folioscope.sources.tables import stack_measurements

# The gate, the fence width, the ratio guard and the statistic names.
MIN_VALID = 50
FENCE_IQRS = 3.0
CV_GUARD = 0.01
QUANTILES = {"q10": 0.10, "q25": 0.25, "median": 0.50, "q75": 0.75, "q90": 0.90}
STATISTICS = ["mean", "std", "q10", "q25", "median", "q75", "q90", "iqr", "cv", "skewness", "kurtosis"]
VARIANTS = ["raw", "norm"]

# Longest entity, in frames, that one task may hold.
HOT_ROWS = 5_000_000


@dataclass
class Located:
    """Value cells, their (keys, shard) list with the count of the group, and one row per group with quantiles and fences."""

    cells: DataFrame
    shards: DataFrame
    groups: DataFrame


def location_statistics(
    long: DataFrame, keys: Sequence[str], value: str = "value", within: Sequence[str] = ()
) -> Located:
    cells = value_cells(long, keys, value, within, keep_missing=True)
    ladder, offsets = running_sums_and_offsets(
        cells, keys, value, ["cnt"], totals={"total": F.sum(F.col(value) * F.col("cnt"))}
    )
    base = quantiles_of_ladder(ladder, keys, value, QUANTILES, carry=["total_all"])
    iqr = F.col("q75") - F.col("q25")
    # A flat middle half closes the fences on it, which makes the clipped group constant.
    groups = base.select(
        *keys, "n", safe_divide(F.col("total_all"), F.col("n")).alias("mean"), *QUANTILES,
        iqr.alias("iqr"),
        F.when(iqr > 0, F.col("q25") - FENCE_IQRS * iqr).otherwise(F.col("q25")).alias("lo"),
        F.when(iqr > 0, F.col("q75") + FENCE_IQRS * iqr).otherwise(F.col("q75")).alias("hi"),
    )
    return Located(cells, offsets.select(*keys, "shard", "cnt_all"), groups)


def clipped_moments(located: Located, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Sums of powers of the clipped values, centred on the median and scaled by the iqr.

    Clipping bounds the scaled deviation, so the raw power sums stay well conditioned and one
    combinable pass replaces a mean pass followed by a deviation pass. The fences travel to the
    cells by (group, shard), which the cells are already partitioned by.
    """
    scale = F.when(F.col("iqr") > 0, F.col("iqr")).otherwise(F.lit(1.0))
    # By count, not by value, in both: without the values, or with fewer, their rows would move once more.
    fences = located.shards.where(F.col("cnt_all") > 0).drop("cnt_all").join(
        located.groups.select(*keys, "median", "iqr", "lo", "hi"), list(keys)
    )
    d = F.col("_d")
    spread = located.cells.where(F.col("cnt") > 0).join(fences, [*keys, "shard"]).withColumn(
        "_d", (clip(F.col(value), F.col("lo"), F.col("hi")) - F.col("median")) / scale
    )
    return spread.groupBy(*keys).agg(
        F.sum(F.col("cnt") * d).alias("_s1"),
        F.sum(F.col("cnt") * (d * d)).alias("_s2"),
        F.sum(F.col("cnt") * (d * d * d)).alias("_s3"),
        F.sum(F.col("cnt") * (d * d * d * d)).alias("_s4"),
    )


def moment_statistics(n: Column) -> dict[str, Column]:
    """std, cv, skewness and kurtosis as expressions over the output of `clipped_moments`."""
    n = n.cast("double")
    scale = F.when(F.col("iqr") > 0, F.col("iqr")).otherwise(F.lit(1.0))
    a1, a2, a3, a4 = (F.col(f"_s{p}") / n for p in (1, 2, 3, 4))
    m2 = F.greatest(a2 - a1 * a1, F.lit(0.0))
    m3 = a3 - 3 * a1 * a2 + 2 * F.pow(a1, F.lit(3))
    m4 = a4 - 4 * a1 * a3 + 6 * a1 * a1 * a2 - 3 * F.pow(a1, F.lit(4))
    std = scale * F.sqrt(safe_divide(m2 * n, n - 1))
    centre = F.col("median") + scale * a1
    varies = m2 > 0
    skew = F.when(varies, safe_divide(m3, F.pow(m2, F.lit(1.5)))) * safe_divide(F.sqrt(n * (n - 1)), n - 2)
    excess = F.when(varies, safe_divide(m4, m2 * m2)) - 3
    kurt = safe_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * excess + 6)
    return {
        "std": std,
        "cv": F.when(F.abs(centre) > CV_GUARD * std, safe_divide(std, centre)),
        "skewness": F.when(n > 2, skew),
        "kurtosis": F.when(n > 3, kurt),
    }


def _ready(groups: DataFrame, keys: Sequence[str], late: dict[str, Column], min_valid: int) -> DataFrame:
    return groups.select(*keys, "n", *[
        F.when(F.col("n") >= min_valid, late.get(s, F.col(s))).alias(s) for s in STATISTICS
    ])


def sharded_statistics(
    long: DataFrame, keys: Sequence[str], value: str = "value",
    within: Sequence[str] = ("metric", "variant"), min_valid: int = MIN_VALID,
) -> DataFrame:
    """Statistics of long measurements for groups of any length.

    The names in `within` are bounded by the schema; a short number stands for them until the end,
    so that they don't travel with every value.
    """
    keys = list(keys)
    names = [c for c in keys if c in within]
    if not names:
        return _sharded(long, keys, value, within, min_valid)
    known = sorted(tuple(r) for r in long.select(*names).distinct().collect() if None not in tuple(r))
    if not known:
        return _sharded(long, keys, value, within, min_valid)
    # As names joins never match null, groups of a null name don't stand in the result.
    kind = F.coalesce(*[F.when(reduce(Column.__and__, [F.col(c) == v for c, v in zip(names, some)]), i) for i, some in enumerate(known)])
    short = [c for c in keys if c not in names] + ["_kind"]
    coded = long.withColumn("_kind", kind).where(F.col("_kind").isNotNull()).select(*short, value)
    stats = _sharded(coded, short, value, ["_kind"], min_valid)
    spelled = [F.element_at(F.array(*[F.lit(some[i]) for some in known]), F.col("_kind") + 1).alias(c) for i, c in enumerate(names)]
    return stats.select("*", *spelled).select(*keys, "n", *STATISTICS)


def _sharded(long: DataFrame, keys: list[str], value: str, within: Sequence[str], min_valid: int) -> DataFrame:
    # The joins over cells drop null keys anyway; dropped here, all readers of the cells share one exchange.
    located = location_statistics(long.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in keys])), keys, value, within)
    full = located.groups.join(clipped_moments(located, keys, value), keys, "left")
    return _ready(full, keys, moment_statistics(F.col("n")), min_valid)


def grouped_statistics(
    frames: DataFrame, key: str, cells: Mapping[tuple[str, str], Column], min_valid: int = MIN_VALID
) -> DataFrame:
    """Statistics when every entity fits one task: a single exchange, by entity.

    The values of a metric become one sorted array per entity. Quantiles and fences are read from
    its positions, the moments of the clipped values from its elements, all without another exchange.
    """
    names = [f"{m}{NAME_SEPARATOR}{v}" for m, v in cells]
    held = frames.where(F.col(key).isNotNull()).select(
        key, *[c.cast("double").alias(n) for n, c in zip(names, cells.values())]
    ).repartition(key)
    lists = held.groupBy(key).agg(*[F.sort_array(F.collect_list(name)).alias(name) for name in names])
    parts = []
    for name, (metric, variant) in zip(names, cells):
        parts += [F.lit(metric), F.lit(variant), F.col(name)]
    group = [key, "metric", "variant"]
    long = lists.select(key, F.stack(F.lit(len(names)), *parts).alias("metric", "variant", "values"))

    def quantile(p: float) -> Column:
        position = (F.size("values") - 1) * F.lit(p)
        low, high = F.floor(position).cast("int"), F.ceil(position).cast("int")
        lo, hi = F.get("values", low), F.get("values", high)
        return F.when(lo == hi, lo).otherwise((high - position) * lo + (position - low) * hi)

    located = long.select(*group, "values", F.size("values").cast("bigint").alias("n"), *[
        quantile(p).alias(name) for name, p in QUANTILES.items()])
    iqr = F.col("q75") - F.col("q25")
    fenced = located.select(
        *group, "values", "n", *QUANTILES, iqr.alias("iqr"),
        F.when(iqr > 0, F.col("q25") - FENCE_IQRS * iqr).otherwise(F.col("q25")).alias("lo"),
        F.when(iqr > 0, F.col("q75") + FENCE_IQRS * iqr).otherwise(F.col("q75")).alias("hi"))
    scale = F.when(F.col("iqr") > 0, F.col("iqr")).otherwise(F.lit(1.0))
    scaled = fenced.select(
        *group, "n", *QUANTILES, "iqr",
        safe_divide(F.aggregate("values", F.lit(0.0), lambda s, x: s + x), F.col("n")).alias("mean"),
        F.transform("values", lambda x: (clip(x, F.col("lo"), F.col("hi")) - F.col("median")) / scale).alias("_d"))
    powers = {"_s1": lambda s, d: s + d, "_s2": lambda s, d: s + d * d,
              "_s3": lambda s, d: s + d * d * d, "_s4": lambda s, d: s + d * d * (d * d)}
    # Sums of powers about the median, as in `clipped_moments`; the elements never become rows.
    moments = scaled.select(*group, "n", *QUANTILES, "iqr", "mean", *[
        F.when(F.col("n") > 0, F.aggregate("_d", F.lit(0.0), add)).alias(name) for name, add in powers.items()])
    return _ready(moments, group, moment_statistics(F.col("n")), min_valid)


def frame_statistics(
    frames: DataFrame, key: str, cells: Mapping[tuple[str, str], Column],
    min_valid: int = MIN_VALID, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """One row per (entity, metric, variant) with all eleven statistics; NULLs below the gate.

    `cells` maps (metric, variant) to its column. Whether some entity has more than `hot_rows`
    frames is asked of the key column alone.
    """
    hot = frames.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select(key)
    if hot.isEmpty():
        return grouped_statistics(frames, key, cells, min_valid)
    spread_out = stack_measurements(frames.join(hot, key, "left_semi"), [key], cells)
    return grouped_statistics(frames.join(hot, key, "left_anti"), key, cells, min_valid).unionByName(
        sharded_statistics(spread_out, [key, "metric", "variant"], min_valid=min_valid)
    )


def boolean_statistics(
    long: DataFrame, keys: Sequence[str] = ("entity_id", "metric", "variant"),
    value: str = "value", min_valid: int = MIN_VALID,
) -> DataFrame:
    """Share of true values, with the same gate."""
    v = F.col(value).cast("double")
    return long.groupBy(*keys).agg(
        F.when(F.count(v) >= min_valid, F.avg(v)).alias("mean")
    )


def to_stat_rows(stats: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Long form (keys, stat, value)."""
    return stats.unpivot(list(keys), list(names), "stat", "value")


def feature_rows(
    frames: DataFrame, key: str, numeric: Mapping[tuple[str, str], Column],
    boolean: Mapping[str, Column] | None = None, min_valid: int = MIN_VALID, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The whole extractor: (key, feature, metric, variant, stat, value).

    Boolean metrics give their share of true values, for the raw variant only.
    """
    keys = [key, "metric", "variant"]
    rows = to_stat_rows(frame_statistics(frames, key, numeric, min_valid, hot_rows), keys, STATISTICS)
    if boolean:
        flags = stack_measurements(frames, [key], {(m, "raw"): c for m, c in boolean.items()})
        rows = rows.unionByName(to_stat_rows(boolean_statistics(flags, keys, min_valid=min_valid), keys, ["mean"]))
    return rows.withColumn(
        "feature", feature_name(F.col("metric"), F.col("variant"), F.col("stat"))
    )


def approximate_quantiles(
    long: DataFrame, keys: Sequence[str], value: str = "value", accuracy: int = 10000
) -> DataFrame:
    """One-pass sketch for logs where a rank error of n/accuracy is acceptable."""
    marks = F.array(*[F.lit(p) for p in QUANTILES.values()])
    sketch = long.groupBy(*keys).agg(
        F.count(value).alias("n"), F.percentile_approx(value, marks, accuracy).alias("_q")
    )
    return sketch.select(
        *keys, "n", *[F.get(F.col("_q"), F.lit(i)).alias(q) for i, q in enumerate(QUANTILES)]
    )
