"""Mixing sources to target weights along a time-varying curriculum.

Every source gets a target number of words: its weight's share of all words, at most `epochs`
times its own size, the excess shared out again by weight. A source's weight follows a schedule
over the training time t in [0, 1], rate(t) = target * (1 + slope * (2 t - 1)), whose integral
t + slope * (t^2 - t) is its cumulative demand. Documents of a source stand in a fixed
pseudo-random order; a copy whose words lie at the fraction u of the source's demand is trained
at the t where the integral reaches u. `mixed` range-sorts the copies by that position.

Whole passes over a source are taken as often as they fit; of the last, partial pass a document
is taken if its midpoint lies inside. So a source's taken words miss its target by at most half
its document at the edge, and no document is taken more than `epochs` times.

Cases: null text has size 0; null is a source of its own and sorts last; sources without words
have target 0; equal rows are interchangeable and all counted; an empty table gives no row;
other columns pass through `mixed`, also ones named like a column of `assigned`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import global_order, n_words
from folioscope.session import staged

WEIGHTS, SLOPES, EPOCHS, BUCKET_ROWS = (1, 2, 3), (0.0, 0.5, -0.5), 3, 65_536


def order_key() -> Column:
    """A pseudo-random order of documents that depends on their id and text only."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("\x1f"), F.coalesce("text", F.lit(""))))


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """From (source, source_size): adds rank, weight and target. Sources above their limit are
    fixed at it and the rest shared again, until none is above; only three sums a round reach
    the driver."""
    ranked = global_order(sizes, [F.col("source").asc_nulls_last()], "rank", "sources")
    choice = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = staged(ranked.withColumn("weight", choice), "source-weights")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, limit = 0.0, F.col("source_size") * epochs
    capped = 0
    while True:
        above = limit < F.lit(level) * F.col("weight")
        fixed, free, count = weighted.agg(
            F.coalesce(F.sum(F.when(above, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)), F.count(F.when(above, 1)),
        ).first()
        if (count == capped and level) or not free:
            break
        capped, level = count, (total - fixed) / free
        if not level:
            break
    share = F.lit(float(level)) * F.col("weight")
    return weighted.withColumn("target", F.when(limit < share, limit.cast("double")).otherwise(share))


def assigned(documents: DataFrame, bucket_digits: int, weights=WEIGHTS, slopes=SLOPES, epochs: int = EPOCHS) -> DataFrame:
    """documents with size, key and source -> adds _offset (words of the source before the
    document), source_size, target, copies and positions (one training time for each copy).

    Running sums go over (source, key prefix) buckets first and inside a bucket then, so a
    source of any size is spread over 16 ** bucket_digits tasks."""
    d = documents.withColumn("_bucket", F.substring("_key", 1, bucket_digits) if bucket_digits else F.lit(""))
    buckets = staged(d.groupBy("source", "_bucket").agg(F.sum("_size").alias("_words")), "mix-buckets")
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("_start", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
    goals = source_targets(buckets.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, epochs)
    slope = F.element_at(F.array(*[F.lit(x) for x in slopes]), (F.col("rank") % len(slopes) + 1).cast("int"))
    plan = starts.join(goals.withColumn("_slope", slope), starts["source"].eqNullSafe(goals["source"])).select(
        starts["source"].alias("_plan_source"), starts["_bucket"].alias("_plan_bucket"), "_start",
        F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_slope")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("_before", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    joined = placed.join(plan, placed["source"].eqNullSafe(plan["_plan_source"]) & (placed["_bucket"] == plan["_plan_bucket"]))
    middle = F.col("_start") + F.col("_before") + F.col("_size") / 2
    passes = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    copies = passes + F.when(middle < F.col("_target") - passes * F.col("_source_size"), 1).otherwise(0)
    joined = joined.withColumn("_middle", middle).withColumn("_copies", F.least(copies, F.lit(epochs)).cast("long"))

    def position(k: Column) -> Column:
        u = F.least(F.lit(1.0), (F.col("_middle") + k * F.col("_source_size")) / F.col("_target"))
        a = F.col("_slope")
        root = (F.sqrt((1 - a) * (1 - a) + 4 * a * u) - (1 - a)) / (2 * a)
        return F.when(a == 0, u).otherwise(root)

    rounds = F.when(F.col("_copies") > 0, F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1)).otherwise(F.array().cast("array<long>"))
    return joined.withColumn("_positions", F.transform(rounds, position)).drop("_plan_source", "_plan_bucket", "_before", "_middle", "_slope", "_bucket", "_start")


def bucket_digits(n_rows: int) -> int:
    """Hex digits of the key so that a bucket of the largest source holds about BUCKET_ROWS."""
    return max(0, math.ceil(math.log(max(1, n_rows) / BUCKET_ROWS, 16)))


def measured(documents: DataFrame) -> DataFrame:
    return documents.withColumns({"_size": n_words(F.col("text")), "_key": order_key()})


def shares(documents: DataFrame) -> DataFrame:
    """One row for each document: doc_id, size, source_size, target, taken, positions."""
    small = staged(measured(documents.select("doc_id", "source", "text")).drop("text"), "mix-sizes")
    out = assigned(small, bucket_digits(small.count()))
    return out.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.size("_positions")).cast("long").alias("taken"), F.col("_positions").alias("positions"))


def mixed(documents: DataFrame) -> DataFrame:
    """The mix itself: the columns of documents, a row for each copy, in training order."""
    out = assigned(measured(documents), bucket_digits(documents.select("doc_id").count()))
    copies = out.select(*documents.columns, F.explode("_positions").alias("_position"), "_key")
    return copies.repartitionByRange("_position", "_key").sortWithinPartitions("_position", "_key").select(*documents.columns)
