"""Roles of the library's inputs played by the given tables, in DataFrame and SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.tables import read_table, stack_measurements

NUMERIC_CELLS = [
    ("quantity", "raw"), ("extendedprice", "raw"), ("discount", "raw"), ("tax", "raw"),
    ("quantity", "norm"), ("extendedprice", "norm"),
]
STATS = ["mean", "std", "q10", "q25", "median", "q75", "q90", "iqr", "cv", "skewness", "kurtosis"]


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frame log: order lines of a supplier, normalised by the part they order."""
    line = read_table(spark, sf, "lineitem", [
        "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
    ])
    part = read_table(spark, sf, "part", ["p_partkey", "p_size", "p_retailprice"])
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("entity_id"),
        "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_linestatus") != "O", F.col("l_tax")).alias("l_tax"),
        (F.col("l_returnflag") == "R").alias("returned"),
        (F.col("l_quantity") / F.col("p_size")).alias("q_norm"),
        (F.col("l_extendedprice") / F.col("p_retailprice")).alias("p_norm"),
    )


def numeric_cells() -> dict:
    return {
        ("quantity", "raw"): F.col("l_quantity"),
        ("extendedprice", "raw"): F.col("l_extendedprice"),
        ("discount", "raw"): F.col("l_discount"),
        ("tax", "raw"): F.col("l_tax"),
        ("quantity", "norm"): F.col("q_norm"),
        ("extendedprice", "norm"): F.col("p_norm"),
    }


def boolean_cells() -> dict:
    return {"returned": F.col("returned")}


def long_frames(spark: SparkSession, sf: str) -> DataFrame:
    return stack_measurements(frames(spark, sf), ["entity_id"], numeric_cells())


def feature_rows(spark: SparkSession, sf: str) -> DataFrame:
    from folioscope.operators.stats import feature_rows as rows
    return rows(frames(spark, sf), "entity_id", numeric_cells(), boolean_cells())


def frame_statistics(spark: SparkSession, sf: str) -> DataFrame:
    from folioscope.operators.stats import frame_statistics as stats
    return stats(frames(spark, sf), "entity_id", numeric_cells())


def event_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Short logs: some users sit just under the minimum length."""
    return read_table(spark, sf, "events", ["user_id", "value"]).withColumnRenamed("user_id", "entity_id")


def entities(spark: SparkSession, sf: str) -> DataFrame:
    sup = read_table(spark, sf, "supplier")
    nat = read_table(spark, sf, "nation")
    reg = read_table(spark, sf, "region")
    return (
        sup.join(nat, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("uuid"),
            F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("logs/"), "s_name", F.lit(".v1.csv"))).alias("results_path"),
            F.col("r_name").alias("diagnosis"),
            F.when(F.col("r_name") == "AFRICA", "Male").when(F.col("r_name") == "ASIA", "female")
            .when(F.col("r_name") == "EUROPE", "Female").when(F.col("r_name") == "AMERICA", "male")
            .otherwise("unknown").alias("gender"),
            (F.col("s_acctbal") / 100).alias("age"),
        )
    )


ENTITIES_SQL = """entities AS (
  SELECT s_suppkey AS uuid,
         CASE WHEN s_acctbal >= 0 THEN 'logs/' || s_name || '.v1.csv' END AS results_path,
         r_name AS diagnosis,
         CASE r_name WHEN 'AFRICA' THEN 'Male' WHEN 'ASIA' THEN 'female' WHEN 'EUROPE' THEN 'Female'
                     WHEN 'AMERICA' THEN 'male' ELSE 'unknown' END AS gender,
         s_acctbal / 100 AS age
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

FRAMES_SQL = """frames AS (
  SELECT l_suppkey AS entity_id, l_quantity, l_extendedprice, l_discount,
         CASE WHEN l_linestatus <> 'O' THEN l_tax END AS l_tax, l_returnflag = 'R' AS returned,
         l_quantity / p_size AS q_norm, l_extendedprice / p_retailprice AS p_norm
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

LONG_SQL = FRAMES_SQL + """, long AS (
  SELECT entity_id, 'quantity' AS metric, 'raw' AS variant, l_quantity AS value FROM frames
  UNION ALL SELECT entity_id, 'extendedprice', 'raw', l_extendedprice FROM frames
  UNION ALL SELECT entity_id, 'discount', 'raw', l_discount FROM frames
  UNION ALL SELECT entity_id, 'tax', 'raw', l_tax FROM frames
  UNION ALL SELECT entity_id, 'quantity', 'norm', q_norm FROM frames
  UNION ALL SELECT entity_id, 'extendedprice', 'norm', p_norm FROM frames)"""

EVENTS_LONG_SQL = """long AS (
  SELECT user_id AS entity_id, 'value' AS metric, 'raw' AS variant, value FROM events)"""


def stats_sql(long_sql: str = LONG_SQL) -> str:
    """CTEs `long`, `loc`, `stats` (unrounded, gated)."""
    gated = ", ".join(
        f"CASE WHEN n >= 50 THEN {e} END AS {s}" for s, e in {
            **{s: s for s in ["mean", "q10", "q25", "median", "q75", "q90", "iqr"]},
            "std": "sd", "cv": "CASE WHEN abs(mc) > 0.01 * sd THEN sd / mc END",
            "skewness": "sk", "kurtosis": "ku",
        }.items()
    )
    return long_sql + f""", loc AS (
  SELECT entity_id, metric, variant, count(value) AS n, avg(value) AS mean,
         quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.25) AS q25,
         quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q75,
         quantile_cont(value, 0.9) AS q90,
         quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
  FROM long GROUP BY ALL), fence AS (
  SELECT *, CASE WHEN iqr > 0 THEN q25 - 3 * iqr ELSE q25 END AS lo,
            CASE WHEN iqr > 0 THEN q75 + 3 * iqr ELSE q75 END AS hi FROM loc), clipped AS (
  SELECT l.entity_id, l.metric, l.variant, greatest(f.lo, least(f.hi, l.value)) AS c
  FROM long l JOIN fence f USING (entity_id, metric, variant) WHERE l.value IS NOT NULL), mom AS (
  SELECT entity_id, metric, variant, stddev_samp(c) AS sd, avg(c) AS mc, skewness(c) AS sk, kurtosis(c) AS ku
  FROM clipped GROUP BY ALL), stats AS (
  SELECT entity_id, metric, variant, n, {gated}
  FROM fence LEFT JOIN mom USING (entity_id, metric, variant))"""


def stat_rows_sql(long_sql: str = LONG_SQL) -> str:
    """CTE `stat_rows`: (entity_id, metric, variant, stat, value) incl. the boolean share."""
    parts = [
        f"SELECT entity_id, metric, variant, '{s}' AS stat, {s} AS value FROM stats" for s in STATS
    ]
    if long_sql is LONG_SQL:
        parts.append(
            "SELECT entity_id, 'returned', 'raw', 'mean', CASE WHEN count(returned) >= 50 THEN "
            "avg(returned::INT) END FROM frames GROUP BY entity_id"
        )
    return stats_sql(long_sql) + ", stat_rows AS (" + " UNION ALL ".join(parts) + ")"


FEATURES = [f"{m}__{v}__{s}" for m, v in NUMERIC_CELLS for s in STATS] + ["returned__raw__mean"]
