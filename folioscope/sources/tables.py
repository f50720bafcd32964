"""Scans. Every reader normalises NaN to NULL once, so later aggregates skip missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The two log files of one entity directory and the column never used.
RAW_FILE = "video_metrics_raw_2d.csv"
NORM_FILE = "video_metrics_normalised.csv"
SKIP_COLUMNS = ("segment_id",)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[
        F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floats else F.col(c)
        for c in df.columns
    ])


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One parquet table of a folder, pruned to `columns` at the scan."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return nan_to_null(df.select(*columns) if columns else df)


def read_entities_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Entity table with a header row; the schema is explicit, so there is no inference pass."""
    return nan_to_null(
        spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    )


def read_frame_logs(spark: SparkSession, root: str, schema: T.StructType, file_name: str = RAW_FILE) -> DataFrame:
    """All entities' logs of one kind in one scan; the entity is the directory name.

    The first column is the frame number and is dropped, as is every column never used. The
    directories are listed by tasks; a pattern of directories would be expanded one by one on the driver.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    depth = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).depth()
    parts = F.split(F.parse_url(F.col("_metadata.file_path"), F.lit("PATH")), "/")
    raw = (
        spark.read.schema(schema).option("header", True).option("enforceSchema", False)
        .option("recursiveFileLookup", True).option("pathGlobFilter", file_name).csv(root)
        .where(F.size(parts) == depth + 3)
        .select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("entity_id"))
    )
    return nan_to_null(raw.drop(schema.fields[0].name, *SKIP_COLUMNS))


def with_variants(raw: DataFrame, norm: DataFrame | None) -> DataFrame:
    """Raw and normalised logs in one table; metrics absent from one side are NULL there."""
    tagged = raw.withColumn("variant", F.lit("raw"))
    if norm is None:
        return tagged
    shared = [c for c in norm.columns if c in raw.columns]
    return tagged.unionByName(
        norm.select(*shared).withColumn("variant", F.lit("norm")), allowMissingColumns=True
    )


def metric_columns(frames: DataFrame, ids: Sequence[str] = ("entity_id", "variant")) -> tuple[list[str], list[str]]:
    """(numeric metrics, boolean metrics) by schema type."""
    numeric, boolean = [], []
    for f in frames.schema.fields:
        if f.name in ids or f.name in SKIP_COLUMNS:
            continue
        if isinstance(f.dataType, T.BooleanType):
            boolean.append(f.name)
        elif isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
    return numeric, boolean


def long_measurements(frames: DataFrame, ids: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Unpivot metric columns to (ids, metric, value)."""
    typed = frames.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return typed.unpivot(list(ids), list(metrics), "metric", "value")


def stack_measurements(frames: DataFrame, ids: Sequence[str], cells: Mapping[tuple[str, str], Column]) -> DataFrame:
    """(ids, metric, variant, value) when raw and normalised values sit on the same row."""
    parts = []
    for (metric, variant), value in cells.items():
        parts += [F.lit(metric), F.lit(variant), value.cast("double")]
    return frames.select(
        *ids, F.stack(F.lit(len(cells)), *parts).alias("metric", "variant", "value")
    )


def variants_present(frames: DataFrame, norm_metrics: Sequence[str], long: DataFrame) -> DataFrame:
    """Drop the normalised rows of metrics the normalised log never had."""
    return long.where((F.col("variant") == "raw") | F.col("metric").isin(list(norm_metrics)))


def missing_sources(entities: DataFrame, frames: DataFrame, key: str) -> DataFrame:
    """Entities listed but without a single frame."""
    return entities.join(frames.select(key).distinct(), key, "left_anti")
