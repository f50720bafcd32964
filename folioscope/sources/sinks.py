"""Writers. One table per kind of result, partitioned by task and target where both exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide_matrix(rows: DataFrame, ids: Sequence[str], features: Sequence[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Long to wide for export; the known feature list saves the distinct pass of a bare pivot."""
    return rows.groupBy(*ids).pivot(feature, list(features)).agg(F.first(value, ignorenulls=True))


def write_table(df: DataFrame, root: str, kind: str, partitions: Sequence[str] = (), fmt: str = "parquet") -> str:
    path = f"{root}/{kind}"
    writer = df.write.mode("overwrite")
    if partitions:
        writer = writer.partitionBy(*partitions)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_results(results: dict[str, DataFrame], root: str, task: str, target: str, fmt: str = "parquet") -> dict[str, str]:
    """Each result kind under `kind/task=…/target=…`."""
    tagged = {
        kind: df.withColumn("task", F.lit(task)).withColumn("target", F.lit(target))
        for kind, df in results.items()
    }
    paths = {}
    for kind, df in tagged.items():
        path = f"{root}/{kind}"
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.partitionBy("task", "target").format(fmt).save(path)
        paths[kind] = path
    return paths


def label_map(labels: DataFrame, label: str) -> DataFrame:
    """(label, encoded): classes numbered from 0 in alphabetical order."""
    from pyspark.sql import Window

    classes = labels.select(F.col(label).cast("string").alias("label")).distinct()
    return classes.select(
        "label", (F.row_number().over(Window.orderBy("label")) - 1).alias("encoded")
    )
