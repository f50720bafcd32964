"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.session import staged

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def global_order(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """Adds the dense position 0, 1, ... of each row in a total order, without one task holding
    all rows: rows are range-sorted and written, then the row counts of the sorted partitions
    are accumulated. Only that table of counts (a row for each partition) meets in one task."""
    kept = staged(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    counts = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    mask = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(
        name, F.col("_before") + mask).drop("_at", "_part", "_before")


BATCH_ROWS, BATCH_CONF = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after holding the session's Arrow batches to BATCH_ROWS rows (smaller ones stay): with
    whole texts as rows, the default of 10,000 takes hundreds of MB beside each task's heap."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(BATCH_CONF)) <= BATCH_ROWS:
        conf.set(BATCH_CONF, BATCH_ROWS)
    return df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The values of a column, few of them Python objects at once."""
    for start in range(0, len(column), rows):
        yield from column.slice(start, rows).to_pylist()


_KEPT: dict = {}


def worker_kept(key, build):
    """Something a Python worker keeps from task to task, such as words already looked up. Only
    the last one asked for is kept, so the memory of one worker holds one of them."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def kept_beside(key, build):
    """Something a Python worker keeps as long as what it was last asked for by `worker_kept`."""
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]
