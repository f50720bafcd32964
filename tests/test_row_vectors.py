"""Row packing: values at their feature's place, gaps as NULL, time in proportion to the width."""

import time

import pytest
from pyspark.sql import functions as F

from folioscope.operators.preprocess import row_vectors


def test_places_and_gaps(spark):
    long = spark.createDataFrame(
        [(1, "b", 2.0), (1, "d", 4.0), (2, "a", 1.0), (2, "c", None), (3, "z", 9.0), (3, "c", 3.0)],
        "row_id long, feature string, value double")
    got = {r["row_id"]: r["x"] for r in row_vectors(long, ["a", "b", "c", "d"]).collect()}
    assert got == {1: [None, 2.0, None, 4.0], 2: [1.0, None, None, None], 3: [None, None, 3.0, None]}


def test_twice_is_an_error(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0)], "row_id long, feature string, value double")
    with pytest.raises(Exception, match="twice"):
        row_vectors(long, ["a"]).collect()


def test_time_grows_with_the_width_only(spark):
    def seconds(width: int) -> float:
        long = spark.range(300 * width).select(
            (F.col("id") / width).cast("long").alias("row_id"),
            F.concat(F.lit("f"), F.col("id") % width).alias("feature"), F.rand(1).alias("value"))
        df = row_vectors(long, [f"f{i}" for i in range(width)])
        best = float("inf")
        for _ in range(3):
            start = time.time()
            df.select(F.sum(F.size("x"))).collect()
            best = min(best, time.time() - start)
        return best

    narrow, wide = seconds(320), seconds(1280)
    assert wide < 8 * narrow + 1.0


def test_random_features_hold_small_batches(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from folioscope.operators import models

    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, 10000)
    df = spark.range(5).select(array_to_vector(F.array(F.col("id").cast("double"))).alias("features"))
    assert len(models.random_fourier(df, 0.5, 1, 1).first()["mapped"]) == models.RANDOM_FEATURES
    assert int(spark.conf.get(conf)) <= 1000
