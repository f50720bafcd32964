import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import neighbors as nb


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.3, size=(40, 3)) for c in (0, 3, 9)])
    x = np.vstack([x, np.repeat(x[:1], 40, axis=0)])  # many copies of one point
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i % 40 == 0)) for i, r in enumerate(x)], "id bigint, vec array<double>, label int")
    return x, df


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def test_blocks_agree_with_brute_force(cloud):
    x, df = cloud
    want = brute(x, 6)
    out = nb.knn_exact(df, 6, block_rows=16).collect()
    assert len(out) == len(x) * 6
    for r in out:
        assert want[r["id"], r["rank"] - 1] == r["nn_id"]


def test_oversampling(cloud):
    x, df = cloud
    rows = nb.oversample(df, "label", 2).collect()
    counts = {}
    for r in rows:
        counts[r["label"]] = counts.get(r["label"], 0) + 1
    assert counts[0] == counts[1]
    small = x[[i for i in range(len(x)) if i % 40 == 0]]
    for r in rows:
        if r["synthetic"]:
            v = np.array(r["vec"])
            gap = min(
                np.linalg.norm(a + np.clip(np.dot(v - a, b - a) / max(np.dot(b - a, b - a), 1e-12), 0, 1) * (b - a) - v)
                for a in small for b in small)
            assert gap < 1e-9


def test_fuzzy_weights_and_identity(cloud):
    x, df = cloud
    distinct = df.where(F.col("id") < 120)
    w = {(r["src"], r["dst"]): r["weight"] for r in nb.fuzzy_weights(nb.knn_exact(distinct, 8), 8).collect()}
    assert all(abs(w[b, a] - v) < 1e-12 and 0 <= v <= 1 for (a, b), v in w.items())
    t = nb.trustworthiness(distinct, distinct.select("id", "vec"), 5, block_rows=32).first()
    assert t["trustworthiness"] == 1.0


def test_trustworthiness_brute_force(cloud):
    x, df = cloud
    x, df = x[:120], df.where(F.col("id") < 120)
    k, n = 5, 120
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, -1)
    rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1)
    near = brute(x[:, :1], k)
    want = 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * sum(max(0, rank[i, j] - k) for i in range(n) for j in near[i])
    flat = df.select("id", F.slice("vec", 1, 1).alias("vec"))
    assert nb.trustworthiness(df, flat, k, block_rows=32).first()["trustworthiness"] == pytest.approx(want)


def test_string_ids(cloud):
    x, df = cloud
    named = df.withColumn("id", F.format_string("p%04d", "id"))
    plain = {(r["id"], r["rank"]): r["nn_id"] for r in nb.knn_exact(df, 4, block_rows=16).collect()}
    for r in nb.knn_exact(named, 4, block_rows=16).collect():
        assert int(r["nn_id"][1:]) == plain[int(r["id"][1:]), r["rank"]]
    want = {r["label"]: r["count"] for r in nb.oversample(df, "label", 2).groupBy("label").count().collect()}
    assert {r["label"]: r["count"] for r in nb.oversample(named, "label", 2).groupBy("label").count().collect()} == want
    flat, flat_named = (d.select("id", F.slice("vec", 1, 1).alias("vec")) for d in (df, named))
    assert nb.trustworthiness(named, flat_named, 5, block_rows=32).first() == nb.trustworthiness(df, flat, 5, block_rows=32).first()


def test_more_rows_do_not_make_more_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r], "") for i, r in enumerate(x)], "id bigint, vec array<double>, grp string")
    # With blocks of a fixed size every row was sent to 188 of them.
    assert nb.BlockedPoints(df, block_rows=16).blocks.count() <= 3 * nb.BLOCKS


def test_kernel_with_copies_and_missing_values():
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(50, 3)), np.zeros((80, 3)), [[np.nan, 0, 0]]])
    ids = rng.permutation(len(x))
    loose = np.full(len(x), np.inf)
    d = nb._distances(x, x)
    d[~np.isfinite(d) | (ids[:, None] == ids[None, :])] = np.inf
    want = {(ids[i], ids[j]) for i in range(130) for j in sorted(range(130), key=lambda j: (d[i, j], ids[j]))[:4]}
    for a, b in ((x, x[::-1]), (x[::-1], x)):
        ids_a, ids_b = (ids if v is x else ids[::-1] for v in (a, b))
        both = nb._nearest(a, ids_a, loose, b, ids_b, 4, loose)
        assert set(zip(both["id"], both["nn_id"])) == want and len(both) == 2 * len(want)


def test_approximate_equals_the_projection_join(cloud, spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    x, df = cloud
    v = df.select("id", array_to_vector("vec").alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.7, numHashTables=3, seed=42).fit(v)
    met = {}
    for r in model.approxSimilarityJoin(v, v, 0.6, "d").select("datasetA.id", F.col("datasetB.id").alias("nn"), "d").collect():
        if r["id"] != r["nn"]:
            met.setdefault(r["id"], []).append((r["d"], r["nn"]))
    want = {(i, n): rank for i, found in met.items() for rank, (_, n) in enumerate(sorted(found)[:4], 1)}
    out = nb.knn_approximate(df, 4, 0.6, tables=3, bucket=0.7, block_rows=16)
    assert "BroadcastNestedLoop" not in out._jdf.queryExecution().toString()
    assert {(r["id"], r["nn_id"]): r["rank"] for r in out.collect()} == want


def test_short_vectors_do_not_meet_in_one_task(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(4000, 2)))], "id bigint, vec array<double>")
    out = nb.knn_exact(df, 3, block_rows=16).select("id", "nn_id")
    assert out.count() == 3 * 4000
    a = spark.range(24).select(F.col("id").alias("block_a"), F.col("id").alias("block_b"))
    b = a.select(F.col("block_a").alias("to_a"), F.col("block_b").alias("to_b"))

    def task(left, right):
        from pyspark import TaskContext
        import pandas as pd
        return pd.DataFrame({"part": [TaskContext.get().partitionId()]})

    # Adaptive execution joined these few bytes into one task.
    assert len({r["part"] for r in nb._met(a, b, task, "part int").collect()}) > 12


def test_screening_in_single_precision_loses_nothing():
    rng = np.random.default_rng(3)
    for scale, kind in ((1.0, np.float32), (1e-15, np.float64), (1e20, np.float64)):
        x = np.round(rng.normal(size=(300, 6)), 2) * scale
        y = np.concatenate([x[:40], np.round(rng.normal(size=(360, 6)), 2) * scale, x[:40]])
        left, right, slack = nb._factors(x, y, np.float32)
        squares, gaps = left @ right, nb._distances(x, y)
        assert squares.dtype == kind
        assert (np.abs(squares - gaps * gaps) <= slack).all()
        others = np.arange(440) + 1000
        got = nb._nearest(x, np.arange(300), np.full(300, np.inf), y, others, 7)
        wanted = {(i, others[j]) for i in range(300) for j in np.lexsort((others, gaps[i]))[:7]}
        assert set(zip(got["id"], got["nn_id"])) == wanted


def test_vectors_are_moved_packed(spark):
    x = np.random.default_rng(4).normal(size=(50, 3))
    points = spark.createDataFrame([(i, [float(a) for a in v], "") for i, v in enumerate(x)], "id long, vec array<double>, grp string")
    rows = nb.BlockedPoints(points, 16).rows
    assert rows.schema["vec"].dataType.simpleString() == "binary"
    kept = rows.select("id", "vec").toPandas()
    assert np.array_equal(nb._unpacked(kept["vec"]), x[kept["id"]])


def test_values_below_limits_are_counted_by_bins():
    rng = np.random.default_rng(3)
    for values in (rng.normal(size=5000), np.round(rng.normal(size=5000), 1), np.zeros(5000), np.append(rng.normal(size=900), [np.inf] * 100)):
        for limits in (rng.normal(size=7), values[:9], np.array([0.0]), np.array([-9.0, 9.0]), np.array([0.1, np.nan]), np.array([0.0, np.inf])):
            assert (nb._below(values, limits) == np.searchsorted(np.sort(values), limits, "left")).all()


def test_trustworthiness_of_several_embeddings(spark):
    x, k = np.random.default_rng(5).normal(size=(90, 5)), 6

    def order(v):
        gap = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
        np.fill_diagonal(gap, np.inf)
        return gap.argsort(axis=1, kind="stable")

    first = order(x)
    frame = lambda v: spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(v)], "id bigint, vec array<double>")
    near = spark.createDataFrame([(i, int(j)) for i in range(90) for j in first[i, :k]], "id bigint, nn_id bigint")
    got = {r["embedding"]: r["trustworthiness"] for r in nb.trustworthiness_of(frame(x), [frame(x[:, :1]), frame(x[:, :2])], k, original=near).collect()}
    rank = first.argsort(axis=1) + 1
    for i, d in enumerate((1, 2)):
        over = np.maximum(np.take_along_axis(rank, order(x[:, :d])[:, :k], axis=1) - k, 0).sum()
        assert got[i] == pytest.approx(1 - 2 * over / (90 * k * (2 * 90 - 3 * k - 1)))
    assert sorted(got) == [0, 1]
