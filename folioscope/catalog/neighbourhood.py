"""Queries of neighbour search, oversampling and neighbourhood scores over the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import neighbors as nb
from folioscope.sources import tables

QUERIES: dict = {}
SQL: dict = {}
HALF = 1e-9


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def points(spark, sf):
    e = tables.read_table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


_V = "v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"


def _knn_sql(k, name="nn", src="v", vec="vec"):
    return f"""{name} AS (SELECT a.id, b.id AS nn_id, list_distance(a.{vec}, b.{vec}) AS distance,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.{vec}, b.{vec}), b.id) AS rank
  FROM {src} a JOIN {src} b ON a.id <> b.id QUALIFY rank <= {k})"""


@query("j7_knn_exact", "WITH " + _V + ", " + _knn_sql(10) + " SELECT id, nn_id, rank, round(distance + 1e-9, 6) AS distance FROM nn")
def j7(spark, sf):
    return nb.knn_exact(points(spark, sf), 10).select("id", "nn_id", "rank", F.round(F.col("distance") + HALF, 6).alias("distance"))


@query("j8_knn_approximate")
def j8(spark, sf):
    return nb.knn_approximate(points(spark, sf), 10, radius=1.5)


@query("e5_neighbour_graph", "WITH " + _V + ", " + _knn_sql(15) + " SELECT id, nn_id, rank FROM nn")
def e5(spark, sf):
    return nb.knn_exact(points(spark, sf), 15, block_rows=256).select("id", "nn_id", "rank")


@query("e6_fuzzy_weights")
def e6(spark, sf):
    return nb.fuzzy_weights(nb.knn_exact(points(spark, sf), 15), 15)


@query("e8_trustworthiness", "WITH " + _V + ", e AS (SELECT id, list_slice(vec, 1, 2) AS vec FROM v), " + _knn_sql(15, "en", "e") + """,
r AS (SELECT a.id, b.id AS nn_id, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS r FROM v a JOIN v b ON a.id <> b.id),
c AS (SELECT count(*) AS n FROM v)
SELECT n, 15 AS k, round(1 - 2.0::DOUBLE / (n * 15 * (2.0 * n - 46)) * s + 1e-9, 6) AS trustworthiness
FROM c, (SELECT sum(greatest(r - 15, 0)) AS s FROM en JOIN r USING (id, nn_id))""")
def e8(spark, sf):
    p = points(spark, sf)
    flat = p.select("id", F.slice("vec", 1, 2).alias("vec"))
    return nb.trustworthiness(p, flat, 15).withColumn("trustworthiness", F.round(F.col("trustworthiness") + HALF, 6))


@query("r1_oversampled_counts", """WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
SELECT label, synthetic, n FROM (SELECT label, false AS synthetic, n FROM n UNION ALL SELECT label, true, max(n) OVER () - n FROM n) WHERE n > 0""")
def r1(spark, sf):
    return nb.oversample(points(spark, sf), "label").groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("r1_oversampled_points")
def r1_points(spark, sf):
    return nb.oversample(points(spark, sf), "label").where("synthetic")
