"""Dimensionality reduction of a preprocessed matrix with its clinical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import reduce as rd
from folioscope.operators.neighbors import fuzzy_weights, knn_exact, trustworthiness
from folioscope.session import cut_lineage, staged

METHODS = ("pca", "umap")


def with_clinical(rows: DataFrame, meta: DataFrame | None, key: str = "row_id") -> DataFrame:
    """Clinical columns in front of result rows; rows without metadata stay."""
    if meta is None:
        return rows
    extra = [c for c in meta.columns if c != key]
    return rows.join(meta, key, "left").select(key, *extra, *[c for c in rows.columns if c != key])


def reduce_dimensions(
    rows: DataFrame, features: Sequence[str], meta: DataFrame | None = None, methods: Sequence[str] = METHODS,
    n_neighbors: int = 15, min_dist: float = 0.1, seed: int = 42, epochs: int = rd.EPOCH_LIMIT,
) -> dict[str, DataFrame]:
    """Tables of the chosen methods for rows (row_id, features vector)."""
    methods = [m.lower() for m in methods]
    unknown = sorted(set(methods) - set(METHODS))
    if unknown:
        raise ValueError(f"unknown methods {unknown}; allowed: {list(METHODS)}")
    spark = rows.sparkSession
    out: dict[str, DataFrame] = {}
    planes = []
    if "pca" in methods:
        fit = rd.fit_components(rows, features)
        coords = rd.project(rows, fit)
        loadings = rd.loading_table(spark, fit)
        out["pca_explained_variance"] = rd.explained_variance(spark, fit)
        named = coords.select("row_id", *[
            F.get("coords", F.lit(i)).alias(f"PC{i + 1}") for i in range(min(rd.COMPONENTS_KEPT, len(fit.ratios)))])
        out["pca_embedding"] = with_clinical(named, meta)
        out["pca_loadings"] = loadings
        out["pca_biplot"] = rd.biplot_vectors(coords, loadings)
        planes.append(coords.select(F.lit("pca").alias("method"), "row_id", F.get("coords", F.lit(0)).alias("x"), F.get("coords", F.lit(1)).alias("y")))
    if "umap" in methods:
        pts = rows.select(F.col("row_id").alias("id"), vector_to_array("features").alias("vec"))
        near = staged(knn_exact(pts, n_neighbors), "neighbours")
        run = rd.layout(cut_lineage(fuzzy_weights(near, n_neighbors)), 2, min_dist, epochs, seed)
        emb = run.vectors
        flat = emb.select(F.col("id").alias("row_id"), F.get("vec", F.lit(0)).alias("UMAP1"), F.get("vec", F.lit(1)).alias("UMAP2"))
        out["umap_embedding"] = with_clinical(flat, meta)
        out["umap_run"] = spark.createDataFrame(
            [(run.epochs, epochs, run.movement, run.settled)], "epochs int, epoch_limit int, movement double, settled boolean")
        out["umap_trustworthiness"] = trustworthiness(pts, emb, n_neighbors, original=near)
        planes.append(flat.select(F.lit("umap").alias("method"), "row_id", F.col("UMAP1").alias("x"), F.col("UMAP2").alias("y")))
    combined = planes[0] if planes else None
    for p in planes[1:]:
        combined = combined.unionByName(p)
    if combined is not None:
        out["combined"] = combined
    return out
