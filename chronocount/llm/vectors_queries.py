"""Queries on similar vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.llm.vectors import expand_pairs, near_pairs, nearest, usable
from chronocount.session import read


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells within 0.5 of each other."""
    pairs, members = near_pairs(usable(read(spark, folder, "cells"), "cell_id", "x_pca_sig", 24), 24, 0.5)
    return expand_pairs(pairs, members).select(F.col("key_a").alias("cell_a"), F.col("key_b").alias("cell_b"))


def _nearest(spark: SparkSession, folder: str, vector: str, dim: int, functions: int) -> DataFrame:
    cells = usable(read(spark, folder, "cells"), "cell_id", vector, dim)
    return nearest(cells.filter("key % 50 = 0"), cells, dim, functions=functions).withColumnsRenamed({"key": "cell_id", "neighbour": "neighbour_id"})


def p3_nearest_pca(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of all cells, by ``x_pca_sig``, for the cells whose id divides by 50."""
    return _nearest(spark, folder, "x_pca_sig", 24, 8)


def p3_nearest_umap(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of all cells, by ``x_umap``, for the cells whose id divides by 50."""
    return _nearest(spark, folder, "x_umap", 2, 2)


QUERIES = {"p3_found": p3_found, "p3_nearest_pca": p3_nearest_pca, "p3_nearest_umap": p3_nearest_umap}
SQL = {
    "p3_found": """
WITH v AS (SELECT DISTINCT cell_id, CAST(x_pca_sig AS DOUBLE[]) AS v FROM cells WHERE len(x_pca_sig) = 24 AND len(list_filter(x_pca_sig, lambda x: isfinite(x))) = 24)
SELECT DISTINCT a.cell_id AS cell_a, b.cell_id AS cell_b FROM v a JOIN v b ON a.cell_id < b.cell_id AND list_distance(a.v, b.v) <= 0.5"""
}
