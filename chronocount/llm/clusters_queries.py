"""Queries on groups of cells with the same profile."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.llm.clusters import cluster_cells, describe, prevailing_labels
from chronocount.operators.counts import one_row_per_cell, pack_by_cell, plain_label
from chronocount.session import cut, read


def _clustered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    cells = one_row_per_cell(read(spark, folder, "cells").select("cell_id", "cell_type", "load_ts"))
    clustered = cluster_cells(cut(pack_by_cell(read(spark, folder, "counts"))))
    return cut(clustered), cells.select(F.col("cell_id").alias("key"), plain_label("cell_type").alias("label"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Cells whose type is missing or not the prevailing one of their cluster, with that type."""
    clustered, labels = _clustered(spark, folder)
    prevailing = prevailing_labels(clustered, labels).select("cluster", F.col("label").alias("cell_type"))
    return (
        clustered.join(labels, "key").join(prevailing, "cluster").filter(~F.col("label").eqNullSafe(F.col("cell_type")))
        .select(F.col("key").alias("cell_id"), "cell_type").distinct()
    )


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Every cluster with its size, most typical cells and prevailing type."""
    return describe(*_clustered(spark, folder))


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
SQL: dict[str, str] = {}
