"""Percentiles of counts by gene, time and cell type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.llm.percentiles import percentiles, value_counts
from chronocount.operators.counts import counts_long, one_row_per_cell, pack_by_cell, plain_label
from chronocount.session import cut, read

AT = (0.05, 0.25, 0.5, 0.75, 0.95)
GROUPS = ["gene_id", "time_h", "cell_type"]


def count_summary(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """``keys, gene_id, v, n``: all cells of ``cells`` that have a time, absent rows as 0; ``v`` = 0 may come in two rows.

    ``keys`` are of ``dataset``, ``load_day`` (of the cell), ``time_h`` and
    ``cell_type``. A missing type is the type 'unknown'. A cell in which a gene
    was not measured doesn't count for it.
    """
    cells = one_row_per_cell(read(spark, folder, "cells").select("cell_id", "dataset", "time_h", "cell_type", "load_ts")).filter("time_h is not null")
    group = cells.select(
        "cell_id", "dataset", F.to_date("load_ts").cast("string").alias("load_day"), "time_h", F.coalesce(plain_label("cell_type"), F.lit("unknown")).alias("cell_type")
    ).select("cell_id", *keys)
    # Cells are joined while a cell is one row; groups travel as numbers.
    number = F.xxhash64(*keys).alias("group")
    packed = pack_by_cell(read(spark, folder, "counts")).join(group.select("cell_id", number), "cell_id")
    seen = cut(counts_long(packed, "group").groupBy("group", "gene_id", "x").agg(F.count(F.lit(1)).alias("n")))
    n_cells = cut(group.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")).withColumn("group", number))
    # Zeros that have no row: all cells of a group less those with a row of the gene.
    panel = seen.agg(F.collect_set("gene_id").alias("panel"))  # one row
    grid = n_cells.join(F.broadcast(panel)).select("group", "n_cells", F.explode("panel").alias("gene_id"))
    with_row = seen.groupBy("group", "gene_id").agg(F.sum("n").alias("n_rows"))
    absent = grid.join(with_row, ["group", "gene_id"], "left").select("group", "gene_id", F.lit(0).cast("bigint").alias("x"), (F.col("n_cells") - F.coalesce("n_rows", F.lit(0))).alias("n"))
    all_ = seen.filter("x is not null").unionByName(absent.filter("n > 0"))
    return all_.join(n_cells.select("group", *keys), "group").select(*keys, "gene_id", F.col("x").cast("double").alias("v"), "n")


def p1_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles by gene, time and cell type over all datasets."""
    return percentiles(count_summary(spark, folder, ["time_h", "cell_type"]), GROUPS, AT, whole=True)


def p1_dataset_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Medians per dataset and gene, from the summaries of each of its times and types."""
    merged = value_counts(count_summary(spark, folder, ["dataset", "time_h", "cell_type"]), ["dataset", "gene_id"], "v", "n")
    return percentiles(merged, ["dataset", "gene_id"], (0.5,), whole=True)


def p1_day_medians(spark: SparkSession, folder: str) -> DataFrame:
    """Medians per gene, combined from the summaries of each load day of a cell."""
    merged = value_counts(count_summary(spark, folder, ["load_day"]), ["gene_id"], "v", "n")
    return percentiles(merged, ["gene_id"], (0.5,), whole=True)


_DENSE = """
WITH cell AS (
  SELECT cell_id, arg_min(dataset, load_ts) AS dataset, arg_min(time_h, load_ts) AS time_h,
         arg_min(coalesce(regexp_replace(lower(coalesce(cell_type, '')), '[^a-z0-9]', '', 'g'), ''), load_ts) AS label
  FROM cells GROUP BY cell_id),
one AS (SELECT cell_id, dataset, time_h, CASE WHEN label IN ('', 'unknown', 'na', 'nan', 'none', 'null') THEN 'unknown' ELSE label END AS cell_type FROM cell),
x AS (SELECT cell_id, gene_id, max(CASE WHEN x >= 0 AND x < 1000000 THEN x END) AS x FROM counts GROUP BY ALL),
dense AS (
  SELECT o.dataset, g.gene_id, o.time_h, o.cell_type, CASE WHEN x.cell_id IS NULL THEN 0 ELSE x.x END AS x
  FROM (SELECT cell_id, arg_min_null(time_h, load_ts) AS t FROM cells GROUP BY cell_id) k JOIN one o USING (cell_id)
  CROSS JOIN (SELECT DISTINCT gene_id FROM counts) g LEFT JOIN x ON x.cell_id = o.cell_id AND x.gene_id = g.gene_id
  WHERE k.t IS NOT NULL)
"""
_OVER = "SELECT {keys}, count(x) AS n, p, CAST(list_element(quantile_disc(x, [{at}]), CAST(i AS INT)) AS DOUBLE) AS value FROM dense, (SELECT unnest([{at}]) AS p, unnest([{index}]) AS i) GROUP BY {keys}, p, i HAVING count(x) > 0"


def _sql(keys: str, at: tuple[float, ...]) -> str:
    return _DENSE + _OVER.format(keys=keys, at=", ".join(f"CAST({p} AS DOUBLE)" for p in at), index=", ".join(str(i + 1) for i in range(len(at))))


QUERIES = {"p1_percentiles": p1_percentiles, "p1_dataset_medians": p1_dataset_medians, "p1_day_medians": p1_day_medians}
SQL = {
    "p1_percentiles": _sql("gene_id, time_h, cell_type", AT),
    "p1_dataset_medians": _sql("dataset, gene_id", (0.5,)),
    "p1_day_medians": _sql("gene_id", (0.5,)),
}
