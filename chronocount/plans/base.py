"""The tables as the queries of the core see them, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.operators.counts import ABSURD, one_row_per_cell, plain_label
from chronocount.session import read


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """``cell_id, dataset, time_h, sample_id, cell_type, rd``: each cell once, labels made plain."""
    few = read(spark, folder, "cells").select("cell_id", "dataset", "time_h", "sample_id", "cell_type", "rd", "load_ts")
    return one_row_per_cell(few).withColumn("cell_type", plain_label("cell_type")).drop("load_ts")


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """``cell_id, gene_id, x``: valid counts of the cells of ``cells``, each (cell, gene) once."""
    valid = read(spark, folder, "counts").select("cell_id", "gene_id", "x").filter((F.col("x") >= 0) & (F.col("x") < ABSURD) & F.col("cell_id").isNotNull())
    # One shuffle by cell serves the grouping by (cell, gene) and every later join on cells.
    one = valid.repartition("cell_id").groupBy("cell_id", "gene_id").agg(F.max("x").alias("x"))
    return one.join(read(spark, folder, "cells").select("cell_id").distinct(), "cell_id", "left_semi")


def genes(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "genes")


SQL = """
WITH cell AS (
  SELECT cell_id, s.dataset AS dataset, s.time_h AS time_h, s.sample_id AS sample_id, s.rd AS rd,
    CASE WHEN regexp_replace(lower(coalesce(s.cell_type, '')), '[^\\p{L}\\p{N}]', '', 'g') NOT IN
      ('', 'unknown', 'na', 'nan', 'none', 'null', 'unassigned', 'undefined', 'undetermined', 'nd', 'tbd', 'missing', 'other')
      THEN regexp_replace(lower(s.cell_type), '[^\\p{L}\\p{N}]', '', 'g') END AS cell_type
  FROM (SELECT cell_id, arg_min({'dataset': dataset, 'time_h': time_h, 'sample_id': sample_id, 'cell_type': cell_type, 'rd': rd}, load_ts) AS s
        FROM cells WHERE cell_id IS NOT NULL GROUP BY cell_id)),
x AS (
  SELECT cell_id, gene_id, max(x) AS x FROM counts
  WHERE x >= 0 AND x < 1000000 AND cell_id IN (SELECT cell_id FROM cells) GROUP BY cell_id, gene_id)
"""


def registrar(before: str):
    """Queries by name, their SQL by name, and the decorator that registers a query with SQL that continues the expressions ``before`` it."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text if text.startswith("WITH") else before + text
            return f

        return add

    return queries, sql, query
