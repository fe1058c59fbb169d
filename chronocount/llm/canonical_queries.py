"""Queries on free-entered gene names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.llm.canonical import match_names
from chronocount.session import read

#: Table by table, the column of typed names.
TYPED = {"gene_list": "gene", "var_names": "var_name", "ref_network": "index_name"}


def _typed(spark: SparkSession, folder: str) -> DataFrame:
    """``tab, entry_id, value`` of every typed name that isn't a gene's exact name."""
    parts = [read(spark, folder, t).select(F.lit(t).alias("tab"), "entry_id", F.col(c).alias("value")) for t, c in TYPED.items()]
    names = read(spark, folder, "genes").select(F.col("gene_name").alias("value"))
    return reduce(DataFrame.unionByName, parts).join(names, "value", "left_anti")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The gene that a reader sees in each typed name, or -1."""
    typed = _typed(spark, folder)
    matched = match_names(typed, read(spark, folder, "genes"), "gene_id", "gene_name")
    return typed.join(matched, "value").select("tab", "entry_id", F.coalesce("ref_id", F.lit(-1)).cast("int").alias("gene_id")).distinct()


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Values in which no gene is seen, with how often they come."""
    typed = _typed(spark, folder)
    matched = match_names(typed, read(spark, folder, "genes"), "gene_id", "gene_name").filter("ref_id is null")
    return typed.join(matched, "value").groupBy("value").agg(F.count(F.lit(1)).alias("n_entries"))


QUERIES = {"p4_found": p4_found, "p4_unmatched": p4_unmatched}
SQL: dict[str, str] = {}
