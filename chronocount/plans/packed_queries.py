"""Queries on packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.operators.packed import NAME_DELIMITERS, REFERENCE_DELIMITERS, explode_packed
from chronocount.session import read


def packed_items(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of ``ko``, ``ov`` and ``refs``, single ones too."""
    genes = explode_packed(read(spark, folder, "ko_ov_list"), "combo_id", {"ko": NAME_DELIMITERS, "ov": NAME_DELIMITERS})
    refs = explode_packed(read(spark, folder, "neko_edges"), "edge_id", {"refs": REFERENCE_DELIMITERS})
    return genes.unionByName(refs)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Values of fields that hold two or more."""
    return packed_items(spark, folder).filter("n_items >= 2").select("field_name", "row_key", "pos", "item").distinct()


def p5_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Fields by the number of values they hold."""
    return (
        packed_items(spark, folder)
        .filter("pos = 1")
        .groupBy("field_name", "n_items")
        .agg(F.count(F.lit(1)).alias("n_fields"))
        .withColumn("n_items", F.col("n_items").cast("bigint"))
    )


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}
SQL: dict[str, str] = {}
