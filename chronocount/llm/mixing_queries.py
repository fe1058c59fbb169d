"""Queries on mixing sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.llm.mixing import mix_plan, mixed_documents, reached_shares, token_sizes
from chronocount.session import cut, read


def _plan(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sizes = token_sizes(read(spark, folder, "documents"), "doc_id", "text", "source")
    return sizes, mix_plan(sizes, read(spark, folder, "mix_targets"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that can't reach their share."""
    return _plan(spark, folder)[1].filter(~F.col("reachable")).select("source").distinct()


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mix reaches."""
    return reached_shares(_plan(spark, folder)[1])


def p7_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the mix with the number of its copies."""
    sizes = cut(token_sizes(read(spark, folder, "documents"), "doc_id", "text", "source"))
    plan = cut(mix_plan(sizes, read(spark, folder, "mix_targets")))
    return mixed_documents(sizes, plan).withColumnRenamed("doc_key", "doc_id")


QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares, "p7_documents": p7_documents}
# Any usual measure of size gives the same sources; SQL has characters.
SQL = {
    "p7_found": """
WITH t AS (SELECT source, max(target_share) AS share, max(max_repeats) AS cap FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
o AS (SELECT source, sum(length(text)) AS own FROM documents GROUP BY source)
SELECT source FROM t LEFT JOIN o USING (source) WHERE cap * coalesce(own, 0) < share * (SELECT sum(own) FROM o JOIN t USING (source))"""
}
