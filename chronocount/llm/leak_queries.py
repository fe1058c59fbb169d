"""Queries on leaked evaluation passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.llm.leak import leaks
from chronocount.session import read


def _leaks(spark: SparkSession, folder: str, min_share: float) -> DataFrame:
    docs, items = read(spark, folder, "documents"), read(spark, folder, "eval_items")
    return leaks(docs, "doc_id", "text", items, "item_id", "item_text", min_share)


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold at least half of an item."""
    return _leaks(spark, folder, 0.5).select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, folder: str) -> DataFrame:
    """Items of which a document holds a fifth, changed words allowed: the number of documents with half of it as it stands, and its largest shares in one."""
    docs, items = read(spark, folder, "documents"), read(spark, folder, "eval_items")
    found = leaks(docs, "doc_id", "text", items, "item_id", "item_text", 0.2, changed_words=True)
    exact = F.col("n_covered") / F.col("n_words")
    return found.groupBy("item_id").agg(
        F.sum((exact >= 0.5).cast("bigint")).alias("n_docs"), F.max(exact).alias("largest_share"), F.max("share").alias("largest_share_changed")
    )


QUERIES = {"p6_found": p6_found, "p6_items": p6_items}
SQL: dict[str, str] = {}
