"""Queries on texts that look the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.llm.lookalike import look_alike_classes, look_alike_pairs, text_forms
from chronocount.session import cut, read


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents that a reader sees as the same and that are not equal."""
    classes = cut(look_alike_classes(cut(text_forms(read(spark, folder, "documents"), "doc_id", "text"))))
    return look_alike_pairs(classes).select(F.col("row_a").alias("doc_a"), F.col("row_b").alias("doc_b")).distinct()


def p8_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The common form of every document, with the class it falls into."""
    forms = text_forms(read(spark, folder, "documents"), "doc_id", "text", with_form=True)
    return forms.select(F.col("row_key").alias("doc_id"), F.hex(F.xxhash64("form_key", "seen_key")).alias("class_key"), "form", "n_chars")


QUERIES = {"p8_found": p8_found, "p8_forms": p8_forms}
SQL: dict[str, str] = {}
