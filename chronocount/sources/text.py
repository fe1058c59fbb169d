"""Readers of the domain's text files, and writers.

Each reader returns long rows with explicit types; a line that can't be read as
its type gives nulls in place of an error, and blank lines are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.operators.packed import split_packed


def scan_text_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id, cell_id, time_h, x`` of a tab-separated matrix (one file): first row times, other rows genes, first column the gene's number.

    Cells are numbered by their column from 1; the times' row is found by its
    place, not by its content. The file is read by lines, in as many tasks as it
    has parts; numbers of lines rise from part to part.
    """
    lines = spark.read.text(path).withColumn("row", F.monotonically_increasing_id()).filter(F.trim("value") != "")
    first = F.broadcast(lines.agg(F.min("row").alias("first")))
    cells = lines.join(first).select((F.col("row") == F.col("first")).alias("is_first"), F.split(F.regexp_replace("value", r"\r$", ""), "\t").alias("cells"))
    number = lambda v: v.try_cast("double")
    times = cells.filter("is_first").select(F.posexplode(F.transform("cells", number)).alias("cell_id", "time_h"))
    values = cells.filter("not is_first").select(number(F.col("cells")[0]).cast("int").alias("gene_id"), F.posexplode(F.transform("cells", number)).alias("cell_id", "x"))
    both = values.filter("cell_id > 0").join(times, "cell_id")
    return both.select("gene_id", F.col("cell_id").cast("bigint").alias("cell_id"), "time_h", F.col("x").cast("bigint").alias("x"))


def scan_gene_names(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id, gene_name`` of lines with a number, blanks or a tab, and a name."""
    line = F.regexp_extract_all("value", F.lit(r"^\s*(\d+)\s+(\S.*?)\s*$"), F.lit(1))
    name = F.regexp_extract("value", r"^\s*\d+\s+(\S.*?)\s*$", 1)
    return spark.read.text(path).filter(F.size(line) > 0).select(line[0].cast("int").alias("gene_id"), name.alias("gene_name"))


def scan_rates(spark: SparkSession, path: str) -> DataFrame:
    """``gene_id, d0, d1`` of two columns; the first line is the stimulus (gene 0) and is left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda s: F.trim(s) != "")).alias("gene_id", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    return lines.filter("gene_id > 0").select("gene_id", *[F.try_element_at(parts, F.lit(i)).try_cast("double").alias(f"d{i - 1}") for i in (1, 2)])


def scan_halflife(spark: SparkSession, path: str) -> DataFrame:
    """``gene_symbol, cell_line, prot_half_life, rna_half_life``."""
    return spark.read.csv(path, header=True, schema="gene_symbol string, cell_line string, prot_half_life double, rna_half_life double")


def scan_prior_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``src, tgt, w`` of a square matrix with names in the first row and column; |w|, since only the strength of a prior counts."""
    wide = spark.read.csv(path, header=True)
    label, *names = wide.columns
    return wide.select(F.col(f"`{label}`").alias("src"), F.explode(F.array(*[F.struct(F.lit(n).alias("tgt"), F.col(f"`{n}`").try_cast("double").alias("w")) for n in names])).alias("c")).select("src", "c.tgt", F.abs("c.w").alias("w"))


def scan_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """``gene``: one trimmed name a line."""
    return spark.read.text(path).select(F.trim("value").alias("gene")).filter("gene <> ''")


def scan_time_list(spark: SparkSession, path: str, from_zero: bool = True) -> DataFrame:
    """``time_h``: one number a line, with 0 put first if it isn't there."""
    times = spark.read.text(path).select(F.trim("value").try_cast("double").alias("time_h")).filter("time_h is not null")
    zero = spark.range(1).select(F.lit(0.0).alias("time_h"))
    return times.unionByName(zero).distinct() if from_zero else times.distinct()


def up_to_last(rows: DataFrame, times: DataFrame) -> DataFrame:
    """``rows`` whose time_h is not after the last of ``times``."""
    last = times.agg(F.max("time_h").alias("last"))
    return rows.join(F.broadcast(last)).filter(F.col("time_h") <= F.col("last")).drop("last")


def scan_perturbations(spark: SparkSession, path: str) -> DataFrame:
    """``combo_id, off, on``: names to knock out and to over-express by line of a tab-separated file with a header; lines without any are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("combo_id", "line")).filter("combo_id > 0")
    parts = F.split("line", "\t")
    side = lambda i: split_packed(F.try_element_at(parts, F.lit(i)))
    return lines.select("combo_id", side(1).alias("off"), side(2).alias("on")).filter("size(off) + size(on) > 0")


def sink_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet in ``folder``; what is there is replaced."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def sink_matrix(counts: DataFrame, folder: str) -> None:
    """Long counts, one folder per dataset."""
    counts.write.mode("overwrite").partitionBy("dataset").parquet(folder)


def sink_report(report: DataFrame, folder: str) -> None:
    """A report of a few rows as one CSV file with a header."""
    report.coalesce(1).write.mode("overwrite").csv(folder, header=True)
