"""Moments of genes and depth factors of cells; absent rows are zeros."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronocount.operators.selection import quantiles
from chronocount.session import cut


def gene_moments(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """``gene_id, n_cells, mean, var``: mean and population variance over all cells; a gene without rows has none."""
    n = cells.agg(F.count(F.lit(1)).alias("n_cells"))
    sums = counts.groupBy("gene_id").agg(F.sum("x").alias("s"), F.sum(F.col("x").cast("double") * F.col("x")).alias("q"))
    mean = F.col("s") / F.col("n_cells")
    return sums.join(F.broadcast(n)).select("gene_id", "n_cells", mean.alias("mean"), (F.col("q") / F.col("n_cells") - mean * mean).alias("var"))


def cv2_read_depth(counts: DataFrame, cells: DataFrame, min_mean: float = 0.1, genes: DataFrame | None = None) -> DataFrame:
    """``n_genes, cv2``: mean off-diagonal relative covariance of the genes with a mean above ``min_mean``; 0 for fewer than two genes, never negative.

    The sum over all pairs of genes is the variance of one number per cell, so
    no gene-by-gene matrix is made: with z the sum of x/mean over genes, the
    off-diagonal sum is var(z) less the sum of the genes' own var/mean^2.
    """
    m = gene_moments(counts, cells).filter(F.col("mean") > min_mean)
    if genes is not None:
        m = m.join(genes.select("gene_id"), "gene_id", "left_semi")
    own = m.agg(
        F.count(F.lit(1)).alias("n_genes"), F.max("n_cells").alias("n"),
        F.sum(F.col("var") / (F.col("mean") * F.col("mean"))).alias("diagonal"),
    )
    z = counts.join(m.select("gene_id", "mean"), "gene_id").groupBy("cell_id").agg(F.sum(F.col("x") / F.col("mean")).alias("z"))
    total = z.agg(F.coalesce(F.sum("z"), F.lit(0.0)).alias("sz"), F.coalesce(F.sum(F.col("z") * F.col("z")), F.lit(0.0)).alias("qz"))
    n, p = F.col("n"), F.col("n_genes")
    all_pairs = (F.col("qz") - F.col("sz") * F.col("sz") / n) / (n - 1)
    xi = (all_pairs - F.col("diagonal") * n / (n - 1)) / (p * (p - 1))
    return own.join(total).select("n_genes", F.when((p < 2) | (n < 2), F.lit(0.0)).otherwise(F.greatest(xi, F.lit(0.0))).alias("cv2"))


def poisson_genes(counts: DataFrame, cells: DataFrame, min_mean: float = 0.1, var_threshold: float = 1.2, rounds: int = 10) -> DataFrame:
    """``gene_id, mean``: genes whose variance depth alone explains: var / (mean + cv2 * mean^2) below the threshold.

    The relative covariance is made again over the genes kept, until nothing
    changes. Fewer than five genes: all with a mean above ``min_mean``.
    """
    m = cut(gene_moments(counts, cells).filter(F.col("mean") > min_mean))
    kept = m
    for _ in range(rounds):
        xi = cv2_read_depth(counts, cells, min_mean, kept).first()["cv2"]
        ratio = F.col("var") / (F.col("mean") + F.lit(xi) * F.col("mean") * F.col("mean"))
        now = cut(m.filter(ratio < var_threshold))
        if now.count() < 5:
            return m.select("gene_id", "mean")
        same = kept.join(now, "gene_id", "left_anti").isEmpty() and now.join(kept, "gene_id", "left_anti").isEmpty()
        kept = now
        if same:
            break
    return kept.select("gene_id", "mean")


def read_depth(counts: DataFrame, cells: DataFrame, genes: DataFrame, low: float = 0.2, high: float = 5.0) -> DataFrame:
    """``cell_id, rd``: mean count over ``genes`` against the overall mean, clipped, then divided by its mean. Without any count all are 1."""
    own = counts.join(genes.select("gene_id"), "gene_id", "left_semi").groupBy("cell_id").agg(F.sum("x").alias("s"))
    raw = cells.select("cell_id").join(own, "cell_id", "left").withColumn("s", F.coalesce("s", F.lit(0)).cast("double"))
    clip = lambda mean: F.least(F.greatest(F.col("s") / mean, F.lit(low)), F.lit(high))
    mean = raw.agg(F.avg("s").alias("m"))
    clipped = raw.join(F.broadcast(mean)).select("cell_id", F.when(F.col("m") > 0, clip(F.col("m"))).otherwise(F.lit(1.0)).alias("r"))
    again = clipped.agg(F.avg("r").alias("m"))
    return clipped.join(F.broadcast(again)).select("cell_id", (F.col("r") / F.col("m")).alias("rd"))


def normalised_rd(cells: DataFrame, by: str = "median") -> DataFrame:
    """``cell_id, rd`` divided by the median or mean of all depth factors; null factors stay null."""
    centre = quantiles(cells, "rd", [0.5])[0] if by == "median" else cells.agg(F.avg("rd")).first()[0]
    return cells.withColumn("c", F.lit(centre).cast("double")).select("cell_id", (F.col("rd") / (F.col("c") + 1e-16)).alias("rd"))


def depth_corrected(counts: DataFrame, rd: DataFrame) -> DataFrame:
    """``cell_id, gene_id, x``: counts over depth, rounded half to even. A cell without a positive factor keeps its counts."""
    factor = F.when(F.col("rd") > 0, F.col("rd")).otherwise(F.lit(1.0))
    return counts.join(rd.select("cell_id", "rd"), "cell_id", "left").select("cell_id", "gene_id", F.bround(F.col("x") / factor).cast("bigint").alias("x"))


def log_normalised(counts: DataFrame, scale: float = 1e4) -> DataFrame:
    """``cell_id, gene_id, y``: log1p of a cell's counts brought to one total. Cells that sum to 0 give no rows."""
    total = F.sum("x").over(Window.partitionBy("cell_id"))
    return counts.withColumn("t", total).filter("t > 0").select("cell_id", "gene_id", F.log1p(F.col("x") / F.col("t") * scale).alias("y"))
