"""Scores of inferred networks and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _cumulated(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """True and false positives down to each distinct score; ties are one point. Counts are summed per score first."""
    per = scored.groupBy(F.abs(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count(F.lit(1)).alias("n"))
    down = Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    return per.select("s", F.sum("p").over(down).alias("tp"), (F.sum("n").over(down) - F.sum("p").over(down)).alias("fp"), F.sum("p").over(whole).alias("all_p"), (F.sum("n").over(whole) - F.sum("p").over(whole)).alias("all_n"))


def roc(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """``s, fpr, tpr`` at each distinct |score|, falling; a rate without cases is null."""
    c = _cumulated(scored, score, truth)
    return c.select("s", (F.col("fp") / F.nullif("all_n", F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif("all_p", F.lit(0))).alias("tpr"))


def auroc(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """``auroc``: trapezoid area from (0, 0)."""
    down = Window.orderBy(F.col("s").desc())
    c = roc(scored, score, truth).withColumn("x0", F.coalesce(F.lag("fpr").over(down), F.lit(0.0))).withColumn("y0", F.coalesce(F.lag("tpr").over(down), F.lit(0.0)))
    return c.agg(F.sum((F.col("fpr") - F.col("x0")) * (F.col("tpr") + F.col("y0")) / 2).alias("auroc"))


def pr(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """``s, recall, precision`` at each distinct |score|, falling."""
    c = _cumulated(scored, score, truth)
    return c.select("s", (F.col("tp") / F.nullif("all_p", F.lit(0))).alias("recall"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def aupr(scored: DataFrame, score: str, truth: str) -> DataFrame:
    """``aupr``: trapezoid area from the end point recall 0, precision 1."""
    down = Window.orderBy(F.col("s").desc())
    c = pr(scored, score, truth).withColumn("x0", F.coalesce(F.lag("recall").over(down), F.lit(0.0))).withColumn("y0", F.coalesce(F.lag("precision").over(down), F.lit(1.0)))
    return c.agg(F.sum((F.col("recall") - F.col("x0")) * (F.col("precision") + F.col("y0")) / 2).alias("aupr"))


def undirected(scored: DataFrame) -> DataFrame:
    """``a, b, score, truth`` (a < b): the larger |score| of both directions, true if one is."""
    return scored.filter("src <> tgt").groupBy(F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")).agg(F.max(F.abs("score")).alias("score"), F.max("truth").alias("truth"))


def random_baseline(scored: DataFrame, truth: str) -> DataFrame:
    """``share`` of true edges, the precision of a random ranking."""
    return scored.agg(F.avg(F.col(truth).cast("double")).alias("share"))


def link_list(scored: DataFrame, most: int | None = None) -> DataFrame:
    """``src, tgt, score, rank``: edges to others by falling score, ties by source and target; at most ``most``."""
    links = scored.filter("src <> tgt").withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "src", "tgt")))
    return links.filter(F.col("rank") <= most) if most else links


def padded_curves(curves: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """``step, mean, se``: curves of different lengths, each carried on by its last value to the end of the longest, then mean and standard error over keys."""
    longest = curves.agg(F.max(step).alias("_last")).filter("_last is not null")
    keys = curves.select(key).distinct().join(F.broadcast(longest)).select(key, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias(step))
    carried = F.last(value, ignorenulls=True).over(Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    full = keys.join(curves.select(key, step, value), [key, step], "left").withColumn("v", carried).filter("v is not null")
    return full.groupBy(step).agg(F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count(F.lit(1)))).alias("se"))


def coupling_metric(coupling: DataFrame, state: DataFrame, truth: DataFrame, width: int) -> DataFrame:
    """``metric``: mean over sources of the weighted squared distance of log1p states between coupled targets and the true one.

    ``coupling`` has src, dst, w; ``state`` cell, x (array); ``truth`` src, x (array).
    """
    gap = F.aggregate(F.zip_with("x", "y", lambda a, b: F.pow(F.log1p(a) - F.log1p(b), F.lit(2.0))), F.lit(0.0), lambda s, d: s + d) / width
    one = coupling.join(state.select(F.col("cell").alias("dst"), "x"), "dst").join(truth.select("src", F.col("x").alias("y")), "src")
    per = one.groupBy("src").agg((F.sum(F.col("w") * gap) / F.sum("w")).alias("d"))
    return per.agg(F.avg("d").alias("metric"))
