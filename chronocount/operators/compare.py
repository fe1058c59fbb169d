"""Comparison of distributions; absent rows are zeros."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocount.operators.counts import gene_and_x, unpacked
from chronocount.operators.selection import seeded


def histogram(counts: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """``gene_id, by, x, n``: how many cells of each group have each count, zeros included; counts are summed before any window.

    Rows of ``cells`` with a null in ``by`` are left out.
    """
    labelled = cells.dropna(subset=by).select("cell_id", *by)
    seen = counts.filter("x > 0").join(labelled, "cell_id").groupBy("gene_id", *by, "x").agg(F.count(F.lit(1)).alias("n"))
    size = labelled.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    panel = counts.agg(F.collect_set("gene_id").alias("panel"))
    grid = size.join(F.broadcast(panel)).select(*by, "size", F.explode("panel").alias("gene_id"))
    some = seen.groupBy("gene_id", *by).agg(F.sum("n").alias("k"))
    zero = grid.join(some, ["gene_id", *by], "left").select("gene_id", *by, F.lit(0).cast("bigint").alias("x"), (F.col("size") - F.coalesce("k", F.lit(0))).alias("n"))
    return seen.unionByName(zero.filter("n > 0"))


def ks_two_sample(hist: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """``keys, ks``: largest distance of the two empirical distribution functions.

    ``side`` is true for rows of the first sample and false for those of the
    second; rows with a null side are left out. Keys with one sample only give no rows.
    """
    both = hist.withColumn("side", side).filter("side is not null").groupBy(*keys, "x").agg(
        F.sum(F.when(F.col("side"), F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("side"), F.col("n")).otherwise(0)).alias("b")
    )
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    na, nb = F.sum("a").over(whole), F.sum("b").over(whole)
    gap = F.abs(F.sum("a").over(upto) / F.nullif(na, F.lit(0)) - F.sum("b").over(upto) / F.nullif(nb, F.lit(0)))
    return both.withColumn("gap", gap).groupBy(*keys).agg(F.max("gap").alias("ks")).filter("ks is not null")


def ks_distance_matrix(hist: DataFrame) -> DataFrame:
    """``gene_id, time_h, ks``: distance between each time and the next, scaled by smallest step / step.

    ``hist`` is a histogram by time. A time counts for a gene's next step only,
    so a row enters at most two comparisons.
    """
    times = hist.select("time_h").distinct()
    step = F.lead("time_h").over(Window.orderBy("time_h"))
    steps = times.withColumn("next", step).filter("next is not null")
    least = steps.agg(F.min(F.col("next") - F.col("time_h")).alias("least"))
    first = hist.join(F.broadcast(steps), "time_h").select("gene_id", "time_h", "x", "n", F.lit(True).alias("first"))
    second = hist.withColumnRenamed("time_h", "at").join(F.broadcast(steps), F.col("at") == F.col("next")).select("gene_id", "time_h", "x", "n", F.lit(False).alias("first"))
    ks = ks_two_sample(first.unionByName(second), ["gene_id", "time_h"], F.col("first"))
    return ks.join(F.broadcast(steps), "time_h").join(F.broadcast(least)).select("gene_id", "time_h", (F.col("ks") * F.col("least") / (F.col("next") - F.col("time_h"))).alias("ks"))


def transport_cost(hist: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """``keys, cost``: the least cost of moving one sample's counts to the other's, at the squared distance for each unit of weight.

    In one dimension both are moved in order: at every part of the weight at
    which either distribution steps, its next value is known. Steps are kept as
    whole numbers, counts of one side times the size of the other. Keys with one
    sample only give no rows, rows with a null side are left out.
    """
    both = hist.withColumn("side", side).filter("side is not null").groupBy(*keys, "side", "x").agg(F.sum("n").cast("decimal(38,0)").alias("n")).filter("n > 0")
    size = both.groupBy(*keys).agg(F.sum(F.when(F.col("side"), F.col("n"))).alias("na"), F.sum(F.when(~F.col("side"), F.col("n"))).alias("nb")).filter("na is not null and nb is not null")
    upto = F.sum("n").over(Window.partitionBy(*keys, "side").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    steps = both.withColumn("upto", upto).join(size, keys).select(
        *keys, (F.col("upto") * F.when(F.col("side"), F.col("nb")).otherwise(F.col("na"))).cast("double").alias("u"), (F.col("na") * F.col("nb")).cast("double").alias("whole"),
        F.when(F.col("side"), F.col("x").cast("double")).alias("a"), F.when(~F.col("side"), F.col("x").cast("double")).alias("b"),
    )
    one = steps.groupBy(*keys, "u").agg(F.max("whole").alias("whole"), F.max("a").alias("a"), F.max("b").alias("b"))
    order = Window.partitionBy(*keys).orderBy("u")
    following = order.rowsBetween(0, Window.unboundedFollowing)
    at = one.select(*keys, "whole", (F.col("u") - F.coalesce(F.lag("u").over(order), F.lit(0.0))).alias("w"), F.first("a", ignorenulls=True).over(following).alias("a"), F.first("b", ignorenulls=True).over(following).alias("b"))
    return at.groupBy(*keys).agg(F.sum(F.col("w") / F.col("whole") * (F.col("a") - F.col("b")) ** 2).alias("cost"))


def pearson_matrix(packed: DataFrame, panel: list[int], n: int) -> DataFrame:
    """``gene_a, gene_b, r`` (a < b) of the genes of ``panel`` over ``n`` cells; null where a gene is constant.

    ``packed`` is of ``pack_by_cell``: cells without rows are zeros. Each task
    sums the products of all its cells, so what leaves it is the panel squared,
    whatever the number of cells.
    """
    genes = np.array(sorted(panel))
    width = len(genes)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width))
        for b in batches:
            for part in (b[i : i + 4096] for i in range(0, len(b), 4096)):
                _, code = unpacked(part)
                gene, x = gene_and_x(code)
                m = np.zeros((len(part), width))
                at = np.minimum(np.searchsorted(genes, gene), max(width - 1, 0))
                known = genes[at] == gene if width else np.zeros(0, bool)
                m[np.repeat(np.arange(len(part)), part["codes"].str.len())[known], at[known]] = np.maximum(x[known], 0)
                total[:width] += m.T @ m
                total[width] += m.sum(axis=0)
        yield pd.DataFrame({"i": np.arange(width + 1, dtype=np.int32), "s": list(total)})

    spark = packed.sparkSession
    if not width:
        return spark.createDataFrame([], "gene_a int, gene_b int, r double")
    whole = F.array(*[F.sum(F.col("s")[j]) for j in range(width)]).alias("s")
    # Rows of the matrix, each with the sums and its own place.
    rows = packed.mapInPandas(sums, "i int, s array<double>").groupBy("i").agg(whole)
    names = F.array(*[F.lit(int(g)) for g in genes])
    last = rows.filter(F.col("i") == width).select(F.col("s").alias("sum"))
    own = rows.filter(F.col("i") < width).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.get("s", "i").alias("q")))), lambda t: t["q"]).alias("q"))
    pair = rows.filter(F.col("i") < width).join(F.broadcast(last)).join(F.broadcast(own)).select("i", "sum", "q", F.posexplode("s").alias("j", "p")).filter("i < j")
    cov = F.col("p") - F.get("sum", "i") * F.get("sum", "j") / n
    var = lambda i: F.get("q", i) - F.get("sum", i) ** 2 / n
    spread = F.sqrt(F.greatest(var("i") * var("j"), F.lit(0.0)))
    return pair.select(F.get(names, "i").alias("gene_a"), F.get(names, "j").alias("gene_b"), F.when(spread > 1e-9, cov / spread).alias("r"))


def mean_sd_by_time(hist: DataFrame) -> DataFrame:
    """``gene_id, time_h, mean, sd`` (population) from a histogram by time."""
    n, x = F.sum("n"), F.col("x").cast("double")
    mean = F.sum(x * F.col("n")) / n
    return hist.groupBy("gene_id", "time_h").agg(mean.alias("mean"), F.sqrt(F.greatest(F.sum(x * x * F.col("n")) / n - mean * mean, F.lit(0.0))).alias("sd"))


def top_variable_genes(by_time: DataFrame, n: int = 10) -> DataFrame:
    """``gene_id, spread``: the genes with the highest population variance of their means over time; ties by gene."""
    spread = by_time.groupBy("gene_id").agg(F.round(F.var_pop("mean"), 9).alias("spread"))
    return spread.orderBy(F.col("spread").desc(), "gene_id").limit(n)


def proportions(cells: DataFrame, group: str, label: str) -> DataFrame:
    """``group, label, percent``: share of each label in a group, 0 where it has none; null groups and labels are left out."""
    n = cells.dropna(subset=[group, label]).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    labels = n.agg(F.array_sort(F.collect_set(label)).alias("labels"))
    total = n.groupBy(group).agg(F.sum("n").alias("total"))
    grid = total.join(F.broadcast(labels)).select(group, "total", F.explode("labels").alias(label))
    return grid.join(n, [group, label], "left").select(group, label, (100 * F.coalesce("n", F.lit(0)) / F.col("total")).alias("percent"))


def zscore_signature(counts: DataFrame, cells: DataFrame, moments: DataFrame, genes: DataFrame) -> DataFrame:
    """``cell_id, score``: mean over ``genes`` of (x - mean) / sd. Constant genes are left out; without any other the score is null."""
    m = moments.join(genes.select("gene_id"), "gene_id", "left_semi").filter("var > 1e-12").withColumn("sd", F.sqrt("var"))
    at_zero = m.agg(F.sum(-F.col("mean") / F.col("sd")).alias("zero"), F.count(F.lit(1)).alias("k"))
    add = counts.join(m, "gene_id").groupBy("cell_id").agg(F.sum(F.col("x") / F.col("sd")).alias("up"))
    return cells.select("cell_id").join(add, "cell_id", "left").join(F.broadcast(at_zero)).select("cell_id", ((F.coalesce("up", F.lit(0.0)) + F.col("zero")) / F.nullif("k", F.lit(0))).alias("score"))


def histogram_density(hist: DataFrame, keys: list[str], bins: int = 25) -> DataFrame:
    """``keys, bin, density``: counts in equal bins from 0 to the largest value of a key, per value and unit of width. Keys whose values are all 0 are left out."""
    whole = Window.partitionBy(*keys)
    top = hist.withColumn("top", F.max("x").over(whole)).withColumn("total", F.sum("n").over(whole)).filter("top > 0")
    at = F.least(F.floor(F.col("x") * bins / F.col("top")), F.lit(bins - 1)).cast("int")
    return top.groupBy(*keys, at.alias("bin")).agg((F.sum("n") / (F.first("total") * F.first("top") / bins)).alias("density"))


def dominant_label(scores: DataFrame, key: str, label: str, score: str) -> DataFrame:
    """``key, label``: the label with the highest score of each key; ties go to the first label."""
    order = Window.partitionBy(key).orderBy(F.col(score).desc(), label)
    return scores.filter(F.col(score).isNotNull()).withColumn("r", F.row_number().over(order)).filter("r = 1").select(key, label)


def weighted_cosine(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``cosine``: mean cosine of two array columns, weighted by the product of their norms (which is the sum of products over that of norms)."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, t: s + t))
    return pairs.agg((F.sum(dot) / F.sum(norm(a) * norm(b))).alias("cosine"))


def evenly_spaced(rows: DataFrame, time: str, most: int = 10) -> DataFrame:
    """``rows`` of at most ``most`` of the different times, first and last among them, at even steps of their order; null times are left out."""
    times = rows.select(time).dropna().distinct()
    n = F.count(F.lit(1)).over(Window.partitionBy())
    place = times.withColumn("_i", F.row_number().over(Window.orderBy(time)) - 1).withColumn("_n", n)
    # The k-th of them lies at the nearest place to k (n - 1) / (most - 1), halves going to the even one.
    kept = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / F.lit(max(most - 1, 1)), 0).cast("int"))
    chosen = place.filter((F.col("_n") <= most) | F.array_contains(kept, F.col("_i"))).select(time)
    return rows.join(F.broadcast(chosen), time, "left_semi")


def partial_corr_sign(pearson: DataFrame, panel: list[int]) -> DataFrame:
    """``gene_a, gene_b, sign`` (a < b) of the partial correlation of two genes given all others, from ``pearson_matrix`` (gene_a, gene_b, r).

    The panel squared comes to the driver, whatever the number of cells. The
    inverse is the pseudo-inverse; a gene without a correlation has sign 0.
    """
    at = {g: i for i, g in enumerate(sorted(panel))}
    m = np.eye(len(at))
    for r in pearson.filter("r is not null").collect():
        m[at[r["gene_a"]], at[r["gene_b"]]] = m[at[r["gene_b"]], at[r["gene_a"]]] = r["r"]
    inverse = -np.linalg.pinv(m, hermitian=True) if len(at) else m
    names = sorted(panel)
    rows = [(a, b, int(np.sign(np.round(inverse[i, j], 9)))) for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    return pearson.sparkSession.createDataFrame(rows, "gene_a int, gene_b int, sign int")


def principal_components(packed: DataFrame, panel: list[int], k: int) -> DataFrame:
    """``cell_id, pc``: the first ``k`` principal components of log1p counts of packed cells over ``panel``, each with the sign that makes its largest loading positive.

    Fewer genes give fewer components; without cells there are no rows.
    """
    genes, k = np.array(sorted(panel)), min(k, len(panel))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, code = unpacked(b)
            gene, x = gene_and_x(code)
            m = np.zeros((len(b), len(genes)))
            at = np.minimum(np.searchsorted(genes, gene), max(len(genes) - 1, 0))
            known = genes[at] == gene
            m[np.repeat(np.arange(len(b)), b["codes"].str.len())[known], at[known]] = np.maximum(x[known], 0)
            yield pd.DataFrame({"cell_id": b["cell_id"], "x": list(np.log1p(m))})

    dense = packed.mapInPandas(rows, "cell_id bigint, x array<double>").select("cell_id", array_to_vector("x").alias("x"))
    if not k or dense.isEmpty():
        return packed.sparkSession.createDataFrame([], "cell_id bigint, pc array<double>")
    model = PCA(k=k, inputCol="x", outputCol="pc").fit(dense)
    load = model.pc.toArray()
    sign = np.sign(load[np.abs(load).argmax(axis=0), np.arange(k)])
    turned = F.zip_with(vector_to_array("pc"), F.array(*[F.lit(float(v)) for v in sign]), lambda a, b: a * b)
    return model.transform(dense).select("cell_id", turned.alias("pc"))


def signature_score(counts: DataFrame, cells: DataFrame, moments: DataFrame, genes: DataFrame, bins: int = 25, controls: int = 50, seed: int = 0) -> DataFrame:
    """``cell_id, score``: mean count of the signature ``genes`` less that of control genes of the same level of expression.

    Genes are ranked by mean (ties by number) into ``bins`` equal bins; each bin
    that holds a signature gene gives its first ``controls`` other genes by
    seeded hash. Absent counts are zeros; genes without moments don't count, and
    without any signature or control gene that mean is 0.
    """
    binned = moments.select("gene_id", F.ntile(bins).over(Window.orderBy(F.round("mean", 9), "gene_id")).alias("bin"))  # a row for each gene
    own = binned.join(genes.select("gene_id").distinct(), "gene_id", "left_semi")
    order = Window.partitionBy("bin").orderBy(seeded("gene_id", seed), "gene_id")
    other = binned.join(own.select("gene_id"), "gene_id", "left_anti").join(own.select("bin").distinct(), "bin", "left_semi").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= controls)
    sides = own.select("gene_id", F.lit(True).alias("own")).unionByName(other.select("gene_id", F.lit(False).alias("own")))
    size = sides.agg(F.sum(F.col("own").cast("int")).alias("n_own"), F.sum((~F.col("own")).cast("int")).alias("n_other"))
    sums = counts.join(sides, "gene_id").groupBy("cell_id").agg(F.sum(F.when(F.col("own"), F.col("x"))).alias("a"), F.sum(F.when(~F.col("own"), F.col("x"))).alias("b"))
    mean = lambda s, n: F.coalesce(F.coalesce(F.col(s), F.lit(0)) / F.nullif(F.col(n), F.lit(0)), F.lit(0.0))
    return cells.select("cell_id").join(sums, "cell_id", "left").join(F.broadcast(size)).select("cell_id", (mean("a", "n_own") - mean("b", "n_other")).alias("score"))
