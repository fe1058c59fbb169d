"""Queries on negative-binomial mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.functions import nb
from chronocount.operators import compare, depth, mixture, selection
from chronocount.plans import base
from chronocount.plans.compare_queries import _BY_TIME
from chronocount.plans.counts_queries import _MOMENTS, rounded
from chronocount.session import cut



QUERIES, SQL, query = base.registrar(base.SQL)


_FIT = _MOMENTS + """, f0 AS (SELECT gene_id, mean, CASE WHEN mean <= 0 THEN 1 WHEN var <= mean + 1e-8 THEN greatest(50, mean) ELSE greatest(1e-3, mean * mean / nullif(var - mean, 0)) END AS k FROM m),
fit AS (SELECT gene_id, k, CASE WHEN mean <= 0 THEN 1 ELSE greatest(1e-6, k / nullif(mean, 0)) END AS c FROM f0),
md AS (SELECT gene_id, 0 AS mode, 0.8 * k AS k, c FROM fit UNION ALL SELECT gene_id, 1, 1.2 * k, c FROM fit) """
_HX = _FIT + """, sz AS (SELECT count(*) AS size FROM cell), sn AS (SELECT gene_id, x, count(*) AS n FROM x WHERE x > 0 GROUP BY ALL),
hx AS (SELECT * FROM sn UNION ALL SELECT gene_id, 0, (SELECT size FROM sz) - coalesce(sum(n) FILTER (x > 0), 0) FROM (SELECT gene_id, 0 AS x, 0 AS n FROM x UNION ALL SELECT * FROM sn) GROUP BY gene_id),
lp AS (SELECT gene_id, x, n, mode, lgamma(x + kk) - lgamma(kk) - lgamma(x + 1.0) + kk * ln(c) - (x + kk) * ln(1 + c) AS l FROM (SELECT hx.*, mode, least(greatest(k, 1e-8), 1e5) AS kk, c FROM hx JOIN md USING (gene_id)) WHERE n > 0),
jt AS (SELECT *, l + ln(0.5) AS joint, max(l + ln(0.5)) OVER (PARTITION BY gene_id, x) AS top FROM lp) """


def _all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Histogram over all cells, moment fit and two initial modes."""
    counts, cells = base.counts(spark, folder), base.cells(spark, folder).withColumn("all", F.lit(0))
    # Cut once: moments follow from it too.
    hist = cut(compare.histogram(counts, cells, ["all"]).select("gene_id", "x", "n"))
    n, x = F.sum("n"), F.col("x").cast("double")
    mean = F.sum(x * F.col("n")) / n
    fit = mixture.moment_fit(hist.groupBy("gene_id").agg(mean.alias("mean"), (F.sum(x * x * F.col("n")) / n - mean * mean).alias("var")))
    return hist, fit, mixture.initial_modes(fit)


@query(_FIT + "SELECT gene_id, round(k, 6) + 0 AS k, round(c, 6) + 0 AS c FROM fit")
def nb_moment_fit(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_all(spark, folder)[1], "k", "c")


@query(_FIT + "SELECT gene_id, mode, round(k, 6) + 0 AS k, round(c, 6) + 0 AS c FROM md")
def mixture_init(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_all(spark, folder)[2], "k", "c")


@query(_HX + "SELECT gene_id, x, mode, round(l, 6) + 0 AS l FROM lp")
def nb_logpmf(spark: SparkSession, folder: str) -> DataFrame:
    hist, _, modes = _all(spark, folder)
    return hist.join(modes, "gene_id").select("gene_id", "x", "mode", F.round(nb.nb_logpmf(F.col("x"), F.col("k"), F.col("c")), 6).alias("l"))


@query(_HX + "SELECT gene_id, x, mode, round(exp(l), 9) + 0 AS p FROM lp")
def nb_pmf(spark: SparkSession, folder: str) -> DataFrame:
    hist, _, modes = _all(spark, folder)
    return hist.join(modes, "gene_id").select("gene_id", "x", "mode", F.round(nb.nb_pmf(F.col("x"), F.col("k"), F.col("c")), 9).alias("p"))


@query(_HX + "SELECT gene_id, x, mode, round(CASE WHEN x = 0 THEN ln(0.1 + 0.9 * exp(l)) ELSE ln(0.9) + l END, 6) + 0 AS l FROM lp")
def zinb_logpmf(spark: SparkSession, folder: str) -> DataFrame:
    hist, _, modes = _all(spark, folder)
    value = nb.zinb_logpmf(F.col("x"), F.col("k"), F.col("c"), F.lit(0.1))
    return hist.join(modes, "gene_id").select("gene_id", "x", "mode", F.round(value, 6).alias("l"))


_P = _HX + """, pr AS (SELECT gene_id, x, n, mode, joint, top, greatest(exp(joint - top) / sum(exp(joint - top)) OVER (PARTITION BY gene_id, x), 1e-12) AS p FROM jt),
pn AS (SELECT gene_id, x, n, mode, joint, top, p / sum(p) OVER (PARTITION BY gene_id, x) AS p FROM pr) """


@query(_P + "SELECT gene_id, x, n, mode, round(p, 6) + 0 AS p FROM pn")
def responsibilities(spark: SparkSession, folder: str) -> DataFrame:
    hist, _, modes = _all(spark, folder)
    return rounded(mixture.responsibilities(hist, modes), "p").drop("joint")


@query(_P + "SELECT gene_id, x, CAST(arg_max(mode, {'p': round(p, 12), 'm': -mode}) AS INT) AS mode FROM pn GROUP BY gene_id, x")
def mode_class(spark: SparkSession, folder: str) -> DataFrame:
    hist, _, modes = _all(spark, folder)
    return mixture.most_likely_mode(mixture.responsibilities(hist, modes), ["gene_id", "x"])


_LL = _P + ", ll AS (SELECT gene_id, sum(n) AS n, sum(n * l) AS loglik FROM (SELECT gene_id, x, any_value(n) AS n, any_value(top) + ln(sum(exp(joint - top))) AS l FROM pn GROUP BY gene_id, x) GROUP BY gene_id) "


@query(_LL + "SELECT gene_id, CAST(n AS BIGINT) AS n, round(loglik, 4) + 0 AS loglik FROM ll")
def mixture_loglik(spark: SparkSession, folder: str) -> DataFrame:
    hist, _, modes = _all(spark, folder)
    return rounded(mixture.log_likelihood(hist, modes), "loglik", digits=4)


@query(_LL + "SELECT gene_id, round(ln(n) * 4 - 2 * loglik, 4) + 0 AS bic FROM ll")
def mixture_bic(spark: SparkSession, folder: str) -> DataFrame:
    hist, _, modes = _all(spark, folder)
    return rounded(mixture.bic(mixture.log_likelihood(hist, modes), 2), "bic", digits=4)


@query(_HX + """, tp AS (SELECT gene_id, max(x) AS top FROM hx WHERE n > 0 GROUP BY gene_id), gr AS (SELECT gene_id, CAST(unnest(range(0, top + 1)) AS INT) AS x FROM tp)
SELECT gene_id, x, round(sum(0.5 * exp(lgamma(x + kk) - lgamma(kk) - lgamma(x + 1.0) + kk * ln(c) - (x + kk) * ln(1 + c))), 9) + 0 AS density FROM (SELECT gr.*, least(greatest(k, 1e-8), 1e5) AS kk, c FROM gr JOIN md USING (gene_id)) GROUP BY gene_id, x""")
def mixture_curve(spark: SparkSession, folder: str) -> DataFrame:
    hist, _, modes = _all(spark, folder)
    return rounded(mixture.mixture_curve(modes, hist.groupBy("gene_id").agg(F.max("x").alias("top"))), "density", digits=9)


@query(_BY_TIME + """, sh AS (SELECT gene_id, time_h, sum(n) AS t, round(0.3 * sum(n)) AS want FROM hist GROUP BY ALL),
b AS (SELECT h.*, want, coalesce(sum(n) OVER (PARTITION BY gene_id, time_h ORDER BY x DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hist h JOIN sh USING (gene_id, time_h))
SELECT gene_id, time_h, x, CAST(n AS BIGINT) AS n, CAST(least(greatest(want - before, 0), n) AS BIGINT) AS n_upper FROM b""")
def emd_to_modes(spark: SparkSession, folder: str) -> DataFrame:
    hist = compare.histogram(base.counts(spark, folder), base.cells(spark, folder), ["time_h"])
    return mixture.emd_to_modes(hist, hist.select("gene_id", "time_h").distinct().withColumn("w", F.lit(0.3)))


@query()
def mixture_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Two modes per gene with weights by time."""
    return mixture.fit_mixtures(compare.histogram(base.counts(spark, folder), base.cells(spark, folder), ["time_h"]))


@query()
def assign_basins(spark: SparkSession, folder: str) -> DataFrame:
    """The mode of every (gene, time, count)."""
    hist = cut(compare.histogram(base.counts(spark, folder), base.cells(spark, folder), ["time_h"]))
    return mixture.assign_modes(hist, mixture.fit_mixtures(hist))


@query()
def sample_nb(spark: SparkSession, folder: str) -> DataFrame:
    """A count drawn for every measured (cell, gene) from the gene's fitted distribution."""
    counts, cells = base.counts(spark, folder), base.cells(spark, folder)
    fit = mixture.moment_fit(depth.gene_moments(counts, cells))
    return mixture.sample_nb(counts.join(fit, "gene_id"), ["cell_id", "gene_id"], F.col("k"), F.col("c"))


@query(_P + """, wt AS (SELECT time_h, gene_id, mode, round(sum(p) / count(DISTINCT cell_id), 6) + 0 AS w FROM (SELECT cell.cell_id, time_h, g.gene_id, coalesce(x.x, 0) AS x FROM cell CROSS JOIN (SELECT DISTINCT gene_id FROM x) g LEFT JOIN x ON x.cell_id = cell.cell_id AND x.gene_id = g.gene_id WHERE time_h IS NOT NULL) d
  JOIN pn USING (gene_id, x) GROUP BY ALL) SELECT gene_id, time_h, mode, w FROM wt""")
def mixture_weights_per_cell(spark: SparkSession, folder: str) -> DataFrame:
    """Mean probability of each mode at each time, over all cells."""
    hist, _, modes = _all(spark, folder)
    p = mixture.responsibilities(hist, modes).select("gene_id", "x", "mode", "p")
    by_time = compare.histogram(base.counts(spark, folder), base.cells(spark, folder), ["time_h"])
    w = by_time.join(p, ["gene_id", "x"]).groupBy("gene_id", "time_h", "mode").agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("w"))
    return rounded(w, "w")


@query()
def em_soft(spark: SparkSession, folder: str) -> DataFrame:
    """One mixture per gene over all times, by expectation maximisation."""
    return mixture.fit_soft(compare.histogram(base.counts(spark, folder), base.cells(spark, folder), ["time_h"]))


@query()
def fit_mixture_test(spark: SparkSession, folder: str) -> DataFrame:
    """``gene_id, x, n, mode, p``: counts of the test cells under the modes of the train cells, every mode alike."""
    counts, cells = base.counts(spark, folder), cut(selection.split_train_test(base.cells(spark, folder)))
    of = lambda part: compare.histogram(counts.join(cells.filter(F.col("part") == part).select("cell_id"), "cell_id", "left_semi"), cells.filter(F.col("part") == part).withColumn("all", F.lit(0)), ["all"]).select("gene_id", "x", "n")
    train = compare.histogram(counts, cells.filter("part = 'train'"), ["time_h"])
    modes = mixture.fit_mixtures(train).select("gene_id", "mode", "k", "c").distinct()
    return mixture.responsibilities(of("test"), modes).drop("joint")
