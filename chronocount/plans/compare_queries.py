"""Queries that compare distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.operators import compare, depth
from chronocount.operators.counts import ABSURD, pack_by_cell
from chronocount.plans import base
from chronocount.plans.counts_queries import _MOMENTS, rounded
from chronocount.session import cut, read



QUERIES, SQL, query = base.registrar(base.SQL)


_HIST = """, lab AS (SELECT cell_id, {by} FROM cell WHERE {notnull}),
size AS (SELECT {by}, count(*) AS size FROM lab GROUP BY {by}),
seen AS (SELECT gene_id, {by}, x, count(*) AS n FROM x JOIN lab USING (cell_id) WHERE x > 0 GROUP BY gene_id, {by}, x),
hist AS (SELECT * FROM seen UNION ALL SELECT gene_id, {by}, 0, size - coalesce(k, 0) FROM size CROSS JOIN (SELECT DISTINCT gene_id FROM x) LEFT JOIN (SELECT gene_id, {by}, sum(n) AS k FROM seen GROUP BY gene_id, {by}) USING (gene_id, {by}) WHERE size > coalesce(k, 0)) """
_BY_TIME = _HIST.format(by="time_h", notnull="time_h IS NOT NULL")
_BY_TYPE = _HIST.format(by="cell_type", notnull="cell_type IS NOT NULL")
_EARLY = """, ab AS (SELECT gene_id, x, coalesce(sum(n) FILTER (time_h < 36), 0) AS a, coalesce(sum(n) FILTER (time_h >= 36), 0) AS b FROM hist GROUP BY gene_id, x),
cum AS (SELECT gene_id, x, abs(sum(a) OVER w / sum(a) OVER g - sum(b) OVER w / sum(b) OVER g) AS gap, coalesce(lead(x) OVER (PARTITION BY gene_id ORDER BY x) - x, 0) AS width
  FROM ab WINDOW w AS (PARTITION BY gene_id ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY gene_id)) """


def _hist(spark: SparkSession, folder: str, by: str) -> DataFrame:
    return compare.histogram(base.counts(spark, folder), base.cells(spark, folder), [by])


@query(_BY_TIME + "SELECT gene_id, time_h, x, CAST(n AS BIGINT) AS n FROM hist")
def count_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _hist(spark, folder, "time_h")


@query(_BY_TIME + _EARLY + "SELECT gene_id, round(max(gap), 6) + 0 AS ks FROM cum GROUP BY gene_id")
def ks_two_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Early cells against late ones."""
    return rounded(compare.ks_two_sample(_hist(spark, folder, "time_h"), ["gene_id"], F.col("time_h") < 36), "ks")


@query(_BY_TIME + """, sd AS (SELECT gene_id, time_h < 36 AS early, x, sum(n) AS n FROM hist GROUP BY ALL), sz AS (SELECT gene_id, sum(n) FILTER (early) AS na, sum(n) FILTER (NOT early) AS nb FROM sd GROUP BY gene_id),
up AS (SELECT gene_id, early, x, n, sum(n) OVER (PARTITION BY gene_id, early ORDER BY x) AS t FROM sd), iv AS (SELECT gene_id, early, x, (t - n) * CASE WHEN early THEN nb ELSE na END AS f, t * CASE WHEN early THEN nb ELSE na END AS t, CAST(na * nb AS DOUBLE) AS w FROM up JOIN sz USING (gene_id))
SELECT a.gene_id AS gene_id, round(sum((least(a.t, b.t) - greatest(a.f, b.f)) / a.w * pow(CAST(a.x AS DOUBLE) - b.x, 2)), 6) + 0 AS cost
FROM iv a JOIN iv b ON a.gene_id = b.gene_id AND a.early AND NOT b.early AND a.f < b.t AND b.f < a.t GROUP BY a.gene_id""")
def ot_distance_exact(spark: SparkSession, folder: str) -> DataFrame:
    """Transport cost between early and late cells, gene by gene, at the squared distance."""
    return rounded(compare.transport_cost(_hist(spark, folder, "time_h"), ["gene_id"], F.col("time_h") < 36), "cost")


@query(_BY_TIME + """, t AS (SELECT time_h, lead(time_h) OVER (ORDER BY time_h) AS nx FROM (SELECT DISTINCT time_h FROM hist)), st AS (SELECT * FROM t WHERE nx IS NOT NULL),
u AS (SELECT gene_id, time_h, x, n AS a, 0 AS b FROM hist JOIN st USING (time_h) UNION ALL SELECT gene_id, st.time_h, x, 0, n FROM hist JOIN st ON hist.time_h = st.nx),
ab AS (SELECT gene_id, time_h, x, sum(a) AS a, sum(b) AS b FROM u GROUP BY ALL),
k AS (SELECT gene_id, time_h, max(gap) AS ks FROM (SELECT gene_id, time_h, abs(sum(a) OVER w / sum(a) OVER g - sum(b) OVER w / sum(b) OVER g) AS gap FROM ab
  WINDOW w AS (PARTITION BY gene_id, time_h ORDER BY x ROWS UNBOUNDED PRECEDING), g AS (PARTITION BY gene_id, time_h)) GROUP BY ALL)
SELECT gene_id, time_h, round(ks * (SELECT min(nx - time_h) FROM st) / (nx - time_h), 6) + 0 AS ks FROM k JOIN st USING (time_h)""")
def ks_distance_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.ks_distance_matrix(_hist(spark, folder, "time_h")), "ks")


@query(_MOMENTS + """, p AS (SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, sum(CAST(a.x AS DOUBLE) * b.x) AS p FROM x a JOIN x b ON a.cell_id = b.cell_id AND a.gene_id < b.gene_id GROUP BY ALL)
SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, round(CASE WHEN a.var > 1e-12 AND b.var > 1e-12 THEN (coalesce(p, 0) / a.n_cells - a.mean * b.mean) / sqrt(a.var * b.var) END, 6) + 0 AS r
FROM m a JOIN m b ON a.gene_id < b.gene_id LEFT JOIN p ON p.gene_a = a.gene_id AND p.gene_b = b.gene_id""")
def pearson_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.pearson_matrix(*_packed(spark, folder)), "r")


def _packed(spark: SparkSession, folder: str) -> tuple[DataFrame, list[int], int]:
    """Packed valid counts of the cells of ``cells``, the genes in them, and the number of cells."""
    cells = read(spark, folder, "cells").filter("cell_id is not null").select("cell_id").distinct()
    valid = read(spark, folder, "counts").select("cell_id", "gene_id", "x").filter((F.col("x") >= 0) & (F.col("x") < ABSURD))
    packed = cut(pack_by_cell(valid).join(cells, "cell_id", "left_semi"))
    panel = [r[0] for r in packed.select(F.explode("codes").alias("c")).select(F.shiftright("c", 21)).distinct().collect()]
    return packed, panel, cells.count()


@query()
def partial_corr_sign(spark: SparkSession, folder: str) -> DataFrame:
    """Sign of the partial correlation of every two genes of the panel."""
    packed, panel, n = _packed(spark, folder)
    return compare.partial_corr_sign(compare.pearson_matrix(packed, panel, n), panel)


@query()
def pca(spark: SparkSession, folder: str) -> DataFrame:
    """The first ten principal components of every cell's log counts."""
    packed, panel, _ = _packed(spark, folder)
    return compare.principal_components(packed, panel, 10)


@query(_MOMENTS + """, sg AS (SELECT gene_id FROM genes WHERE gene_id <= 10), bn AS (SELECT gene_id, ntile(5) OVER (ORDER BY round(mean, 9), gene_id) AS bin FROM m),
ow AS (SELECT * FROM bn WHERE gene_id IN (FROM sg)), ot AS (SELECT gene_id FROM (SELECT gene_id, row_number() OVER (PARTITION BY bin ORDER BY md5('0|' || gene_id), gene_id) AS r FROM bn WHERE gene_id NOT IN (FROM sg) AND bin IN (SELECT bin FROM ow)) WHERE r <= 8),
sm AS (SELECT cell_id, sum(x) FILTER (gene_id IN (SELECT gene_id FROM ow)) AS a, sum(x) FILTER (gene_id IN (FROM ot)) AS b FROM x GROUP BY cell_id)
SELECT cell_id, round(coalesce(coalesce(a, 0) / nullif((SELECT count(*) FROM ow), 0), 0) - coalesce(coalesce(b, 0) / nullif((SELECT count(*) FROM ot), 0), 0), 6) + 0 AS score FROM cell LEFT JOIN sm USING (cell_id)""")
def signature_score(spark: SparkSession, folder: str) -> DataFrame:
    """Score of the first ten genes against others of their level."""
    counts, cells = base.counts(spark, folder), base.cells(spark, folder)
    score = compare.signature_score(counts, cells, depth.gene_moments(counts, cells), base.genes(spark, folder).filter("gene_id <= 10"), 5, 8)
    return rounded(score, "score")


_MEANS = _BY_TIME + ", mt AS (SELECT gene_id, time_h, sum(x * n) / sum(n) AS mean, sqrt(greatest(sum(CAST(x AS DOUBLE) * x * n) / sum(n) - (sum(x * n) / sum(n)) * (sum(x * n) / sum(n)), 0)) AS sd FROM hist GROUP BY gene_id, time_h) "


@query(_MEANS + "SELECT gene_id, time_h, round(mean, 6) + 0 AS mean, round(sd, 6) + 0 AS sd FROM mt")
def mean_sd_by_time(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.mean_sd_by_time(_hist(spark, folder, "time_h")), "mean", "sd")


@query(_MEANS + "SELECT gene_id, round(var_pop(mean), 6) + 0 AS spread FROM mt GROUP BY gene_id ORDER BY round(var_pop(mean), 9) DESC, gene_id LIMIT 10")
def top_variable_genes(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.top_variable_genes(compare.mean_sd_by_time(_hist(spark, folder, "time_h"))), "spread")


_SHARE = """, n AS (SELECT {g}, cell_type, count(*) AS n FROM cell WHERE {g} IS NOT NULL AND cell_type IS NOT NULL GROUP BY ALL)
SELECT {g}, cell_type, round(100 * coalesce(n.n, 0) / t.t, 6) + 0 AS percent FROM (SELECT {g}, sum(n) AS t FROM n GROUP BY {g}) t CROSS JOIN (SELECT DISTINCT cell_type FROM n) c LEFT JOIN n USING ({g}, cell_type)"""


@query(_SHARE.format(g="dataset"))
def celltype_proportions(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.proportions(base.cells(spark, folder), "dataset", "cell_type"), "percent")


@query(_SHARE.format(g="time_h"))
def celltype_timeline(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.proportions(compare.evenly_spaced(base.cells(spark, folder), "time_h"), "time_h", "cell_type"), "percent")


@query(_MOMENTS + """, z AS (SELECT gene_id, mean, sqrt(var) AS sd FROM m WHERE var > 1e-12 AND gene_id <= 10), k AS (SELECT sum(-mean / sd) AS zero, count(*) AS k FROM z),
u AS (SELECT cell_id, sum(x / sd) AS up FROM x JOIN z USING (gene_id) GROUP BY cell_id) SELECT cell_id, round((coalesce(up, 0) + zero) / nullif(k, 0), 6) + 0 AS score FROM (SELECT cell_id FROM cell) LEFT JOIN u USING (cell_id), k""")
def zscore_signature(spark: SparkSession, folder: str) -> DataFrame:
    counts, cells = base.counts(spark, folder), base.cells(spark, folder)
    return rounded(compare.zscore_signature(counts, cells, depth.gene_moments(counts, cells), base.genes(spark, folder).filter("gene_id <= 10")), "score")


@query(_BY_TYPE + "SELECT gene_id, cell_type, round(sum(x * n) / sum(n), 6) + 0 AS mean FROM hist GROUP BY gene_id, cell_type")
def group_mean(spark: SparkSession, folder: str) -> DataFrame:
    h = _hist(spark, folder, "cell_type")
    return rounded(h.groupBy("gene_id", "cell_type").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean")), "mean")


@query(_BY_TYPE + "SELECT gene_id, cell_type FROM (SELECT gene_id, cell_type, row_number() OVER (PARTITION BY gene_id ORDER BY round(sum(x * n) / sum(n), 9) DESC, cell_type) AS r FROM hist GROUP BY gene_id, cell_type) WHERE r = 1")
def dominant_label(spark: SparkSession, folder: str) -> DataFrame:
    h = _hist(spark, folder, "cell_type")
    means = h.groupBy("gene_id", "cell_type").agg(F.round(F.sum(F.col("x") * F.col("n")) / F.sum("n"), 9).alias("mean"))
    return compare.dominant_label(means, "gene_id", "cell_type", "mean")


@query(_BY_TIME + """, tp AS (SELECT *, max(x) OVER g AS top, sum(n) OVER g AS total FROM hist WINDOW g AS (PARTITION BY gene_id, time_h))
SELECT gene_id, time_h, CAST(least(x * 25 // top, 24) AS INT) AS bin, round(sum(n) / (any_value(total) * any_value(top) / 25), 6) + 0 AS density FROM tp WHERE top > 0 GROUP BY ALL""")
def histogram_density(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(compare.histogram_density(_hist(spark, folder, "time_h"), ["gene_id", "time_h"]), "density")


@query(""", z AS (SELECT time_h, gene_id, sum(n) FILTER (x = 0) / sum(n) AS share FROM hist GROUP BY ALL) SELECT gene_id, time_h, round(coalesce(share, 0), 6) + 0 AS share FROM z""".join((_BY_TIME, "")))
def zero_ratio(spark: SparkSession, folder: str) -> DataFrame:
    h = _hist(spark, folder, "time_h")
    return rounded(h.groupBy("gene_id", "time_h").agg((F.sum(F.when(F.col("x") == 0, F.col("n")).otherwise(0)) / F.sum("n")).alias("share")), "share")


@query(""", p AS (SELECT a.embedding AS a, b.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT round(sum(list_inner_product(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[]))) / sum(sqrt(list_inner_product(CAST(a AS DOUBLE[]), CAST(a AS DOUBLE[]))) * sqrt(list_inner_product(CAST(b AS DOUBLE[]), CAST(b AS DOUBLE[])))), 6) + 0 AS cosine FROM p""")
def weighted_cosine(spark: SparkSession, folder: str) -> DataFrame:
    e = read(spark, folder, "embeddings")
    pairs = e.select("vec_id", F.col("embedding").alias("a")).join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return rounded(compare.weighted_cosine(pairs, "a", "b"), "cosine")
