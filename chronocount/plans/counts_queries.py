"""Queries on moments, depth and selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.operators import depth, selection
from chronocount.plans import base
from chronocount.session import read

QUERIES, SQL, query = base.registrar(base.SQL)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    # Adding 0 makes one zero of both.
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})


@query("SELECT time_h, sample_id, count(*) AS n_cells FROM cell GROUP BY time_h, sample_id")
def cells_per_time_sample(spark: SparkSession, folder: str) -> DataFrame:
    return selection.cells_per_time_sample(base.cells(spark, folder))


_MOMENTS = """, m AS (SELECT gene_id, n AS n_cells, s / n AS mean, q / n - (s / n) * (s / n) AS var
  FROM (SELECT gene_id, CAST(sum(x) AS DOUBLE) AS s, sum(CAST(x AS DOUBLE) * x) AS q FROM x GROUP BY gene_id), (SELECT count(*) AS n FROM cell)) """


@query(_MOMENTS + "SELECT gene_id, n_cells, round(mean, 6) + 0 AS mean, round(var, 6) + 0 AS var FROM m")
def gene_moments(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(depth.gene_moments(base.counts(spark, folder), base.cells(spark, folder)), "mean", "var")


@query(_MOMENTS + """, g AS (SELECT * FROM m WHERE mean > 0.1), z AS (SELECT c.cell_id, coalesce(sum(x.x / g.mean), 0) AS z FROM cell c LEFT JOIN (x JOIN g USING (gene_id)) ON x.cell_id = c.cell_id GROUP BY c.cell_id)
SELECT p AS n_genes, round(greatest(((SELECT var_samp(z) FROM z) - d) / (p * (p - 1)), 0), 6) + 0 AS cv2
FROM (SELECT count(*) AS p, sum(var * n_cells / (n_cells - 1) / (mean * mean)) AS d FROM g)""")
def cv2_read_depth(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(depth.cv2_read_depth(base.counts(spark, folder), base.cells(spark, folder)), "cv2")


@query()
def poisson_genes(spark: SparkSession, folder: str) -> DataFrame:
    return depth.poisson_genes(base.counts(spark, folder), base.cells(spark, folder))


_FLAGGED = "(SELECT gene_id FROM genes WHERE is_poissonian_rd)"


@query(f""", s AS (SELECT c.cell_id, CAST(coalesce(sum(x.x), 0) AS DOUBLE) AS s FROM cell c LEFT JOIN x ON x.cell_id = c.cell_id AND x.gene_id IN {_FLAGGED} GROUP BY c.cell_id),
r AS (SELECT cell_id, least(greatest(s / (SELECT avg(s) FROM s), 0.2), 5) AS r FROM s)
SELECT cell_id, round(r / (SELECT avg(r) FROM r), 6) + 0 AS rd FROM r""")
def read_depth(spark: SparkSession, folder: str) -> DataFrame:
    flagged = base.genes(spark, folder).filter("is_poissonian_rd")
    return rounded(depth.read_depth(base.counts(spark, folder), base.cells(spark, folder), flagged), "rd")


@query("SELECT cell_id, round(rd / ((SELECT median(rd) FROM cell) + 1e-16), 6) + 0 AS rd FROM cell")
def normalise_rd_median(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(depth.normalised_rd(base.cells(spark, folder), "median"), "rd")


@query("SELECT cell_id, round(rd / ((SELECT avg(rd) FROM cell) + 1e-16), 6) + 0 AS rd FROM cell")
def normalise_rd_mean(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(depth.normalised_rd(base.cells(spark, folder), "mean"), "rd")


@query("SELECT cell_id, gene_id, CAST(round_even(x / CASE WHEN rd > 0 THEN rd ELSE 1 END, 0) AS BIGINT) AS x FROM x LEFT JOIN cell USING (cell_id)")
def depth_correct_counts(spark: SparkSession, folder: str) -> DataFrame:
    return depth.depth_corrected(base.counts(spark, folder), base.cells(spark, folder))


@query(", t AS (SELECT cell_id, gene_id, x, sum(x) OVER (PARTITION BY cell_id) AS t FROM x) SELECT cell_id, gene_id, round(ln(1 + x / t * 10000), 6) + 0 AS y FROM t WHERE t > 0")
def normalise_log1p(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(depth.log_normalised(base.counts(spark, folder)), "y")


_ORDERED = "row_number() OVER (PARTITION BY time_h, sample_id ORDER BY md5('0|' || cell_id), cell_id)"


@query(f"SELECT cell_id, time_h, sample_id FROM (SELECT *, {_ORDERED} AS r FROM cell) WHERE r <= 1000 // (SELECT count(DISTINCT time_h) FROM cell)")
def subsample_per_group(spark: SparkSession, folder: str) -> DataFrame:
    return selection.subsample_per_group(base.cells(spark, folder), 1000).select("cell_id", "time_h", "sample_id")


@query("SELECT cell_id, time_h FROM (SELECT *, row_number() OVER (PARTITION BY time_h ORDER BY md5('0|' || cell_id), cell_id) AS r FROM cell) WHERE r <= 100")
def subsample_fixed_per_time(spark: SparkSession, folder: str) -> DataFrame:
    return selection.subsample_fixed(base.cells(spark, folder), ["time_h"], 100).select("cell_id", "time_h")


@query("SELECT cell_id FROM cell ORDER BY md5('0|' || cell_id), cell_id LIMIT 5000")
def subset_cells(spark: SparkSession, folder: str) -> DataFrame:
    return selection.subset_cells(base.cells(spark, folder), 5000).select("cell_id")


@query(f"SELECT cell_id, CASE WHEN r <= floor(n * 0.6) THEN 'train' ELSE 'test' END AS part FROM (SELECT cell_id, {_ORDERED} AS r, count(*) OVER (PARTITION BY time_h, sample_id) AS n FROM cell)")
def split_train_test(spark: SparkSession, folder: str) -> DataFrame:
    return selection.split_train_test(base.cells(spark, folder), 0.6).select("cell_id", "part")


@query("SELECT cell_id, (10000 // n + CASE WHEN r <= 10000 % n THEN 1 ELSE 0 END) AS times FROM (SELECT cell_id, row_number() OVER (ORDER BY md5('0|' || cell_id), cell_id) AS r, count(*) OVER () AS n FROM cell WHERE time_h = 0)")
def repeat_min_choice(spark: SparkSession, folder: str) -> DataFrame:
    return selection.repeat_min_choice(base.cells(spark, folder).filter("time_h = 0").select("cell_id"), 10_000, "cell_id")


@query("SELECT sample_id, CAST(floor(quantile_cont(n, 0.8)) AS BIGINT) AS n_traj, least(CAST(floor(quantile_cont(n, 0.8)) AS BIGINT), 1024) AS batch_size FROM (SELECT sample_id, time_h, count(*) AS n FROM cell WHERE time_h IS NOT NULL GROUP BY ALL) GROUP BY sample_id")
def batch_size_plan(spark: SparkSession, folder: str) -> DataFrame:
    return selection.batch_size_plan(base.cells(spark, folder))


_UP = ", up AS (SELECT cell_id, gene_id FROM x WHERE x > 5), panel AS (SELECT DISTINCT gene_id FROM up) "
_TEMPORAL = _UP + """, n AS (SELECT sample_id, time_h, count(*) AS n FROM cell WHERE time_h IS NOT NULL AND sample_id IS NOT NULL GROUP BY ALL),
k AS (SELECT gene_id, sample_id, time_h, count(*) AS k FROM up JOIN cell USING (cell_id) GROUP BY ALL),
f AS (SELECT gene_id, n.sample_id, n.time_h, coalesce(k, 0) / n AS f FROM n CROSS JOIN panel LEFT JOIN k USING (gene_id, sample_id, time_h)),
tv AS (SELECT gene_id, time_h, sum(d) AS variation FROM (SELECT gene_id, time_h, 2 * abs(lead(f) OVER (PARTITION BY gene_id, sample_id ORDER BY time_h) - f) AS d FROM f) WHERE d IS NOT NULL GROUP BY ALL) """
_TYPES = """, nc AS (SELECT sample_id, cell_type, count(*) AS n FROM cell WHERE cell_type IS NOT NULL AND sample_id IS NOT NULL GROUP BY ALL),
kc AS (SELECT gene_id, sample_id, cell_type, count(*) AS k FROM up JOIN cell USING (cell_id) GROUP BY ALL),
fc AS (SELECT gene_id, nc.sample_id, nc.cell_type, coalesce(k, 0) AS k, n FROM nc CROSS JOIN panel LEFT JOIN kc USING (gene_id, sample_id, cell_type)),
cv AS (SELECT gene_id, cell_type, sum(d) AS variation FROM (SELECT gene_id, cell_type, 2 * abs(k / n - (sum(k) OVER w - k) / nullif(sum(n) OVER w - n, 0)) AS d FROM fc WINDOW w AS (PARTITION BY gene_id, sample_id)) WHERE d IS NOT NULL GROUP BY ALL) """


def _upper(spark: SparkSession, folder: str) -> DataFrame:
    """(cell, gene) pairs in the upper of two modes, split at a fixed count."""
    return base.counts(spark, folder).filter("x > 5").select("cell_id", "gene_id")


@query(_TEMPORAL + "SELECT gene_id, time_h, round(variation, 6) + 0 AS variation FROM tv")
def temporal_variation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.temporal_variation(_upper(spark, folder), base.cells(spark, folder)), "variation")


@query(_UP + _TYPES + "SELECT gene_id, cell_type, round(variation, 6) + 0 AS variation FROM cv")
def celltype_variation(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(selection.celltype_variation(_upper(spark, folder), base.cells(spark, folder)), "variation")


_TOP = "SELECT gene_id, '{kind}' AS kind, CAST({at} AS VARCHAR) AS at, r AS rank FROM (SELECT gene_id, {at}, round(variation, 9) + 0 AS v, row_number() OVER (PARTITION BY {at} ORDER BY round(variation, 9) DESC, gene_id) AS r FROM {t}) WHERE r <= {n} AND v >= 0.01"


@query(_TEMPORAL + _TYPES + _TOP.format(kind="temporal", at="time_h", t="tv", n=5) + " UNION ALL " + _TOP.format(kind="type", at="cell_type", t="cv", n=3))
def select_de_genes(spark: SparkSession, folder: str) -> DataFrame:
    up, cells = _upper(spark, folder), base.cells(spark, folder)
    return selection.select_de_genes(selection.temporal_variation(up, cells), selection.celltype_variation(up, cells))


@query(_TEMPORAL + "SELECT DISTINCT gene_id FROM genes JOIN gene_list ON gene = gene_name JOIN (SELECT gene_id FROM tv GROUP BY gene_id HAVING sum(variation) > 0.01) USING (gene_id)")
def keep_listed_if_variable(spark: SparkSession, folder: str) -> DataFrame:
    listed = base.genes(spark, folder).join(read(spark, folder, "gene_list"), F.col("gene") == F.col("gene_name"))
    return selection.kept_if_variable(listed, selection.temporal_variation(_upper(spark, folder), base.cells(spark, folder)))


@query("""SELECT cell_id, (CASE WHEN rd > e[1] THEN 1 ELSE 0 END + CASE WHEN rd > e[2] THEN 1 ELSE 0 END + CASE WHEN rd > e[3] THEN 1 ELSE 0 END) AS bin
FROM cell, (SELECT quantile_cont(rd, [0.25, 0.5, 0.75]) AS e FROM cell) WHERE rd IS NOT NULL""")
def panel_bins(spark: SparkSession, folder: str) -> DataFrame:
    return selection.panel_bins(base.cells(spark, folder), "cell_id", "rd", 4)


@query("SELECT gene_id, gene_name FROM genes WHERE gene_name IN (SELECT gene FROM gene_list) ORDER BY gene_name")
def project_genes(spark: SparkSession, folder: str) -> DataFrame:
    listed = read(spark, folder, "gene_list").select(F.col("gene").alias("gene_name")).distinct()
    return base.genes(spark, folder).select("gene_id", "gene_name").join(listed, "gene_name", "left_semi").orderBy("gene_name")


@query("SELECT cell_id, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5('0|' || cell_id), cell_id) AS r FROM cell WHERE time_h = 0) WHERE r <= 200")
def select_cells_for_rates(spark: SparkSession, folder: str) -> DataFrame:
    return selection.select_cells_for_rates(base.cells(spark, folder), 200)


@query("SELECT dataset, count(*) AS n_cells FROM cell WHERE time_h = 24 AND cell_type IN ('stemearly', 'stemlate') GROUP BY dataset")
def isin_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of two types at one time, by dataset."""
    c = base.cells(spark, folder).filter((F.col("time_h") == 24) & F.col("cell_type").isin("stemearly", "stemlate"))
    return c.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_cells"))


@query()
def seeded_split(spark: SparkSession, folder: str) -> DataFrame:
    """The split by seeded hash, with hot groups ranked in parts."""
    return selection.split_train_test(base.cells(spark, folder)).select("cell_id", "part")
