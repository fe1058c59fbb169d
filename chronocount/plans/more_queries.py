"""Joins, baselines and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronocount.functions.nb import nb_pmf
from chronocount.operators import baselines, compare, evaluate, mixture, trajectory
from chronocount.operators.packed import split_packed
from chronocount.plans import base
from chronocount.plans.compare_queries import QUERIES as COMPARED
from chronocount.plans.counts_queries import rounded
from chronocount.session import cut, read
from chronocount.sources.text import up_to_last
from chronocount.streaming.events import daily_counts



QUERIES, SQL, query = base.registrar(base.SQL)


@query("SELECT gene_id, time_h, count(*) AS n, sum(x) AS total FROM x JOIN cell USING (cell_id) GROUP BY gene_id, time_h")
def join_obs(spark: SparkSession, folder: str) -> DataFrame:
    """Counts with the attributes of their cells."""
    both = base.counts(spark, folder).join(base.cells(spark, folder), "cell_id")
    return both.groupBy("gene_id", "time_h").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


@query("SELECT cell_id, gene_id, round(x * coalesce(d1 / nullif(d0, 0), 1), 6) + 0 AS scaled FROM x JOIN genes USING (gene_id)")
def join_params(spark: SparkSession, folder: str) -> DataFrame:
    """Counts scaled by their gene's ratio of rates."""
    ratio = F.coalesce(F.col("d1") / F.nullif("d0", F.lit(0.0)), F.lit(1.0))
    return base.counts(spark, folder).join(base.genes(spark, folder), "gene_id").select("cell_id", "gene_id", F.round(F.col("x") * ratio, 6).alias("scaled"))


@query("SELECT gene_id FROM (SELECT DISTINCT gene_id, dataset FROM x JOIN cell USING (cell_id) WHERE x > 0) GROUP BY gene_id HAVING count(*) = (SELECT count(DISTINCT dataset) FROM x JOIN cell USING (cell_id) WHERE x > 0)")
def join_common_genes(spark: SparkSession, folder: str) -> DataFrame:
    """Genes seen in every dataset."""
    pairs = base.counts(spark, folder).filter("x > 0").join(base.cells(spark, folder), "cell_id").select("gene_id", "dataset").distinct()
    n = pairs.agg(F.count_distinct("dataset").alias("n"))
    return pairs.groupBy("gene_id").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).filter("k = n").select("gene_id")


@query("SELECT cell_id, gene_id, x FROM x WHERE gene_id IN (SELECT gene_id FROM genes WHERE gene_name IN (SELECT gene FROM gene_list))")
def semi_gene_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of listed genes."""
    listed = base.genes(spark, folder).join(read(spark, folder, "gene_list"), F.col("gene") == F.col("gene_name"), "left_semi")
    return base.counts(spark, folder).join(listed.select("gene_id"), "gene_id", "left_semi")


_PROFILES = ", pf AS (SELECT cell_id, list_sort(list({'g': gene_id, 'x': x})) AS p, any_value(dataset) AS dataset, any_value(time_h) AS time_h FROM x JOIN cell USING (cell_id) WHERE x > 0 GROUP BY cell_id) "


@query(_PROFILES + """, nx AS (SELECT *, lead(cell_id) OVER (PARTITION BY dataset ORDER BY time_h, cell_id) AS next_id FROM pf),
al AS (SELECT p, count(*) AS k FROM nx GROUP BY p), cl AS (SELECT p, next_id AS dst, count(*) AS n FROM nx WHERE next_id IS NOT NULL GROUP BY p, next_id)
SELECT s.cell_id AS src, count(*) AS n_next, round(sum(n / k), 6) + 0 AS w FROM nx s JOIN cl USING (p) JOIN al USING (p) GROUP BY s.cell_id""")
def join_exact_profile(spark: SparkSession, folder: str) -> DataFrame:
    """How many successors (the cells after those of the same profile in their dataset) each cell has by its whole profile, and their weight."""
    own = base.counts(spark, folder).filter("x > 0").join(base.cells(spark, folder).select("cell_id"), "cell_id")
    p = own.groupBy("cell_id").agg(F.sort_array(F.collect_list(F.struct("gene_id", "x"))).alias("x"))
    p = cut(p.join(base.cells(spark, folder).select("cell_id", "dataset", "time_h"), "cell_id"))
    after = F.lead("cell_id").over(Window.partitionBy("dataset").orderBy(F.col("time_h").asc_nulls_last(), "cell_id"))
    classes, members = trajectory.exact_profiles(p.select(F.col("cell_id").alias("key"), "x"), p.withColumn("next_id", after).select("x", "next_id"))
    per_class = classes.groupBy("profile").agg(F.count(F.lit(1)).alias("n_next"), F.sum("w").alias("w"))
    return rounded(members.join(per_class, "profile").select("src", "n_next", "w"), "w")


@query(", c AS (SELECT cell_id, rd, time_h, lead(rd) OVER (PARTITION BY sample_id ORDER BY time_h, cell_id) AS nx FROM cell WHERE rd IS NOT NULL AND sample_id IS NOT NULL AND time_h IS NOT NULL) SELECT round(avg(pow(ln(1 + rd) - ln(1 + nx), 2)), 6) + 0 AS metric FROM c WHERE nx IS NOT NULL")
def coupling_metric(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of depth factors between each cell and the one after it in its sample."""
    c = base.cells(spark, folder).filter("rd is not null and sample_id is not null and time_h is not null")
    chained = c.withColumn("dst", F.lead("cell_id").over(Window.partitionBy("sample_id").orderBy("time_h", "cell_id"))).filter("dst is not null")
    coupling = chained.select(F.col("cell_id").alias("src"), "dst", F.lit(1.0).alias("w"))
    state = c.select(F.col("cell_id").alias("cell"), F.array("rd").alias("x"))
    return rounded(evaluate.coupling_metric(coupling, state, state.withColumnRenamed("cell", "src"), 1), "metric")


_HALF = """kn AS (SELECT gene_name AS known, ln(2) / nullif(d0, 0) AS rna, ln(2) / nullif(d1, 0) AS prot FROM genes WHERE gene_name IS NOT NULL),
nm AS (SELECT DISTINCT gene AS name FROM gene_list WHERE trim(gene) <> ''), tr AS (SELECT DISTINCT name, substr(name, 1, CAST(floor(length(name) * (10 - i) / 10) AS INT)) AS part FROM nm, (SELECT unnest(range(0, 10)) AS i)),
mt AS (SELECT name, part, avg(rna) AS rna, avg(prot) AS prot FROM tr JOIN kn ON starts_with(known, part) WHERE part <> '' GROUP BY ALL),
bs AS (SELECT name, arg_max({'r': rna, 'p': prot}, length(part)) AS b FROM mt GROUP BY name), av AS (SELECT avg(rna) AS r, avg(prot) AS p FROM kn),
hl AS (SELECT name, CASE WHEN b IS NULL THEN av.r ELSE b.r END AS rna, CASE WHEN b IS NULL THEN av.p ELSE b.p END AS prot FROM nm LEFT JOIN bs USING (name), av),
rt AS (SELECT name, ln(2) / nullif(rna, 0) AS d0, ln(2) / nullif(coalesce(prot, rna * av.p / av.r), 0) AS d1 FROM hl, av), mn AS (SELECT avg(d0) AS m0, avg(d1) AS m1 FROM rt)
SELECT name, round(CASE WHEN d0 IS NOT NULL THEN greatest(least(d0, 10 * m0), m0 / 10) END, 6) + 0 AS d0, round(CASE WHEN d1 IS NOT NULL THEN greatest(least(d1, 10 * m1), m1 / 10) END, 6) + 0 AS d1 FROM rt, mn"""


@query(", " + _HALF)
def halflife_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Decay rates of every listed name, from the half-lives of the genes that share its longest prefix."""
    half = lambda c, name: (F.log(F.lit(2.0)) / F.nullif(F.col(c), F.lit(0.0))).alias(name)
    known = base.genes(spark, folder).filter("gene_name is not null").select(F.col("gene_name").alias("known"), half("d0", "rna"), half("d1", "prot"))
    names = read(spark, folder, "gene_list").filter(F.trim("gene") != "").select(F.col("gene").alias("name")).distinct()
    return rounded(trajectory.halflife_rates(names, known), "d0", "d1")


@query("SELECT combo_id, CASE WHEN regexp_matches(trim(coalesce(ko, '')), '^(|0|nan|None)$') THEN 0 ELSE 1 END AS any_off FROM (SELECT DISTINCT combo_id, ko, ov FROM ko_ov_list)")
def scan_perturbations(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each perturbation knocks out any gene."""
    rows = read(spark, folder, "ko_ov_list").select("combo_id", "ko", "ov").distinct()
    return rows.select("combo_id", (F.size(split_packed("ko")) > 0).cast("int").alias("any_off"))


@query("SELECT gene, count(*) AS n FROM (SELECT trim(gene) AS gene FROM gene_list WHERE trim(gene) <> '') GROUP BY gene")
def scan_gene_list(spark: SparkSession, folder: str) -> DataFrame:
    """Listed names, blanks of any kind taken off their ends."""
    g = read(spark, folder, "gene_list").select(F.regexp_replace("gene", r"^\p{Z}+|\p{Z}+$", "").alias("gene")).filter("gene <> ''")
    return g.groupBy("gene").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT cell_id, time_h FROM cell WHERE time_h <= (SELECT max(time_h) FROM cell WHERE dataset = (SELECT min(dataset) FROM cell))")
def scan_time_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    """Cells up to the last time of the first dataset."""
    c = base.cells(spark, folder)
    first = c.agg(F.min("dataset").alias("dataset"))
    return up_to_last(c, c.join(F.broadcast(first), "dataset").select("time_h")).select("cell_id", "time_h")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Daily counts of events; the same function runs on a stream."""
    return daily_counts(read(spark, folder, "events")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query()
def sincerities(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from lagged changes of the genes' distributions, signed by the partial correlation of the counts."""
    edges = baselines.lagged_regression(cut(COMPARED["ks_distance_matrix"](spark, folder)))
    return baselines.signed(edges, COMPARED["partial_corr_sign"](spark, folder))


def _wide(spark: SparkSession, folder: str) -> tuple[DataFrame, list[int]]:
    """Log counts of every cell over all genes that have counts, and the genes."""
    counts = base.counts(spark, folder)
    genes = sorted(r[0] for r in counts.select("gene_id").distinct().collect())
    m = counts.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene_id", "x"))).alias("m"))
    x = F.transform(F.array(*[F.lit(g) for g in genes]), lambda g: F.log1p(F.coalesce(F.try_element_at("m", g), F.lit(0).cast("bigint"))))
    return cut(base.cells(spark, folder).join(m, "cell_id", "left").select("cell_id", "cell_type", x.alias("x"))), genes


@query()
def genie3(spark: SparkSession, folder: str) -> DataFrame:
    """Forest importances of all genes for each other."""
    wide, genes = _wide(spark, folder)
    names = F.array(*[F.lit(g) for g in genes])
    found = baselines.forest_importances(wide, len(genes), list(range(len(genes))))
    return found.select(F.get(names, "src").alias("src"), F.get(names, "tgt").alias("tgt"), "w")


@query()
def predict_cell_types(spark: SparkSession, folder: str) -> DataFrame:
    """The type that a forest trained on the labelled cells gives to every cell."""
    wide, genes = _wide(spark, folder)
    return baselines.predict_cell_types(baselines.train_classifier(wide, len(genes)), wide, len(genes))


@query("SELECT dataset, gene_id, CAST(sum(CASE WHEN gene_id % 2 = 0 AND gene_id IN (SELECT gene_id FROM genes) THEN greatest(x - 1, 0) ELSE x END) AS BIGINT) AS total FROM x JOIN cell USING (cell_id) GROUP BY dataset, gene_id")
def swap_gene_columns(spark: SparkSession, folder: str) -> DataFrame:
    """``dataset, gene_id, total``: counts of each gene where the panel's even genes are taken from the cells' counts less one."""
    counts = base.counts(spark, folder)
    other = counts.withColumn("x", F.greatest(F.col("x") - 1, F.lit(0).cast("bigint")))
    even = base.genes(spark, folder).filter("gene_id % 2 = 0").select("gene_id")
    both = baselines.swapped(counts, other, even).join(base.cells(spark, folder).select("cell_id", "dataset"), "cell_id")
    return both.groupBy("dataset", "gene_id").agg(F.sum("x").alias("total"))


@query()
def ks_vs_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Distance of every gene's counts at every time from its fitted mixture."""
    hist = cut(compare.histogram(base.counts(spark, folder), base.cells(spark, folder), ["time_h"]))
    modes = cut(mixture.fit_mixtures(hist))
    top = hist.groupBy("gene_id", "time_h").agg(F.max("x").alias("top"))
    grid = top.select("gene_id", "time_h", F.explode(F.sequence(F.lit(0), F.col("top").cast("int"))).alias("x"))
    model = grid.join(modes, ["gene_id", "time_h"]).groupBy("gene_id", "time_h", "x").agg(F.sum(F.col("w") * nb_pmf(F.col("x"), F.col("k"), F.col("c"))).alias("q"))
    seen = model.join(hist.select("gene_id", "time_h", F.col("x").cast("int").alias("x"), "n"), ["gene_id", "time_h", "x"], "left")
    whole = Window.partitionBy("gene_id", "time_h")
    upto = whole.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("q").over(upto) - F.sum(F.coalesce("n", F.lit(0))).over(upto) / F.sum(F.coalesce("n", F.lit(0))).over(whole))
    return seen.withColumn("gap", gap).groupBy("gene_id", "time_h").agg(F.max("gap").alias("ks"))
