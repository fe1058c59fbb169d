"""Queries on networks and their scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronocount.operators import evaluate, network
from chronocount.operators.packed import REFERENCE_DELIMITERS, split_packed
from chronocount.plans import base
from chronocount.plans.counts_queries import rounded
from chronocount.session import read


_EDGE = r"""WITH e AS (SELECT edge_id AS key, trim(src) AS src, trim(tgt) AS tgt, max(CASE WHEN contains(lower(coalesce(effect, '')), 'inhibit') OR regexp_matches(lower(coalesce(effect, '')), '\b(repression|repress|negative|downregulat|antagonis)') THEN -1 ELSE 1 END) AS sign
  FROM neko_edges WHERE trim(src) <> '' AND trim(tgt) <> '' GROUP BY ALL),
r AS (SELECT DISTINCT net_id, s.gene_id AS src, t.gene_id AS tgt, w FROM ref_network JOIN genes s ON s.gene_name = index_name JOIN genes t ON t.gene_name = ref_network.tgt),
n AS (SELECT net_id, src, tgt, max(w) AS w FROM r WHERE w IS NOT NULL GROUP BY ALL),
nw AS (SELECT src, tgt, avg(w) AS w FROM n GROUP BY ALL) """


QUERIES, SQL, query = base.registrar(_EDGE)


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return network.signed_edges(read(spark, folder, "neko_edges"), "edge_id", "src", "tgt", "effect")


def _nets(spark: SparkSession, folder: str) -> DataFrame:
    """``net_id, src, tgt, w`` of the prior networks whose row labels are exact names."""
    g = read(spark, folder, "genes")
    s, t = g.select(F.col("gene_id").alias("src"), F.col("gene_name").alias("index_name")), g.select(F.col("gene_id").alias("t"), F.col("gene_name").alias("tgt"))
    rows = read(spark, folder, "ref_network").join(s, "index_name").join(t, "tgt").filter("w is not null")
    return rows.groupBy("net_id", "src", F.col("t").alias("tgt")).agg(F.max("w").alias("w"))


def _mean_net(spark: SparkSession, folder: str) -> DataFrame:
    return _nets(spark, folder).groupBy("src", "tgt").agg(F.avg("w").alias("w"))


@query("SELECT key, src, tgt, sign FROM e")
def prior_sign(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder)


@query()
def split_refs(spark: SparkSession, folder: str) -> DataFrame:
    """References of each edge, over all its deliveries."""
    items = read(spark, folder, "neko_edges").select("edge_id", F.explode(split_packed("refs", REFERENCE_DELIMITERS)).alias("ref"))
    return items.distinct().groupBy("edge_id").agg(F.count(F.lit(1)).alias("n_refs"))


@query("SELECT src, tgt, count(*) AS n_edges, sum(sign) AS balance FROM e GROUP BY src, tgt")
def normalise_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _edges(spark, folder).groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("sign").alias("balance"))


@query(""", d AS (SELECT DISTINCT src, tgt FROM e), s AS (SELECT DISTINCT src FROM d),
l1 AS (SELECT src, tgt AS node FROM d WHERE src <> tgt),
l2 AS (SELECT DISTINCT l1.src, d.tgt AS node FROM l1 JOIN d ON d.src = l1.node WHERE d.tgt <> l1.src EXCEPT SELECT * FROM l1),
l3 AS (SELECT DISTINCT l2.src, d.tgt AS node FROM l2 JOIN d ON d.src = l2.node WHERE d.tgt <> l2.src EXCEPT SELECT * FROM l1 EXCEPT SELECT * FROM l2)
SELECT src, src AS node, 0 AS dist FROM s UNION ALL SELECT src, node, 1 FROM (SELECT DISTINCT * FROM l1) UNION ALL SELECT src, node, 2 FROM l2 UNION ALL SELECT src, node, 3 FROM l3""")
def graph_reach(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes within three steps of every source."""
    e = _edges(spark, folder)
    return network.graph_reach(e, e.select("src"), 3)


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "genes").filter("gene_id between 1 and 64").select(F.col("gene_name").alias("node"))


_PATHS = """, nm AS (SELECT gene_name AS node FROM genes WHERE gene_id BETWEEN 1 AND 64),
dir AS (SELECT src, tgt, arg_max(sign, key) AS sign FROM e WHERE src IN (FROM nm) AND tgt IN (FROM nm) AND src <> tgt GROUP BY ALL),
st AS (SELECT src AS node, tgt AS nx, sum(CASE WHEN sign > 0 THEN 1.0 ELSE 0 END) AS p, sum(CASE WHEN sign < 0 THEN 1.0 ELSE 0 END) AS q FROM e WHERE src <> tgt GROUP BY ALL),
w1 AS (SELECT nm.node AS src, nx AS node, p AS pos, q AS neg FROM nm JOIN st USING (node)),
w2 AS (SELECT w.src, nx AS node, sum(pos * p + neg * q) AS pos, sum(pos * q + neg * p) AS neg FROM w1 w JOIN st USING (node) WHERE w.node NOT IN (FROM nm) GROUP BY ALL),
n2 AS (SELECT w2.* FROM w2 LEFT JOIN w1 USING (src, node) WHERE w1.src IS NULL AND w2.src <> w2.node),
w3 AS (SELECT w.src, nx AS node, sum(pos * p + neg * q) AS pos, sum(pos * q + neg * p) AS neg FROM n2 w JOIN st USING (node) WHERE w.node NOT IN (FROM nm) GROUP BY ALL),
n3 AS (SELECT w3.* FROM w3 LEFT JOIN w1 ON w1.src = w3.src AND w1.node = w3.node LEFT JOIN n2 ON n2.src = w3.src AND n2.node = w3.node WHERE w1.src IS NULL AND n2.src IS NULL AND w3.src <> w3.node),
paths AS (SELECT src, tgt, sign, 1 AS dist FROM dir UNION ALL SELECT src, node, CASE WHEN pos >= neg THEN 1 ELSE -1 END, 2 FROM n2 WHERE node IN (FROM nm)
  UNION ALL SELECT src, node, CASE WHEN pos >= neg THEN 1 ELSE -1 END, 3 FROM n3 WHERE node IN (FROM nm)) """


@query(_PATHS + "SELECT * FROM paths")
def prior_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Signs between the genes of the panel, within three steps."""
    return network.prior_paths(_edges(spark, folder), _listed(spark, folder))


_PRIOR = _PATHS + """, g AS (SELECT gene_id, gene_name FROM genes WHERE gene_id BETWEEN 1 AND 64),
kn AS (SELECT src AS nm FROM paths UNION SELECT tgt FROM paths),
pm AS (SELECT s.src, t.gene_id AS tgt, CAST(CASE WHEN s.src = 0 THEN 0 WHEN s.src = t.gene_id OR t.gene_name NOT IN (FROM kn) OR p.sign > 0 THEN 1 ELSE 0 END AS DOUBLE) AS w
  FROM (SELECT 0 AS src, NULL AS nm UNION ALL SELECT gene_id, gene_name FROM g) s CROSS JOIN g t LEFT JOIN paths p ON p.src = s.nm AND p.tgt = t.gene_name) """


@query(_PRIOR + "SELECT src, tgt, w FROM pm")
def prior_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return network.prior_matrix(prior_paths(spark, folder), read(spark, folder, "genes").filter("gene_id between 1 and 64"))


@query(_PRIOR + ", o AS (SELECT gene_id FROM genes WHERE NOT is_poissonian_rd) SELECT src, tgt, CASE WHEN src IN (FROM o) OR tgt IN (FROM o) THEN 0.0 WHEN src = 0 THEN 0.2 ELSE greatest(1.0, abs(w)) END AS m FROM pm")
def prior_mask(spark: SparkSession, folder: str) -> DataFrame:
    return network.prior_mask(prior_matrix(spark, folder), read(spark, folder, "genes").filter("not is_poissonian_rd").select("gene_id"))


@query("SELECT src, tgt, round(w, 6) + 0 AS w FROM (SELECT *, sum(abs(w)) OVER (PARTITION BY tgt) AS s FROM nw) WHERE abs(w) >= 0.2 AND abs(w) >= 0.1 * s")
def filter_edges(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(network.filter_edges(_mean_net(spark, folder), 0.2, 0.1), "w")


@query(""", c AS (SELECT *, round(abs(w - coalesce(lag(w) OVER (PARTITION BY src, tgt ORDER BY net_id), 0)), 9) + 0 AS change FROM n)
SELECT net_id AS frame, src, tgt, w, round(change, 6) + 0 AS change FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY change DESC, net_id) AS r FROM c) WHERE r = 1""")
def edges_at_max_change(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(network.edges_at_max_change(_nets(spark, folder).withColumnRenamed("net_id", "frame")), "change")


@query("SELECT a.net_id AS frame, a.src, a.tgt, a.w FROM n a LEFT JOIN n b ON b.net_id + 1 = a.net_id AND b.src = a.src AND b.tgt = a.tgt WHERE b.src IS NULL")
def new_edges_by_frame(spark: SparkSession, folder: str) -> DataFrame:
    return network.new_edges_by_frame(_nets(spark, folder).withColumnRenamed("net_id", "frame"))


@query("SELECT src, tgt, round(w, 6) + 0 AS w, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY abs(w) DESC, tgt) AS r FROM nw WHERE src <> tgt AND w <> 0) WHERE r <= 8")
def top_targets(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(network.top_targets(_mean_net(spark, folder)), "w")


@query(", s AS (SELECT src, round(sum(abs(w)), 9) + 0 AS strength FROM nw GROUP BY src) SELECT src, round(strength, 6) + 0 AS strength, row_number() OVER (ORDER BY strength DESC, src) AS rank FROM s")
def regulator_rank(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(network.regulator_rank(_mean_net(spark, folder)), "strength")


@query("SELECT src, tgt, round(w, 6) + 0 AS w FROM nw WHERE src <> tgt AND abs(w) >= (SELECT quantile_cont(abs(w), 0.9) FROM nw WHERE w <> 0)")
def top_fraction_edges(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(network.top_fraction_edges(_mean_net(spark, folder)), "w")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Prior weights as scores; the literature's edges as truth."""
    g = read(spark, folder, "genes")
    true = _edges(spark, folder).join(g.select(F.col("gene_id").alias("s"), F.col("gene_name").alias("src")), "src").join(g.select(F.col("gene_id").alias("t"), F.col("gene_name").alias("tgt")), "tgt")
    truth = true.select(F.col("s").alias("src"), F.col("t").alias("tgt"), F.lit(1).alias("truth")).distinct()
    return _mean_net(spark, folder).filter("src <> tgt and tgt >= 1").withColumn("score", F.round("w", 9)).join(truth, ["src", "tgt"], "left").withColumn("truth", F.coalesce("truth", F.lit(0)))


_SCORED = """, tr AS (SELECT DISTINCT s.gene_id AS src, t.gene_id AS tgt, 1 AS truth FROM e JOIN genes s ON s.gene_name = e.src JOIN genes t ON t.gene_name = e.tgt),
sc AS (SELECT src, tgt, round(w, 9) + 0 AS score, coalesce(truth, 0) AS truth FROM nw LEFT JOIN tr USING (src, tgt) WHERE src <> tgt AND tgt >= 1) """
_CURVE = """, pt AS (SELECT abs(score) AS s, sum(truth) AS p, count(*) AS n FROM {t} GROUP BY 1), cm AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w - sum(p) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () - sum(p) OVER () AS an FROM pt WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
cv AS (SELECT s, fp / nullif(an, 0) AS fpr, tp / nullif(ap, 0) AS tpr, tp / (tp + fp) AS pre FROM cm) """
_AUPR = "SELECT round(sum((tpr - x0) * (pre + y0) / 2), 6) + 0 AS aupr FROM (SELECT *, coalesce(lag(tpr) OVER (ORDER BY s DESC), 0) AS x0, coalesce(lag(pre) OVER (ORDER BY s DESC), 1) AS y0 FROM cv)"


@query(_SCORED + _CURVE.format(t="sc") + "SELECT s, round(fpr, 6) + 0 AS fpr, round(tpr, 6) + 0 AS tpr FROM cv")
def roc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.roc(_scored(spark, folder), "score", "truth"), "fpr", "tpr")


@query(_SCORED + _CURVE.format(t="sc") + "SELECT round(sum((fpr - x0) * (tpr + y0) / 2), 6) + 0 AS auroc FROM (SELECT *, coalesce(lag(fpr) OVER (ORDER BY s DESC), 0) AS x0, coalesce(lag(tpr) OVER (ORDER BY s DESC), 0) AS y0 FROM cv)")
def auroc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.auroc(_scored(spark, folder), "score", "truth"), "auroc")


@query(_SCORED + _CURVE.format(t="sc") + "SELECT s, round(tpr, 6) + 0 AS recall, round(pre, 6) + 0 AS precision FROM cv")
def pr(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.pr(_scored(spark, folder), "score", "truth"), "recall", "precision")


@query(_SCORED + _CURVE.format(t="sc") + _AUPR)
def aupr(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.aupr(_scored(spark, folder), "score", "truth"), "aupr")


@query(_SCORED + ", ud AS (SELECT least(src, tgt) AS a, greatest(src, tgt) AS b, max(abs(score)) AS score, max(truth) AS truth FROM sc GROUP BY ALL)" + _CURVE.format(t="ud") + _AUPR)
def aupr_undirected(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.aupr(evaluate.undirected(_scored(spark, folder)), "score", "truth"), "aupr")


@query(_SCORED + "SELECT round(avg(truth), 6) + 0 AS share FROM sc")
def random_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.random_baseline(_scored(spark, folder), "truth"), "share")


@query(_SCORED + "SELECT src, tgt, round(score, 6) + 0 AS score, row_number() OVER (ORDER BY score DESC, src, tgt) AS rank FROM sc")
def link_list(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(evaluate.link_list(_scored(spark, folder)).select("src", "tgt", "score", "rank"), "score")


@query(""", cu AS (SELECT src, CAST(row_number() OVER (PARTITION BY src ORDER BY tgt) - 1 AS INT) AS step, w FROM nw), k AS (SELECT DISTINCT src, CAST(unnest(range(0, (SELECT max(step) + 1 FROM cu))) AS INT) AS step FROM cu),
f AS (SELECT k.src, k.step, last_value(w IGNORE NULLS) OVER (PARTITION BY k.src ORDER BY k.step ROWS UNBOUNDED PRECEDING) AS v FROM k LEFT JOIN cu USING (src, step))
SELECT step, round(avg(v), 6) + 0 AS mean, round(stddev_samp(v) / sqrt(count(*)), 6) + 0 AS se FROM f WHERE v IS NOT NULL GROUP BY step""")
def pad_last(spark: SparkSession, folder: str) -> DataFrame:
    step = (F.row_number().over(Window.partitionBy("src").orderBy("tgt")) - 1).alias("step")
    curves = _mean_net(spark, folder).select("src", step, "w")
    return rounded(evaluate.padded_curves(curves, "src", "step", "w"), "mean", "se")


@query(""", c AS (SELECT *, round(abs(w - coalesce(lag(w) OVER (PARTITION BY src, tgt ORDER BY net_id), 0)), 9) AS change FROM n),
s AS (SELECT src, tgt, net_id AS start FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY change DESC, net_id) AS r FROM c) WHERE r = 1),
k AS (SELECT src, tgt FROM n GROUP BY ALL HAVING max(abs(w)) >= 0.05 AND CASE WHEN count(*) > 1 THEN max(abs(w)) - min(abs(w)) ELSE max(abs(w)) END >= 0.01)
SELECT net_id AS frame, src, tgt, w FROM n JOIN s USING (src, tgt) JOIN k USING (src, tgt) WHERE net_id >= start""")
def filter_network_time(spark: SparkSession, folder: str) -> DataFrame:
    return network.filtered_over_time(_nets(spark, folder).withColumnRenamed("net_id", "frame"))


@query("SELECT src, tgt, round(CASE WHEN abs(w) < 0.001 THEN w * w / 0.002 + 0.0005 ELSE abs(w) END, 6) + 0 AS penalty FROM nw")
def penalty(spark: SparkSession, folder: str) -> DataFrame:
    """Smoothed absolute weight of every edge."""
    return _mean_net(spark, folder).select("src", "tgt", (F.round(network.smoothed_l1(F.col("w")), 6) + 0.0).alias("penalty"))
