"""Queries on states, couplings and simulation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.operators import compare, dynamics, fit, mixture, network, selection, trajectory
from chronocount.operators.packed import split_packed
from chronocount.plans import base
from chronocount.plans.counts_queries import rounded
from chronocount.session import cut, read



QUERIES, SQL, query = base.registrar(base.SQL)


_STATE = ", st AS (SELECT cell_id, gene_id, x / (x + 10.0) AS prot, CASE WHEN x > 5 THEN 1.0 ELSE 0.1 END AS kon, coalesce(d1, 0.05) AS d1, time_h, sample_id, dataset FROM x JOIN cell USING (cell_id) JOIN genes USING (gene_id) WHERE time_h IS NOT NULL) "


def states(spark: SparkSession, folder: str) -> DataFrame:
    """Protein state and mode value of each counted (cell, gene), from its count, with the gene's rate."""
    rows = base.counts(spark, folder).join(base.cells(spark, folder), "cell_id").join(base.genes(spark, folder), "gene_id").filter("time_h is not null")
    x = F.col("x").cast("double")
    return rows.select("cell_id", "gene_id", (x / (x + 10.0)).alias("prot"), F.when(F.col("x") > 5, 1.0).otherwise(0.1).alias("kon"), F.coalesce("d1", F.lit(0.05)).alias("d1"), "time_h", "sample_id", "dataset")


@query(_STATE + "SELECT cell_id, gene_id, round(kon + ((0.1 + (prot - 0.1) * exp(-d1 * 0.4 * 6)) - kon) * exp(-d1 * 0.6 * 6), 6) + 0 AS prot FROM st")
def next_state(spark: SparkSession, folder: str) -> DataFrame:
    """States after 6 hours, 40 % of them towards the lower mode."""
    p = trajectory.next_state(F.col("prot"), F.col("d1"), F.lit(0.1), F.col("kon"), F.lit(0.4), F.lit(1.0), F.lit(6.0))
    return states(spark, folder).select("cell_id", "gene_id", F.round(p, 6).alias("prot"))


@query(_STATE + "SELECT cell_id, gene_id, round(prot * exp(-d1 * 6), 6) + 0 AS prot FROM st")
def decay_flow(spark: SparkSession, folder: str) -> DataFrame:
    return states(spark, folder).select("cell_id", "gene_id", F.round(dynamics.decay(F.col("prot"), F.col("d1"), F.lit(6.0)), 6).alias("prot"))


@query(_STATE + "SELECT cell_id, gene_id, round(kon + (prot - kon) * exp(-d1 * 0.5), 6) + 0 AS prot FROM st")
def ode_step(spark: SparkSession, folder: str) -> DataFrame:
    p = dynamics.ode_step(F.col("prot"), F.col("kon"), F.lit(1.0), F.col("d1"), F.lit(0.5))
    return states(spark, folder).select("cell_id", "gene_id", F.round(p, 6).alias("prot"))


@query(_STATE + "SELECT gene_id, time_h, round(avg(d1 * (kon - prot)), 6) + 0 AS velocity FROM st GROUP BY gene_id, time_h")
def velocity(spark: SparkSession, folder: str) -> DataFrame:
    v = dynamics.velocity(F.col("prot"), F.col("kon"), F.col("d1"))
    return rounded(states(spark, folder).groupBy("gene_id", "time_h").agg(F.avg(v).alias("velocity")), "velocity")


@query(", w AS (SELECT cell_id, gene_id, x, pow(abs(x - 20.0) / 40.0, 2) AS a FROM x) SELECT cell_id, gene_id, round(x * (1 - a / (1 + a)) + 20 * (a / (1 + a)), 6) + 0 AS x FROM w")
def shrink_to_mode(spark: SparkSession, folder: str) -> DataFrame:
    s = trajectory.shrunk_to_mode(F.col("x").cast("double"), F.lit(20.0))
    return base.counts(spark, folder).select("cell_id", "gene_id", F.round(s, 6).alias("x"))


@query(""", md AS (SELECT cell_id, gene_id, x / 20.0 AS x, CASE WHEN x > 5 THEN 1.0 ELSE 0.1 END AS level FROM x),
s AS (SELECT cell_id, gene_id, level, x * (1 - a / (1 + a)) + level * (a / (1 + a)) AS s FROM (SELECT *, pow(abs(x - level) / (2 * level), 2) AS a FROM md)),
gn AS (SELECT gene_id, min(s) AS zero, max(s) - min(s) AS top, min(level) AS low, max(level) AS high, count(DISTINCT level) AS l FROM s GROUP BY gene_id),
en AS (SELECT gene_id, level, min(s) AS f, max(s) AS t, dense_rank() OVER (PARTITION BY gene_id ORDER BY level) - 1 AS z FROM s GROUP BY gene_id, level),
b AS (SELECT gene_id, level, zero, low, high, l, z, least(f - zero, top / (1 + l - z)) AS f, greatest(t - zero, top / (l - z)) AS t FROM en JOIN gn USING (gene_id))
SELECT cell_id, gene_id, round(low + (high - low) * (z + sqrt(least(greatest(s - zero, f), t) / (t + 1e-16))) / l, 6) + 0 AS prot FROM s JOIN b USING (gene_id, level)""")
def init_from_mode(spark: SparkSession, folder: str) -> DataFrame:
    rows = base.counts(spark, folder).select("cell_id", "gene_id", (F.col("x") / 20.0).alias("x"), F.when(F.col("x") > 5, 1.0).otherwise(0.1).alias("level"))
    return rounded(trajectory.initial_states(rows), "prot")


_MEAN = _STATE + ", mt AS (SELECT dataset, gene_id, time_h, avg(prot) AS prot FROM st GROUP BY ALL) "


@query(_MEAN + "SELECT dataset, gene_id, time_h, round(nt, 6) + 0 AS next_time, round(nv - prot, 6) + 0 AS step FROM (SELECT *, lead(time_h) OVER w AS nt, lead(prot) OVER w AS nv FROM mt WINDOW w AS (PARTITION BY dataset, gene_id ORDER BY time_h)) WHERE nt IS NOT NULL")
def join_next_time(spark: SparkSession, folder: str) -> DataFrame:
    """Mean states of each dataset paired with those of the next time."""
    m = states(spark, folder).groupBy("dataset", "gene_id", "time_h").agg(F.avg("prot").alias("prot"))
    n = trajectory.next_time(m, ["dataset", "gene_id"], "time_h", "prot")
    return n.select("dataset", "gene_id", "time_h", F.round("next_time", 6).alias("next_time"), (F.round(F.col("next_value") - F.col("prot"), 6) + 0.0).alias("step"))


@query(""", w AS (SELECT DISTINCT CAST(round(rd * 50, 1) AS DOUBLE) AS time FROM cell WHERE rd IS NOT NULL), k AS (SELECT DISTINCT time_h AS known_time FROM cell WHERE time_h IS NOT NULL)
SELECT time, arg_min(known_time, {'d': round(abs(time - known_time), 9), 'k': known_time}) AS known_time FROM w CROSS JOIN k GROUP BY time""")
def join_nearest_time(spark: SparkSession, folder: str) -> DataFrame:
    """Times made of the depth factors, each with the nearest measured time."""
    c = base.cells(spark, folder)
    wanted = c.filter("rd is not null").select(F.round(F.col("rd") * 50, 1).alias("time")).distinct()
    return trajectory.nearest_time(wanted, c.filter("time_h is not null").select(F.col("time_h").alias("known_time")).distinct())


@query(_STATE + """, kt AS (SELECT cell_id * 1000 + gene_id AS key, prot, d1, CASE WHEN time_h < 36 THEN 1.0 ELSE 0.0 END AS goal FROM st), g AS (SELECT kt.*, i / 25 AS t FROM kt, (SELECT unnest(range(1, 26)) AS i))
SELECT key, coalesce(min(t) FILTER (abs(goal + (prot - goal) * exp(-d1 * t * 12) - goal) < abs(goal + (prot - goal) * exp(-d1 * t * 12) - prot)), 1) AS alpha FROM g GROUP BY key""")
def update_alpha(spark: SparkSession, folder: str) -> DataFrame:
    """The part of 12 hours after which each state is nearer to its goal than to its start."""
    rows = states(spark, folder).select(
        (F.col("cell_id") * 1000 + F.col("gene_id")).alias("key"), F.col("prot").alias("start"), "d1", F.when(F.col("time_h") < 36, 1.0).otherwise(0.0).alias("end")
    )
    return trajectory.switch_fraction(rows, 25, lambda t: trajectory.relaxed(F.col("start"), F.col("end"), F.col("d1"), t * 12))


@query(_STATE + "SELECT gene_id, round(avg(-(kon * ln(least(greatest(prot, 1e-6), 1 - 1e-6)) + (1 - kon) * ln(1 - least(greatest(prot, 1e-6), 1 - 1e-6)))), 6) + 0 AS loss FROM st GROUP BY gene_id")
def fit_error(spark: SparkSession, folder: str) -> DataFrame:
    loss = network.cross_entropy(F.col("prot"), F.col("kon"))
    return rounded(states(spark, folder).groupBy("gene_id").agg(F.avg(loss).alias("loss")), "loss")


@query(_STATE + """, ed AS (SELECT s.gene_id AS src, t.gene_id AS tgt, avg(w) AS w FROM ref_network JOIN genes s ON s.gene_name = index_name JOIN genes t ON t.gene_name = ref_network.tgt WHERE w IS NOT NULL GROUP BY ALL),
pl AS (SELECT cell_id, tgt, sum(prot * w) AS s FROM st JOIN ed ON ed.src = st.gene_id GROUP BY ALL), tg AS (SELECT DISTINCT tgt FROM ed)
SELECT c.cell_id, tgt, round(0.1 * (1 - 1 / (1 + exp(-(-1 + coalesce(s, 0))))) + 1 / (1 + exp(-(-1 + coalesce(s, 0)))), 6) + 0 AS kon FROM (SELECT DISTINCT cell_id FROM st) c CROSS JOIN tg LEFT JOIN pl USING (cell_id, tgt)""")
def kon(spark: SparkSession, folder: str) -> DataFrame:
    """Mode values of the prior networks' targets in every cell."""
    edges = _edges(spark, folder)
    targets = edges.select("tgt").distinct()
    k = network.kon(states(spark, folder), edges, targets.withColumn("b", F.lit(-1.0)), "cell_id", targets.withColumn("low", F.lit(0.1)))
    return rounded(k, "kon")


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    g = base.genes(spark, folder)
    s, t = g.select(F.col("gene_id").alias("src"), F.col("gene_name").alias("index_name")), g.select(F.col("gene_id").alias("t"), F.col("gene_name").alias("tgt"))
    return read(spark, folder, "ref_network").join(s, "index_name").join(t, "tgt").filter("w is not null").groupBy("src", F.col("t").alias("tgt")).agg(F.avg("w").alias("w"))


def to_fit(spark: SparkSession, folder: str, at: float | None = None) -> tuple[DataFrame, fit.Panel, list[int]]:
    """Cells as ``fit.cells_to_fit`` makes them from the mixture of their own counts, the panel, and its genes.

    With ``at`` only cells of that time are made; the mixture is that of all.
    """
    # Counts are used three times; those of the cells wanted are marked while counts lie by cell.
    cells = base.cells(spark, folder)
    counts = cut(base.counts(spark, folder) if at is None else base.counts(spark, folder).join(cells.select("cell_id", F.col("time_h").eqNullSafe(F.lit(at)).alias("wanted")), "cell_id"))
    genes = sorted(r[0] for r in counts.select("gene_id").distinct().filter("gene_id > 0").collect())
    hist = cut(compare.histogram(counts, cells, ["time_h"]))
    mixed = cut(mixture.fit_mixtures(hist))
    levels = cut(fit.count_levels(mixture.assign_modes(hist, mixed), mixed))
    times = sorted(r[0] for r in cells.select("time_h").dropna().distinct().collect())
    panel = fit.panel_of(mixed, genes, base.genes(spark, folder), times)
    if at is None:
        return cut(fit.cells_to_fit(counts, cells, levels, genes)), panel, genes
    here = F.col("time_h") == at
    return cut(fit.cells_to_fit(counts.filter("wanted"), cells.filter(here), levels.filter(here), genes).select("cell_id", "time_h", "prot")), panel, genes


def named(edges: DataFrame, genes: list[int]) -> DataFrame:
    """``src, tgt, w`` by position as those by gene; -1 stays the intercept."""
    ids = F.array(*[F.lit(g) for g in (0, *genes)])
    return edges.select(F.when(F.col("src") < 0, F.col("src")).otherwise(F.get(ids, "src")).alias("src"), F.get(ids, "tgt").alias("tgt"), "w")


@query()
def propagate_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """The cells that trajectories go through at all times of their sample, by unbalanced transport, with their states."""
    cells, panel, _ = to_fit(spark, folder)
    return fit.fit_network(cells, panel, least_rounds=1, most_rounds=1, modes=False).trajectories.select("sample_id", "id", "t", "cell", "prot")


@query()
def infer_network(spark: SparkSession, folder: str) -> DataFrame:
    """Edges into each gene of the panel: penalised regression of its mode on the states of all genes, itself included, over all cells."""
    cells, panel, genes = to_fit(spark, folder)
    found = network.fit_rows(cells.select("prot", "kon", F.lit(1.0).alias("weight")), panel.scale, panel.low)
    return named(fit.Fit(found, cells, []).edges(spark), genes)


@query()
def refine_network(spark: SparkSession, folder: str) -> DataFrame:
    """The edges of ``infer_network``, each made larger or smaller where it fits better."""
    cells, panel, genes = to_fit(spark, folder)
    rows = cells.select("prot", "kon", F.lit(1.0).alias("weight"))
    found = network.fit_rows(rows, panel.scale, panel.low)
    return named(fit.Fit(network.refined_rows(rows, found, panel.low), cells, []).edges(spark), genes)


def _network(spark: SparkSession, folder: str, genes: list[int]) -> dynamics.Network:
    """The mean prior network over the panel; panel squared numbers come to the driver."""
    at = {g: i for i, g in enumerate((0, *genes))}
    w, d1 = np.zeros((len(at), len(at))), np.full(len(at), 0.05)
    for r in _edges(spark, folder).filter(F.col("src").isin(list(at)) & F.col("tgt").isin(genes)).collect():
        w[at[r["src"]], at[r["tgt"]]] = r["w"]
    for r in base.genes(spark, folder).filter(F.col("gene_id").isin(list(at)) & F.col("d1").isNotNull()).collect():
        d1[at[r["gene_id"]]] = max(r["d1"], 1e-3)
    return dynamics.Network(w, np.full(len(at), -1.0), np.full(len(at), 0.1), d1, d1 * 5)


def _starts(cells: DataFrame) -> DataFrame:
    n = F.size("prot") - 1
    return cells.filter("time_h = 0").select("cell_id", F.concat(F.array(F.lit(1.0)), F.slice("prot", F.lit(2), n)).alias("prot"))


@query()
def ode_simulate(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell of time 0, simulated over 24 hours."""
    cells, panel, genes = to_fit(spark, folder)
    return dynamics.simulate(_starts(cells), _network(spark, folder, genes), [t for t in panel.times if t <= 24])


@query()
def jump_simulate(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a jump process."""
    cells, panel, genes = to_fit(spark, folder)
    return dynamics.simulate(_starts(cells), _network(spark, folder, genes), [t for t in panel.times if t <= 12], jumps=True)


@query()
def perturb(spark: SparkSession, folder: str) -> DataFrame:
    """Mean state of each gene under each perturbation of the list at every time of the data, over all cells of time 0 of its dataset.

    ``combo_id, dataset, time_h, gene_id, prot, n_cells, unknown, reason``.
    ``unknown`` lists the names that are no gene of the panel; they are left
    out, the others act. A gene in both lists is held on, which comes last. A
    combination that can't be simulated is one row with its ``reason``.
    """
    cells, _, genes = to_fit(spark, folder, 0.0)
    ids = spark.createDataFrame([(g, i + 1) for i, g in enumerate(genes)], "gene_id int, at int")
    # Genes go by their position in the panel.
    panel = base.genes(spark, folder).join(F.broadcast(ids), "gene_id").select("gene_name", F.col("at").alias("gene_id"))
    listed = read(spark, folder, "ko_ov_list").select("combo_id", "dataset", "ko", "ov").distinct().select("combo_id", "dataset", split_packed("ko").alias("ko"), split_packed("ov").alias("ov"))
    key = ["combo_id", "dataset"]
    each = listed.select(*key, F.explode(F.concat(F.transform("ko", lambda g: F.struct(F.lit(False).alias("up"), g.alias("gene_name"))), F.transform("ov", lambda g: F.struct(F.lit(True).alias("up"), g.alias("gene_name"))))).alias("g")).select(*key, "g.*")
    each = each.join(F.broadcast(panel), "gene_name", "left").groupBy(F.col("combo_id").alias("c"), F.col("dataset").alias("d")).agg(
        F.array_sort(F.collect_set(F.when(~F.col("up"), F.col("gene_id")))).alias("off"), F.array_sort(F.collect_set(F.when(F.col("up"), F.col("gene_id")))).alias("on"),
        F.array_sort(F.collect_set(F.when(F.col("gene_id").isNull(), F.col("gene_name")))).alias("unknown"),
    )
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    known = listed.select(*key).distinct().join(each, (F.col("combo_id") == F.col("c")) & F.col("dataset").eqNullSafe(F.col("d")), "left").select(*key, empty("off", "array<int>"), empty("on", "array<int>"), empty("unknown", "array<string>"))
    first = base.cells(spark, folder).filter("time_h = 0 and dataset is not null").select("cell_id", "dataset")
    starts = cut(first.join(_starts(cells), "cell_id"))
    there = starts.select(F.col("dataset").alias("d"), F.lit(True).alias("there")).distinct()
    reason = F.when(F.size("off") + F.size("on") + F.size("unknown") == 0, "no genes listed").when(F.size("off") + F.size("on") == 0, "no gene of the panel").when(F.col("there").isNull(), "no cells of time 0")
    known = known.withColumn("off", F.array_except("off", "on")).join(F.broadcast(there), F.col("dataset") == F.col("d"), "left").withColumn("reason", reason).drop("d", "there")
    known = cut(known.withColumn("set_id", F.xxhash64("dataset", "off", "on")))
    times = sorted(r[0] for r in base.cells(spark, folder).select("time_h").dropna().distinct().collect())
    sets = known.filter("reason is null").select("set_id", "dataset", "off", "on").distinct()
    means = dynamics.perturbed_means(starts, sets, _network(spark, folder, genes), times)
    done = known.filter("reason is null").drop("reason").join(means, "set_id").select(*key, "time_h", F.posexplode("prot").alias("at", "prot"), "n_cells", "unknown", F.lit(None).cast("string").alias("reason")).filter("at > 0")
    done = done.join(F.broadcast(ids), "at").select(*key, "time_h", "gene_id", "prot", "n_cells", "unknown", "reason")
    return done.unionByName(known.filter("reason is not null").select(*key, "unknown", "reason"), allowMissingColumns=True)


_PAIR = _MEAN + ", pr AS (SELECT gene_id, prot AS p0, nv AS p1, nt - time_h AS dt, CASE WHEN nv > prot THEN 1.0 ELSE 0.0 END AS kon FROM (SELECT *, lead(time_h) OVER w AS nt, lead(prot) OVER w AS nv FROM mt WINDOW w AS (PARTITION BY dataset, gene_id ORDER BY time_h)) WHERE nt IS NOT NULL) "


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    m = states(spark, folder).groupBy("dataset", "gene_id", "time_h").agg(F.avg("prot").alias("prot"))
    n = trajectory.next_time(m, ["dataset", "gene_id"], "time_h", "prot")
    return n.select("gene_id", F.col("prot").alias("p0"), F.col("next_value").alias("p1"), (F.col("next_time") - F.col("time_h")).alias("dt"), F.when(F.col("next_value") > F.col("prot"), 1.0).otherwise(0.0).alias("kon"))


@query(_PAIR + """, y AS (SELECT gene_id, dt, CASE WHEN abs(p0 - kon) > 1e-3 AND (p1 - kon) / nullif(p0 - kon, 0) > 1e-6 THEN -ln((p1 - kon) / nullif(p0 - kon, 0)) END AS y FROM pr)
SELECT gene_id, round(greatest(sum(y * dt) / nullif(sum(dt * dt) FILTER (y IS NOT NULL), 0), 0), 6) + 0 AS d1 FROM y GROUP BY gene_id""")
def learn_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Decay rates from mean states of consecutive times."""
    return rounded(dynamics.learned_rates(_pairs(spark, folder)), "d1")


@query(_PAIR + """, re AS (SELECT gene_id, pow(p1 - p0, 2) AS r, dt AS e FROM pr), ed AS (SELECT gene_id, quantile_cont(r, 0.9) AS edge FROM re GROUP BY gene_id)
SELECT gene_id, round(greatest(sum(r) / sum(e) - coalesce(sum(r) FILTER (r <= edge) / sum(e) FILTER (r <= edge), 0), 0.01), 6) + 0 AS noise FROM re JOIN ed USING (gene_id) GROUP BY gene_id""")
def noise_ratio(spark: SparkSession, folder: str) -> DataFrame:
    p = _pairs(spark, folder).select("gene_id", (F.col("p1") - F.col("p0")).alias("residual"), F.col("dt").alias("expected"))
    return rounded(dynamics.noise_ratio(p), "noise")


_KNOWN = ", kn AS (SELECT gene_name AS known, d1 AS v FROM genes WHERE d1 IS NOT NULL AND gene_name IS NOT NULL), nm AS (SELECT DISTINCT gene AS name FROM gene_list WHERE trim(gene) <> ''), tr AS (SELECT name, substr(name, 1, CAST(floor(length(name) * (10 - i) / 10) AS INT)) AS part FROM nm, (SELECT unnest(range(0, 10)) AS i)), mt AS (SELECT name, part, count(*) AS n_known, avg(v) AS value FROM (SELECT DISTINCT name, part FROM tr WHERE part <> '') JOIN kn ON starts_with(known, part) GROUP BY ALL), bs AS (SELECT name, arg_max({'p': part, 'n': n_known, 'v': value}, length(part)) AS b FROM mt GROUP BY name) "


@query(_KNOWN + "SELECT name, coalesce(b.p, '') AS matched, coalesce(b.n, (SELECT count(*) FROM kn)) AS n_known, round(coalesce(b.v, (SELECT avg(v) FROM kn)), 6) + 0 AS value FROM nm LEFT JOIN bs USING (name)")
def join_prefix_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """A rate for every listed name, by the longest prefix that known genes share."""
    known = base.genes(spark, folder).filter("d1 is not null and gene_name is not null").select(F.col("gene_name").alias("known"), F.col("d1").alias("v"))
    names = read(spark, folder, "gene_list").filter(F.trim("gene") != "").select(F.col("gene").alias("name")).distinct()
    return rounded(trajectory.prefix_fallback(names, known, "v"), "value")


@query()
def alternate_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Trajectories, network, switch times and modes by turns until at rest: the edges, with the error of the last turn and the number of turns."""
    cells, panel, genes = to_fit(spark, folder)
    found = fit.fit_network(cells, panel)
    return named(found.edges(spark), genes).withColumns({"error": F.lit(found.errors[-1] if found.errors else None).cast("double"), "turns": F.lit(len(found.errors))})


@query()
def infer_test(spark: SparkSession, folder: str) -> DataFrame:
    """``part, turns, error``: how well the network that the train cells give holds on their own and on the test cells' trajectories.

    The network is the regression on the train cells' own states; each part has
    its switch times and modes fitted in at most six turns. The mixture behind
    the states is that of all cells (the pipeline's is of the train cells).
    """
    cells, panel, _ = to_fit(spark, folder)
    part = cut(selection.split_train_test(base.cells(spark, folder)).select("cell_id", "part"))
    both = cut(cells.join(part, "cell_id"))
    train = both.filter("part = 'train'")
    found = network.fit_rows(train.select("prot", "kon", F.lit(1.0).alias("weight")), panel.scale, panel.low)
    rows = []
    for name in ("train", "test"):
        done = fit.fit_network(both.filter(F.col("part") == name), panel, fixed=fit.Network(found.w, found.b), least_rounds=3, most_rounds=6)
        rows.append((name, len(done.errors), done.errors[-1] if done.errors else None))
    return spark.createDataFrame(rows, "part string, turns int, error double")


@query()
def refit_trajectories(spark: SparkSession, folder: str) -> DataFrame:
    """The trajectories of one turn, with their states made anew on the modes' own levels."""
    cells, panel, _ = to_fit(spark, folder)
    found = fit.fit_network(cells, panel, least_rounds=1, most_rounds=1, modes=False)
    return fit.unit_trajectories(found.trajectories, panel).select("sample_id", "id", "t", "cell", "prot")
