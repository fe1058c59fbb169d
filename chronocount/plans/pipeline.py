"""The whole analysis as steps over tables.

Each step is a function of the session, the folder of input tables and the
folder of results; it reads tables and writes tables, so a run can be taken up
at any step. ``python -m chronocount.plans.pipeline INPUT OUTPUT [STEP...]``.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronocount.operators import compare, depth, dynamics, fit, mixture, network, selection
from chronocount.plans import base
from chronocount.plans.dynamics_queries import named
from chronocount.session import cut, read, release
from chronocount.sources.text import sink_tables


def validate(spark: SparkSession, source: str) -> None:
    """Raises ValueError unless the tables are there and hold two times at least."""
    times = base.cells(spark, source).select("time_h").dropna().distinct().count()
    if times < 2:
        raise ValueError(f"cells have {times} different times; two are needed")


def depth_step(spark: SparkSession, source: str, out: str) -> None:
    """rd: depth factors from the genes that depth alone explains."""
    counts, cells = base.counts(spark, source), base.cells(spark, source)
    sink_tables({"rd": depth.read_depth(counts, cells, depth.poisson_genes(counts, cells))}, out)


def split_step(spark: SparkSession, source: str, out: str) -> None:
    """split: train and test part of every cell."""
    sink_tables({"split": selection.split_train_test(base.cells(spark, source)).select("cell_id", "part")}, out)


def _corrected(spark: SparkSession, source: str, out: str) -> DataFrame:
    return depth.depth_corrected(base.counts(spark, source), spark.read.parquet(f"{out}/rd.parquet"))


def _part(spark: SparkSession, source: str, out: str, part: str) -> DataFrame:
    """The cells of the train or test part."""
    return base.cells(spark, source).join(spark.read.parquet(f"{out}/split.parquet").filter(F.col("part") == part), "cell_id", "left_semi")


def _histogram(spark: SparkSession, source: str, out: str) -> DataFrame:
    """Counts over depth of the train cells, by gene and time."""
    return compare.histogram(_corrected(spark, source, out), _part(spark, source, out, "train"), ["time_h"])


def mixture_step(spark: SparkSession, source: str, out: str) -> None:
    """mixture: two modes per gene, on the train cells' counts over depth."""
    sink_tables({"mixture": mixture.fit_mixtures(_histogram(spark, source, out))}, out)


def modes_step(spark: SparkSession, source: str, out: str) -> None:
    """modes: the mode of every (gene, time, count) of the train cells."""
    sink_tables({"modes": mixture.assign_modes(_histogram(spark, source, out), spark.read.parquet(f"{out}/mixture.parquet"))}, out)


def selection_step(spark: SparkSession, source: str, out: str) -> None:
    """selected: genes that vary over time or between types, among the train cells."""
    cells, modes = _part(spark, source, out, "train"), spark.read.parquet(f"{out}/modes.parquet").filter("mode > 0 and x > 0")
    up = _corrected(spark, source, out).join(cells.select("cell_id", "time_h"), "cell_id").join(modes.select("gene_id", "time_h", "x"), ["gene_id", "time_h", "x"], "left_semi").select("cell_id", "gene_id")
    sink_tables({"selected": selection.select_de_genes(selection.temporal_variation(up, cells), selection.celltype_variation(up, cells))}, out)


def _genes(spark: SparkSession, out: str) -> list[int]:
    """The selected genes in order; position i + 1 of the states' arrays is the i-th of them, position 0 the stimulus."""
    found = sorted(r[0] for r in spark.read.parquet(f"{out}/selected.parquet").filter("gene_id > 0").select("gene_id").distinct().collect())
    if not found:
        raise ValueError("no gene was selected")
    return found


def states_step(spark: SparkSession, source: str, out: str) -> None:
    """levels: what each count of a (gene, time) means in units of the modes; states, test_states: arrays of the train and test cells over the stimulus and the selected genes."""
    table = lambda t: spark.read.parquet(f"{out}/{t}.parquet")
    sink_tables({"levels": fit.count_levels(table("modes"), table("mixture"))}, out)
    rows = lambda part: fit.cells_to_fit(_corrected(spark, source, out), _part(spark, source, out, part), table("levels"), _genes(spark, out))
    sink_tables({"states": rows("train"), "test_states": rows("test")}, out)


def _times(spark: SparkSession, source: str) -> list[float]:
    return sorted(r[0] for r in base.cells(spark, source).select("time_h").dropna().distinct().collect())


def _panel(spark: SparkSession, source: str, out: str) -> fit.Panel:
    """The selected genes' panel, with the prior network of the edge list as the edges' scale."""
    genes = _genes(spark, out)
    listed = base.genes(spark, source).filter(F.col("gene_id").isin(genes))
    edges = network.signed_edges(read(spark, source, "neko_edges"), "edge_id", "src", "tgt", "effect")
    pairs = network.prior_paths(edges, listed.filter("gene_name is not null").select(F.col("gene_name").alias("node")))
    none = listed.limit(0).select("gene_id")
    mask = network.prior_mask(network.prior_matrix(pairs, listed), none)
    return fit.panel_of(spark.read.parquet(f"{out}/mixture.parquet"), genes, base.genes(spark, source), _times(spark, source), mask)


def network_step(spark: SparkSession, source: str, out: str) -> None:
    """edges, trajectories, errors: the network fitted by turns on the train cells, the trajectories it rests on, the error of every turn."""
    found = fit.fit_network(spark.read.parquet(f"{out}/states.parquet"), _panel(spark, source, out))
    errors = spark.createDataFrame(list(enumerate(found.errors, 1)), "turn int, error double")
    sink_tables({"edges": named(found.edges(spark), _genes(spark, out)), "trajectories": found.trajectories, "errors": errors}, out)


def _edges(spark: SparkSession, out: str, table: str) -> fit.Network:
    """The weights of an edge table by position; selected genes squared."""
    at = {g: i for i, g in enumerate((0, *_genes(spark, out)))}
    w, b = np.zeros((len(at), len(at))), np.zeros(len(at))
    for r in spark.read.parquet(f"{out}/{table}.parquet").collect():
        if r["src"] < 0:
            b[at[r["tgt"]]] = r["w"]
        else:
            w[at[r["src"]], at[r["tgt"]]] = r["w"]
    return fit.Network(w, b)


def adapt_step(spark: SparkSession, source: str, out: str) -> None:
    """unit_edges, rates: the network made anew on states of the modes' own levels, held near the first one, and each gene's decay and ratio of noise."""
    panel, genes, net = _panel(spark, source, out), _genes(spark, out), _edges(spark, out, "edges")
    paths = cut(fit.unit_trajectories(spark.read.parquet(f"{out}/trajectories.parquet"), panel))
    half = network.default_strength(len(panel.low)) / 2
    found = network.fit_rows(cut(fit.weighted(paths)), panel.scale, panel.low, start=net, reference=net, strength=half, ridge=half)
    sink_tables({"unit_edges": named(fit.Fit(found, paths, []).edges(spark), genes)}, out)
    sink_tables({"rates": fit.rates_of(paths, fit.Network(found.w, found.b), panel, genes)}, out)


def test_step(spark: SparkSession, source: str, out: str) -> None:
    """test_errors: the error of the network on trajectories of the test cells, turn by turn, and on those of the train cells in the end."""
    done = fit.fit_network(spark.read.parquet(f"{out}/test_states.parquet"), _panel(spark, source, out), fixed=_edges(spark, out, "edges"))
    last = spark.read.parquet(f"{out}/errors.parquet").orderBy(F.col("turn").desc()).limit(1)
    rows = spark.createDataFrame(list(enumerate(done.errors, 1)), "turn int, error double").select(F.lit("test").alias("part"), "turn", "error")
    sink_tables({"test_errors": rows.unionByName(last.select(F.lit("train").alias("part"), "turn", "error"))}, out)


def simulation_step(spark: SparkSession, source: str, out: str) -> None:
    """simulated: mean states of the selected genes at all times of the data, from the train cells of the first one under the edges and rates found."""
    genes, panel, net = _genes(spark, out), _panel(spark, source, out), _edges(spark, out, "unit_edges")
    at, d1, ratio = {g: i + 1 for i, g in enumerate(genes)}, panel.d1.copy(), np.full(len(genes) + 1, 5.0)
    for r in spark.read.parquet(f"{out}/rates.parquet").collect():
        d1[at[r["gene_id"]]], ratio[at[r["gene_id"]]] = r["d1"], r["ratio"]
    sim = dynamics.Network(net.w, net.b, panel.low, d1, d1 * ratio)
    starts = spark.read.parquet(f"{out}/states.parquet").filter(F.col("time_h") == panel.times[0]).select("cell_id", F.concat(F.array(F.lit(1.0)), F.slice("prot", 2, len(genes))).alias("prot"))
    path = dynamics.simulate(starts, sim, panel.times).select("time_h", F.posexplode("prot").alias("at", "prot")).filter("at > 0")
    ids = F.array(*[F.lit(g) for g in (0, *genes)])
    sink_tables({"simulated": path.groupBy("time_h", F.get(ids, "at").alias("gene_id")).agg(F.avg("prot").alias("prot"))}, out)


def check_step(spark: SparkSession, source: str, out: str) -> None:
    """checked: for each selected gene and time the mean state of the train cells' trajectories and of the simulation."""
    genes = _genes(spark, out)
    ids, times = F.array(*[F.lit(g) for g in (0, *genes)]), F.array(*[F.lit(t) for t in _times(spark, source)])
    paths = fit.unit_trajectories(spark.read.parquet(f"{out}/trajectories.parquet"), _panel(spark, source, out))
    seen = paths.select(F.get(times, "t").alias("time_h"), F.posexplode("prot").alias("at", "prot")).filter("at > 0").groupBy("time_h", F.get(ids, "at").alias("gene_id")).agg(F.avg("prot").alias("seen"))
    sink_tables({"checked": seen.join(spark.read.parquet(f"{out}/simulated.parquet"), ["time_h", "gene_id"])}, out)


STEPS: dict[str, Callable[[SparkSession, str, str], None]] = {
    "depth": depth_step, "split": split_step, "mixture": mixture_step, "modes": modes_step, "selection": selection_step,
    "states": states_step, "network": network_step, "adapt": adapt_step, "test": test_step, "simulation": simulation_step, "check": check_step,
}


def run(spark: SparkSession, source: str, out: str, steps: list[str] | None = None) -> None:
    """All steps in order, or those named; stops at the first that fails."""
    unknown = set(steps or ()) - set(STEPS)
    if unknown:
        raise ValueError(f"no such steps: {', '.join(sorted(unknown))}; there are {', '.join(STEPS)}")
    validate(spark, source)
    for name, step in STEPS.items():
        if not steps or name in steps:
            step(spark, source, out)


if __name__ == "__main__":
    if len(sys.argv) < 3:
        sys.exit(__doc__)
    session = SparkSession.builder.appName("chronocount").getOrCreate()
    run(session, sys.argv[1], sys.argv[2], sys.argv[3:] or None)
    release(session)
