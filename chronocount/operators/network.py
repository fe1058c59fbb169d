"""The signed, weighted, directed network of genes; gene 0 is the stimulus.

Edges are rows ``src, tgt, w``, intercepts are rows ``tgt, b``.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocount.operators.selection import quantiles
from chronocount.session import cut

# What names an inhibiting effect, anywhere in it or at the beginning of a word.
INHIBITION, INHIBITION_WORDS = "inhibit", ("repression", "repress", "negative", "downregulat", "antagonis")

#: Levels (rows times targets) that a task holds at once.
VALUES = 2**19
#: Rows whose pairs of positions are held at once.
PAIRED = 128


def effect_sign(effect: str) -> Column:
    """-1 for an inhibiting effect, else 1; null and unknown effects are 1."""
    low = F.lower(F.coalesce(F.col(effect), F.lit("")))
    return F.when(low.contains(INHIBITION) | low.rlike(rf"\b({'|'.join(INHIBITION_WORDS)})"), F.lit(-1)).otherwise(F.lit(1))


def signed_edges(edges: DataFrame, key: str, src: str, tgt: str, effect: str) -> DataFrame:
    """``key, src, tgt, sign``: each edge once; edges without an end are left out."""
    few = edges.select(F.col(key).alias("key"), F.trim(src).alias("src"), F.trim(tgt).alias("tgt"), effect_sign(effect).alias("sign"))
    return few.filter("src <> '' and tgt <> ''").groupBy("key", "src", "tgt").agg(F.max("sign").alias("sign"))


def graph_reach(edges: DataFrame, sources: DataFrame, longest: int) -> DataFrame:
    """``src, node, dist``: shortest distance, up to ``longest``, from each of ``sources`` (column src) along edges; the source itself is 0.

    Breadth first, one join a level; a node already reached is not walked from again.
    """
    steps = edges.select(F.col("src").alias("node"), F.col("tgt").alias("to")).distinct()
    front = sources.select("src").distinct().select("src", F.col("src").alias("node"), F.lit(0).alias("dist"))
    reached = front
    for level in range(1, longest + 1):
        near = front.join(steps, "node").select("src", F.col("to").alias("node")).distinct()
        front = cut(near.join(reached.select("src", "node"), ["src", "node"], "left_anti").withColumn("dist", F.lit(level)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    return reached


def prior_paths(edges: DataFrame, listed: DataFrame, longest: int = 3) -> DataFrame:
    """``src, tgt, sign, dist`` for pairs of ``listed`` nodes (column node) within ``longest`` steps.

    A direct edge gives its sign (of parallel ones the one with the largest
    ``key``); else the sign of the mean over all shortest paths without a listed
    node inside, 0 counting as 1. Carried are numbers of positive and negative
    paths by node, not the paths.
    """
    names = listed.select("node").distinct()
    direct = (
        edges.join(names.withColumnRenamed("node", "src"), "src", "left_semi").join(names.withColumnRenamed("node", "tgt"), "tgt", "left_semi")
        .filter("src <> tgt").groupBy("src", "tgt").agg(F.max_by("sign", "key").alias("sign")).withColumn("dist", F.lit(1))
    )
    step = edges.filter("src <> tgt").groupBy(F.col("src").alias("node"), F.col("tgt").alias("to")).agg(
        F.sum((F.col("sign") > 0).cast("double")).alias("p"), F.sum((F.col("sign") < 0).cast("double")).alias("q")
    )
    front = names.select(F.col("node").alias("src"), "node", F.lit(1.0).alias("pos"), F.lit(0.0).alias("neg"))
    seen, found = front.select("src", "node"), []
    for level in range(1, longest + 1):
        walked = front.join(step, "node").groupBy("src", F.col("to").alias("node")).agg(
            F.sum(F.col("pos") * F.col("p") + F.col("neg") * F.col("q")).alias("pos"), F.sum(F.col("pos") * F.col("q") + F.col("neg") * F.col("p")).alias("neg")
        )
        new = cut(walked.join(seen, ["src", "node"], "left_anti"))
        seen = seen.unionByName(new.select("src", "node"))
        if level > 1:
            found.append(new.join(names, "node", "left_semi").select("src", F.col("node").alias("tgt"), F.when(F.col("pos") >= F.col("neg"), 1).otherwise(-1).alias("sign"), F.lit(level).alias("dist")))
        front = new.join(names, "node", "left_anti")
    return reduce(DataFrame.unionByName, [direct, *found])


def prior_matrix(pairs: DataFrame, genes: DataFrame) -> DataFrame:
    """``src, tgt, w`` over the square of ``genes`` (gene_id, gene_name), src also the stimulus 0.

    A positive pair is 1. A gene is known if any pair names it: pairs into known
    genes that aren't positive are 0, pairs into unknown ones 1. The diagonal is
    1, the stimulus' row 0. Genes without a name are unknown.
    """
    ids = genes.filter("gene_id > 0").groupBy("gene_id").agg(F.min("gene_name").alias("name"))
    known = pairs.select(F.explode(F.array("src", "tgt")).alias("name")).distinct().withColumn("known", F.lit(True))
    all_ = ids.join(known, "name", "left").select("gene_id", "name", F.coalesce("known", F.lit(False)).alias("known"))
    positive = pairs.filter("sign > 0").select("src", "tgt").distinct()
    s, t = all_.select(F.col("gene_id").alias("s"), F.col("name").alias("src")), all_.select(F.col("gene_id").alias("t"), F.col("name").alias("tgt"))
    good = positive.join(s, "src").join(t, "tgt").select("s", "t", F.lit(True).alias("good"))
    # The result's own size: genes squared.
    sources = all_.select("gene_id").unionByName(all_.sparkSession.range(1).select(F.lit(0).cast("int").alias("gene_id"))).agg(F.collect_set("gene_id").alias("all"))
    grid = all_.select(F.col("gene_id").alias("tgt"), "known").join(F.broadcast(sources)).select("tgt", "known", F.explode("all").alias("src"))
    both = grid.join(good, (F.col("src") == F.col("s")) & (F.col("tgt") == F.col("t")), "left")
    w = F.when(F.col("src") == 0, 0.0).when(F.col("src") == F.col("tgt"), 1.0).when(F.col("good") | ~F.col("known"), 1.0).otherwise(0.0)
    return both.select("src", "tgt", w.alias("w"))


def prior_mask(prior: DataFrame, single_mode: DataFrame, stimulus: float = 0.2, floor: float = 1.0) -> DataFrame:
    """``src, tgt, m``: max(floor, |w|), the stimulus' row at its own value, rows and columns of genes with one mode (``single_mode``: gene_id) at 0."""
    one = single_mode.select("gene_id").distinct().withColumn("one", F.lit(True))
    flat = prior.join(one.withColumnRenamed("gene_id", "src").withColumnRenamed("one", "one_s"), "src", "left").join(one.withColumnRenamed("gene_id", "tgt").withColumnRenamed("one", "one_t"), "tgt", "left")
    value = F.when(F.col("one_s") | F.col("one_t"), F.lit(0.0)).when(F.col("src") == 0, F.lit(stimulus)).otherwise(F.greatest(F.lit(floor), F.abs("w")))
    return flat.select("src", "tgt", value.alias("m"))


def filter_edges(edges: DataFrame, least: float = 1.0, part: float = 0.1) -> DataFrame:
    """Edges with |w| of at least ``least`` and at least ``part`` of the sum of |w| into their target."""
    into = F.sum(F.abs("w")).over(Window.partitionBy("tgt"))
    return edges.withColumn("into", into).filter((F.abs("w") >= least) & (F.abs("w") >= part * F.col("into"))).drop("into")


def edges_at_max_change(frames: DataFrame) -> DataFrame:
    """Of ``frame, src, tgt, w`` each edge's row of the largest change against the frame before (from 0 at first); ties go to the earlier frame."""
    edge = Window.partitionBy("src", "tgt")
    change = F.abs(F.col("w") - F.coalesce(F.lag("w").over(edge.orderBy("frame")), F.lit(0.0)))
    return frames.withColumn("change", F.round(change, 9)).withColumn("r", F.row_number().over(edge.orderBy(F.col("change").desc(), "frame"))).filter("r = 1").drop("r")


def new_edges_by_frame(frames: DataFrame) -> DataFrame:
    """``frame, src, tgt, w`` of edges that are not in the frame before (frames are numbered without gaps)."""
    before = frames.select((F.col("frame") + 1).alias("frame"), "src", "tgt")
    return frames.join(before, ["frame", "src", "tgt"], "left_anti")


def top_targets(edges: DataFrame, n: int = 8) -> DataFrame:
    """``src, tgt, w, rank``: the ``n`` strongest other targets of each source; zeros dropped, ties by target."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.abs("w").desc(), "tgt"))
    return edges.filter("src <> tgt and w <> 0").withColumn("rank", rank).filter(F.col("rank") <= n)


def regulator_rank(edges: DataFrame) -> DataFrame:
    """``src, strength, rank`` by the sum of outgoing |w|; ties by source."""
    s = edges.groupBy("src").agg(F.round(F.sum(F.abs("w")), 9).alias("strength"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("strength").desc(), "src")))


def top_fraction_edges(edges: DataFrame, percentile: float = 0.9) -> DataFrame:
    """Edges to others whose |w| is at least the percentile of all |w| that are not 0."""
    at = quantiles(edges.filter("w <> 0").select(F.abs("w").alias("w")), "w", [percentile])[0]
    return edges.filter((F.abs("w") >= F.lit(at)) & (F.col("src") != F.col("tgt")))


def kon(states: DataFrame, edges: DataFrame, intercepts: DataFrame, key: str, lower: DataFrame) -> DataFrame:
    """``key, tgt, kon``: for each state row (key, gene_id, prot) the mean of the modes' values under the network.

    Two modes: with s the sum of prot * w and the intercept, the share of the
    upper mode is 1 / (1 + exp(-s)); ``lower`` (tgt, low) is the value of the
    lower mode, the upper's is 1. A gene without edges has its intercept alone.

    The network (genes squared) goes to the tasks as a matrix; a key's states
    are one row, so the one shuffle is that of the states.
    """
    spark = states.sparkSession
    at = intercepts.join(lower, "tgt").select("tgt", "b", "low").orderBy("tgt").toPandas()
    e = edges.groupBy("src", "tgt").agg(F.sum("w").alias("w")).toPandas()
    sources, targets = np.unique(e["src"].to_numpy(np.int64)), at["tgt"].to_numpy(np.int64)
    if not len(targets):
        return spark.createDataFrame([], f"{key} {dict(states.dtypes)[key]}, tgt int, kon double")
    e = e[e["tgt"].isin(targets)]
    w = np.zeros((len(sources), len(targets)))
    w[np.searchsorted(sources, e["src"]), np.searchsorted(targets, e["tgt"])] = e["w"]
    b, low = at["b"].to_numpy(float), at["low"].to_numpy(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, k in _levels(batch, sources, w, b, low):
                yield pd.DataFrame({key: part[key], "kon": list(k)})

    rows = states.filter(F.col("prot").isNotNull()).groupBy(key).agg(F.collect_list("gene_id").alias("gene"), F.collect_list("prot").alias("prot"))
    levels = rows.mapInPandas(run, f"{key} {dict(states.dtypes)[key]}, kon array<double>")
    names = F.array(*[F.lit(int(t)) for t in targets])
    return levels.select(key, F.posexplode("kon").alias("at", "kon")).select(key, F.get(names, "at").cast("int").alias("tgt"), "kon")


def _levels(b: pd.DataFrame, sources: np.ndarray, w: np.ndarray, intercepts: np.ndarray, low: np.ndarray) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """``b`` (gene, prot: arrays) in parts of at most ``VALUES`` levels, with the levels (row, target); only the sources that a part has are multiplied."""
    step = max(1, VALUES // len(intercepts))
    for part in (b[i : i + step] for i in range(0, len(b), step)):
        s = np.tile(intercepts, (len(part), 1))
        if len(sources):
            row = np.repeat(np.arange(len(part)), part["gene"].str.len())
            gene, prot = (np.concatenate([np.zeros(0), *part[c]]) for c in ("gene", "prot"))
            place = np.minimum(np.searchsorted(sources, gene), len(sources) - 1)
            known = sources[place] == gene
            there, column = np.unique(place[known], return_inverse=True)
            m = np.zeros((len(part), len(there)))
            np.add.at(m, (row[known], column), prot[known])
            s += m @ w[there]
        up = 1 / (1 + np.exp(-np.clip(s, -500, 500)))
        yield part, low * (1 - up) + up


def cross_entropy(predicted: Column, seen: Column, clip: float = 1e-6) -> Column:
    """Loss of a predicted against a seen value in [0, 1]."""
    p = F.least(F.greatest(predicted, F.lit(clip)), F.lit(1 - clip))
    return -(seen * F.log(p) + (1 - seen) * F.log(1 - p))


def smoothed_l1(w: Column, knee: float = 1e-3) -> Column:
    """|w|, quadratic below the knee."""
    return F.when(F.abs(w) < knee, w * w / (2 * knee) + knee / 2).otherwise(F.abs(w))


@dataclass(frozen=True)
class Regression:
    """Weights (source, target), intercepts by target, mean loss of a value before and after, and how many targets were not at rest."""

    w: np.ndarray
    b: np.ndarray
    error_before: float
    error: float
    open: int


def default_strength(width: int, expected_error: float = 0.05) -> float:
    """The penalty of an edge, for the mean loss of a cell: the expected error over 1 + root of the number of positions."""
    return expected_error / (1 + width**0.5)


def regress(states: DataFrame, targets: DataFrame, mask: DataFrame, key: str, strength: float = 0.05, rounds: int = 200) -> DataFrame:
    """``src, tgt, w``, with src = -1 the intercept: per target a logistic regression of its value on the state, L1 penalised, masked.

    ``states`` has key, prot (array by position), ``targets`` key, tgt, y,
    ``mask`` tgt, m (array by position).
    """
    own = targets.groupBy(key).agg(F.collect_list(F.struct("tgt", "y")).alias("t"))
    return regress_rows(own.join(states, key).select("prot", F.col("t.tgt").alias("tgt"), F.col("t.y").alias("y")), mask, strength, rounds)


def regress_rows(rows: DataFrame, mask: DataFrame, strength: float = 0.05, rounds: int = 200) -> DataFrame:
    """``regress`` on one row per cell: ``prot`` (array by position) with the targets' numbers ``tgt`` and values ``y`` (arrays)."""
    spark = rows.sparkSession
    m = {r["tgt"]: r["m"] for r in mask.collect()}  # panel squared
    if not m:
        return spark.createDataFrame([], "src int, tgt int, w double")
    names = np.array(sorted(m))
    scale = np.array([[*m[t], 1.0] for t in names.tolist()], float)
    width = scale.shape[1]
    w, n, *_ = _minimised(cut(rows.withColumn("weight", F.lit(1.0))), names, scale, np.zeros(len(names)), np.zeros_like(scale), strength, rounds=rounds)
    found = [(i if i < width - 1 else -1, int(t), float(w[j, i])) for j, t in enumerate(names) if n[j] for i in range(width)]
    return spark.createDataFrame(found, "src int, tgt int, w double")


def fit_rows(
    rows: DataFrame, scale: np.ndarray, low: np.ndarray, start=None, strength: float | None = None, ridge: float = 0.0, reference=None, rounds: int = 200, tolerance: float = 1e-7
) -> Regression:
    """The network of ``rows`` (``prot, kon, weight``: arrays by position, position 0 the stimulus) with levels of two modes.

    ``scale`` (source, target) scales the edges, 0 forbids one; ``low`` is each
    position's lower level. ``start`` and ``reference`` have ``w`` and ``b``; the
    penalty holds the edges near the reference (without it near 0), ``ridge`` is
    its quadratic part. ``rounds`` = 0 only measures the error of ``start``.
    """
    g = len(low)
    flat = lambda n: np.hstack([n.w.T[1:], n.b[1:, None]]) / np.where(both > 0, both, 1)
    both = np.hstack([scale.T[1:], np.ones((g - 1, 1))])
    u = flat(start) if start is not None else np.zeros((g - 1, g + 1))
    rows = rows.select("prot", F.slice("kon", 2, g - 1).alias("y"), "weight")
    strength = default_strength(g) if strength is None else strength
    w, _, before, after, open_ = _minimised(rows, np.arange(1, g), both, low[1:], u, strength, ridge, flat(reference) if reference is not None else None, rounds=rounds, tolerance=tolerance)
    out_w, out_b = np.zeros((g, g)), np.zeros(g)
    out_w[:, 1:], out_b[1:] = w[:, :-1].T, w[:, -1]
    return Regression(out_w, out_b, before, after, open_)


def refined_rows(rows: DataFrame, net, low: np.ndarray, rounds: int = 200) -> Regression:
    """The edges of ``net`` made larger or smaller, each by a factor that begins at 1 and is drawn to 0; edges of 0 and of a gene to itself stay."""
    g, n = len(low), max(rows.count(), 1)
    scale = np.hstack([net.w.T[1:], net.b[1:, None]])
    free = (scale != 0) & ~np.eye(g - 1, g + 1, 1, dtype=bool)
    few = rows.select("prot", F.slice("kon", 2, g - 1).alias("y"), "weight")
    w, _, before, after, open_ = _minimised(few, np.arange(1, g), scale, low[1:], np.ones_like(scale), 1 / (1 + np.log(g)) / n, free=free, rounds=rounds)
    out_w, out_b = np.zeros((g, g)), np.zeros(g)
    out_w[:, 1:], out_b[1:] = w[:, :-1].T, w[:, -1]
    return Regression(out_w, out_b, before, after, open_)


def _minimised(
    rows: DataFrame, names: np.ndarray, scale: np.ndarray, low: np.ndarray, u: np.ndarray, strength: float, ridge: float = 0.0, reference: np.ndarray | None = None,
    free: np.ndarray | None = None, rounds: int = 200, tolerance: float = 1e-10,
) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """Weights (target, position), the values of each target, mean loss before and after, targets not at rest.

    Proximal Newton steps on the weights' multiples ``u`` of ``scale``, until no
    target's objective gains more than ``tolerance`` (``rounds`` is only the bound). In
    each step every task sums the loss, slope and curvature of all targets over
    its own cells; the sums of the tasks are added by target, and what reaches
    the driver (targets x positions squared) doesn't follow the number of cells.
    """
    width = scale.shape[1]
    free = scale != 0 if free is None else free
    reference = np.zeros_like(u) if reference is None else reference
    fine, square = (np.array([x] * (width - 1) + [0.0]) for x in (strength, ridge))
    state, base, step, open_, first = None, u, np.zeros_like(u), np.ones(len(names), bool), 0.0
    mean = lambda loss, n: float((loss / np.maximum(n, 1e-300))[n > 0].mean()) if (n > 0).any() else 0.0
    n, loss, slope, curve = np.zeros(len(names)), np.zeros(len(names)), np.zeros_like(u), np.zeros((len(names), width, width))
    for _ in range(rounds + 1):
        # Only targets that aren't at rest are summed again.
        t = np.flatnonzero(open_)
        loss[t], n[t], slope[t], curve[t] = _sums(rows, names[t], (scale * u)[t].T, low[t], rounds > 0)
        here, per = n > 0, np.where(n > 0, n, 1.0)
        value = loss / per + np.abs(u - reference) @ fine + (u - reference) ** 2 @ square / 2
        fresh = (value, scale * slope / per[:, None], scale[:, :, None] * scale[:, None, :] * curve / per[:, None, None], loss)
        if state is None:
            better, gain, first = here, np.full(len(names), np.inf), mean(loss, n)
            state = list(fresh)
        else:
            better = open_ & (value <= state[0])
            gain = np.where(better, state[0] - value, np.inf)
            for old, now in zip(state, fresh):
                old[better] = now[better]
        base = np.where(better[:, None], u, base)
        if not rounds:
            break
        newton = np.zeros_like(u)
        newton[t] = _newton_step(base[t], state[1][t], state[2][t], fine, square, reference[t], free[t])
        # A step that made the objective worse is halved; a fresh one is made where it fell.
        step = np.where(better[:, None], newton, step / 2)
        open_ = here & open_ & (gain > tolerance) & (np.abs(step).max(axis=1) > 1e-9)
        u = np.where(open_[:, None], base + step, base)
        if not open_.any():
            break
    if rounds and open_.any():
        warnings.warn(f"{int(open_.sum())} of {len(names)} targets not at rest after {rounds} steps", stacklevel=2)
    return scale * base, n, first, mean(state[3], n), int(open_.sum()) if rounds else 0


def _newton_step(u: np.ndarray, slope: np.ndarray, curve: np.ndarray, fine: np.ndarray, square: np.ndarray, reference: np.ndarray, free: np.ndarray, sweeps: int = 40) -> np.ndarray:
    """The change of ``u`` (target, position) that minimises the penalised quadratic of every target, by coordinates, all targets at once."""
    z, g = u.copy(), slope.copy()
    for _ in range(sweeps):
        most = 0.0
        for j in range(u.shape[1]):
            h = curve[:, j, j] + 1e-9 + square[j]
            new = z[:, j] - (g[:, j] + 1e-9 * (z[:, j] - u[:, j]) + square[j] * (z[:, j] - reference[:, j])) / h - reference[:, j]
            new = np.where(free[:, j], reference[:, j] + np.sign(new) * np.maximum(np.abs(new) - fine[j] / h, 0), u[:, j])
            # No coordinate runs away where the curvature has vanished.
            d = np.clip(new, u[:, j] - 10, u[:, j] + 10) - z[:, j]
            z[:, j] += d
            g += d[:, None] * curve[:, j]
            most = max(most, np.abs(d).max())
        if most < 1e-9:
            break
    return z - u


def _entries(b: pd.DataFrame, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and how many of them, by (row, target), of rows that name their targets."""
    y, n = np.zeros((len(b), len(names))), np.zeros((len(b), len(names)))
    row = np.repeat(np.arange(len(b)), b["tgt"].str.len().to_numpy(int))
    tgt, value = np.concatenate(b["tgt"].to_numpy()).astype(int), np.concatenate(b["y"].to_numpy()).astype(float)
    at = np.minimum(np.searchsorted(names, tgt), len(names) - 1)
    known = names[at] == tgt
    np.add.at(y, (row[known], at[known]), value[known])
    np.add.at(n, (row[known], at[known]), 1.0)
    return y / np.maximum(n, 1), n


def _curvature(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Upper half, row by row, of the sum of a a' over all rows of ``a``, weighted by each column of ``h``: (column, pair of positions).

    It only shapes the steps, so products are in single precision; the pairs are
    made once for all columns, in blocks that stay near the processor.
    """
    width = a.shape[1]
    ends = np.cumsum([0, *range(width, 0, -1)])
    out, pairs = np.zeros((h.shape[1], ends[-1])), np.empty((PAIRED, ends[-1]), np.float32)
    a, h = a.astype(np.float32), h.astype(np.float32)
    for i in range(0, len(a), PAIRED):
        x = a[i : i + PAIRED]
        here = pairs[: len(x)]
        for j in range(width):
            np.multiply(x[:, j : j + 1], x[:, j:], out=here[:, ends[j] : ends[j + 1]])
        out += h[i : i + PAIRED].T @ here
    return out


def _terms(a: np.ndarray, y: np.ndarray, n: np.ndarray, w: np.ndarray, low: np.ndarray, curved: bool = True) -> np.ndarray:
    """By target: loss, weight, slope by position and, if ``curved``, the curvature's upper half, summed over the rows of ``a`` (row, position) with values ``y`` of weight ``n`` (row, target)."""
    s = np.clip(a @ w, -50, 50)
    p = 1 / (1 + np.exp(-s))
    k = np.maximum(low + (1 - low) * p, 1e-12)
    # 1 - k is (1 - low) (1 - p), which is taken from its logarithm.
    loss = y * np.log(k) + (1 - y) * (np.log(np.maximum(1 - low, 1e-12)) + np.log(p) - s)
    ratio = p / k
    # The curvature's weight (1 - low) p p (1 - p) / k.
    h = n * (ratio * (1 - p) * p * (1 - low))
    return np.hstack([-(n * loss).sum(axis=0)[:, None], (n + np.zeros_like(y)).sum(axis=0)[:, None], (n * ((k - y) * ratio)).T @ a, *([_curvature(a, h)] if curved else [])])


def _sums(rows: DataFrame, names: np.ndarray, w: np.ndarray, low: np.ndarray, curved: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Loss, weight of the values, slope and curvature of each target under the weights ``w`` (position, target), summed over all rows.

    A value is predicted as low + (1 - low) / (1 + exp(-s)); the curvature is its
    expectation, or 0 where it isn't asked for. Rows that don't name their targets (``tgt``) have a value for
    each position after the first, from which ``names`` are taken.
    """
    width, count = w.shape
    # A curvature is symmetric: its upper half is sent.
    upper = np.triu_indices(width)
    size = 2 + width + len(upper[0]) * curved
    low = np.broadcast_to(np.asarray(low, float), count)
    named = "tgt" in rows.columns

    def matrix(column: pa.Array, n: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((count, size))
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                a = np.hstack([matrix(part["prot"], len(part)), np.ones((len(part), 1))])
                weight = part["weight"].to_numpy(zero_copy_only=False).astype(float)[:, None]
                if named:
                    y, n = _entries(part.select(["tgt", "y"]).to_pandas(), names)
                else:
                    y, n = matrix(part["y"], len(part))[:, names - 1], 1.0
                total += _terms(a, y, n * weight, w, low, curved)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.ListArray.from_arrays(np.arange(count + 1, dtype=np.int32) * size, total.ravel())], ["at", "v"])

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [b["at"].iloc[0]], "v": [np.stack(b["v"].to_numpy()).sum(axis=0)]})

    out = np.zeros((count, size))
    for r in rows.mapInArrow(run, "at int, v array<double>").groupBy("at").applyInPandas(add, "at int, v array<double>").collect():
        out[r["at"]] = r["v"]
    curve = np.zeros((count, width, width))
    if curved:
        curve[:, upper[0], upper[1]] = curve[:, upper[1], upper[0]] = out[:, 2 + width :]
    return out[:, 0], out[:, 1], out[:, 2 : 2 + width], curve


def filtered_over_time(frames: DataFrame, least: float = 0.05, change: float = 0.01) -> DataFrame:
    """``frame, src, tgt, w``: each edge from the frame of its strongest change on, if it is strong and varies enough.

    ``frames`` has frame, src, tgt, w. An edge whose largest |w| is below
    ``least``, or whose |w| varies by less than ``change`` over the frames
    (absent before its first), is dropped.
    """
    start = edges_at_max_change(frames).select("src", "tgt", F.col("frame").alias("start"))
    keep = frames.groupBy("src", "tgt").agg(F.max(F.abs("w")).alias("m"), F.min(F.abs("w")).alias("l"), F.count(F.lit(1)).alias("n"))
    keep = keep.filter((F.col("m") >= least) & (F.when(F.col("n") > 1, F.col("m") - F.col("l")).otherwise(F.col("m")) >= change))
    return frames.join(start, ["src", "tgt"]).filter("frame >= start").join(keep.select("src", "tgt"), ["src", "tgt"], "left_semi").select("frame", "src", "tgt", "w")
