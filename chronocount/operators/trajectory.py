"""States of cells over time and the coupling of consecutive snapshots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of one side of a coupling that one task holds; larger groups are cut into parts by seeded hash, anew in every turn.
BATCH = 1024


def relaxed(start: Column, towards: Column, rate: Column, time: Column) -> Column:
    """Exponential relaxation of ``start`` ``towards`` a level."""
    return towards + (start - towards) * F.exp(-rate * time)


def next_state(prot: Column, rate: Column, first: Column, last: Column, alpha: Column, scale: Column, time: Column) -> Column:
    """Towards the level of the first mode for a part ``alpha`` of the time, then towards that of the last."""
    return relaxed(relaxed(prot, first * scale, rate, alpha * time), last * scale, rate, (1 - alpha) * time)


def next_state_mixed(prot: Column, rate: Column, first: Column, last: Column, scale: Column, time: Column) -> Column:
    """Towards a level that moves evenly from the first mode's to the last one's over the time."""
    slope = (last - first) * scale / F.nullif(time, F.lit(0.0))
    # The solution of p' = rate (first + slope t - p).
    lag = slope / rate
    return F.when(time > 0, last * scale - lag + (prot - first * scale + lag) * F.exp(-rate * time)).otherwise(prot)


def nearest_states(wanted: DataFrame, known: DataFrame, group: str, panel: int) -> DataFrame:
    """``key, match, distance``: for each state of ``wanted`` (group, key, prot, kon as arrays) the nearest of ``known`` in its group.

    The distance is the sum of |difference| of prot / panel and of kon (1 - 1 /
    panel); ties go to the smaller key. A group's known states are meant to be a
    part of bounded size; wanted rows stay where they are and meet them in turn.
    """
    gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)
    there = known.select(group, F.col("key").alias("match"), F.col("prot").alias("p"), F.col("kon").alias("k"))
    both = wanted.join(there, group).withColumn("distance", F.round(gap("prot", "p") / panel + gap("kon", "k") * (panel - 1) / panel, 9))
    best = both.groupBy(group, "key").agg(F.min(F.struct("distance", "match")).alias("m"))
    return best.select(group, "key", "m.match", "m.distance")


def shrunk_to_mode(x: Column, mode: Column, factor: float = 2.0, power: float = 2.0) -> Column:
    """x (1 - w) + mode w with w = a / (1 + a), a = (|x - mode| / (factor mode)) ^ power; a mode of 0 leaves x."""
    a = F.pow(F.abs(x - mode) / F.nullif(factor * mode, F.lit(0.0)), F.lit(power))
    w = F.coalesce(a / (1 + a), F.lit(0.0))
    return x * (1 - w) + mode * w


def initial_states(rows: DataFrame) -> DataFrame:
    """``rows`` without x and level, with ``prot``: the starting state of each row, from ``gene_id``, the scaled count ``x`` and the ``level`` of its mode.

    Counts are shrunk to their level and moved to begin at 0 in each gene. The
    range of the gene's levels is divided into equal steps, one for each mode in
    order, and a count lies in its mode's step at the root of its part of the
    mode's largest count, or of the share of the gene's largest that the mode's
    place gives it if that is more. A gene with one mode keeps its level.
    """
    s = rows.withColumn("_s", shrunk_to_mode(F.col("x").cast("double"), F.col("level")))
    ends = s.groupBy("gene_id", "level").agg(F.min("_s").alias("_first"), F.max("_s").alias("_last"))
    modes = ends.groupBy("gene_id").agg(F.min("_first").alias("_zero"), F.max("_last").alias("_top"), F.array_sort(F.collect_set("level")).alias("_levels"))
    ends = ends.join(modes, "gene_id").withColumn("_n", F.size("_levels")).withColumn("_z", F.array_position("_levels", F.col("level")) - 1)
    top, left = F.col("_top") - F.col("_zero"), F.col("_n") - F.col("_z")
    ends = ends.select(
        "gene_id", "level", "_zero", "_n", "_z", F.array_min("_levels").alias("_low"), F.array_max("_levels").alias("_high"),
        F.least(F.col("_first") - F.col("_zero"), top / (1 + left)).alias("_from"), F.greatest(F.col("_last") - F.col("_zero"), top / left).alias("_to"),
    )
    part = F.sqrt(F.least(F.greatest(F.col("_s") - F.col("_zero"), F.col("_from")), F.col("_to")) / (F.col("_to") + 1e-16))
    prot = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_z") + part) / F.col("_n")
    return s.join(ends, ["gene_id", "level"]).select(*[c for c in rows.columns if c not in ("x", "level")], prot.alias("prot"))


def next_time(rows: DataFrame, key: list[str], time: str, value: str) -> DataFrame:
    """``rows`` with ``next_time`` and ``next_value`` of the same key; the last has none and is left out."""
    order = Window.partitionBy(*key).orderBy(time)
    both = rows.withColumn("next_time", F.lead(time).over(order)).withColumn("next_value", F.lead(value).over(order))
    return both.filter("next_time is not null")


def nearest_time(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """``time, known_time``: for each ``time`` the nearest of ``known_time``, the earlier of equals.

    Both lists of times are merged and looked through forwards and backwards, so
    no pairs are made.
    """
    both = wanted.select("time", F.lit(None).cast("double").alias("k")).unionByName(known.select(F.col("known_time").alias("time"), F.col("known_time").alias("k")))
    before = F.last("k", ignorenulls=True).over(Window.orderBy("time", F.col("k").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("k", ignorenulls=True).over(Window.orderBy("time", F.col("k").isNull()).rowsBetween(0, Window.unboundedFollowing))
    at = both.withColumn("b", before).withColumn("a", after).filter("k is null")
    nearer = F.when(F.col("a").isNull() | (F.col("time") - F.col("b") <= F.col("a") - F.col("time")), F.col("b")).otherwise(F.col("a"))
    return at.select("time", nearer.alias("known_time")).distinct()


def switch_fraction(rows: DataFrame, grid: int = 25, predicted=None) -> DataFrame:
    """``key, alpha``: the first of ``grid`` equal parts of the interval at which the predicted value is nearer to the end than to the start; 1 if never.

    ``rows`` has key, start, end and what ``predicted`` (a function of the
    fraction's column) needs.
    """
    t = rows.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(grid)))).withColumn("t", F.col("t") / grid)
    reached = F.abs(predicted(F.col("t")) - F.col("end")) < F.abs(predicted(F.col("t")) - F.col("start"))
    return t.groupBy("key").agg(F.coalesce(F.min(F.when(reached, F.col("t"))), F.lit(1.0)).alias("alpha"))


def exact_profiles(inferred: DataFrame, true: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``profile, dst, w`` and ``src, profile``: inferred cells (key) found among true ones by their whole profile (array x), followed to the successors (next_id).

    Cells of one profile are a class: the first table has the successors of each
    with their weights, the second each inferred cell's class. Profiles that no
    true cell with a successor has are in neither.
    """
    of = F.sha2(F.to_json(F.col("x")), 256).alias("profile")
    after = true.filter("next_id is not null").groupBy(of, F.col("next_id").alias("dst")).agg(F.count(F.lit(1)).alias("n"))
    total = true.groupBy(of).agg(F.count(F.lit(1)).alias("all"))
    classes = after.join(total, "profile").select("profile", "dst", (F.col("n") / F.col("all")).alias("w"))
    members = inferred.select(F.col("key").alias("src"), of).distinct().join(classes.select("profile").distinct(), "profile", "left_semi")
    return classes, members


def sinkhorn(cost: np.ndarray, mu: np.ndarray, nu: np.ndarray, reg: float, soft: float | None = None, rounds: int = 1000, tolerance: float = 1e-7, hard: float = 1e3) -> np.ndarray:
    """Entropic coupling of two weight vectors; with ``soft`` the target's weights may be missed at that price (the source's at ``hard``).

    Costs are taken from the least of their row and of their column first, which
    the weights' multipliers take up, so that no row or column vanishes. What the
    multipliers of both sides can exchange as a whole is set to its best value
    in every round; left to the rounds it takes most of them.
    """
    row = cost.min(axis=1, keepdims=True)
    col = (cost - row).min(axis=0, keepdims=True)
    kernel = np.exp(-(cost - row - col) / reg)
    give_a, give_b = (1.0, 1.0) if soft is None else (hard / (hard + reg), soft / (soft + reg))
    # Multipliers of the kernel as it was, that is with the shifts in them.
    shift_a, shift_b = np.exp(-row[:, 0] / reg * (1 - give_a)), np.exp(-np.minimum(col[0] / reg * (1 - give_b), 600))
    u, v = np.ones(len(mu)), np.ones(len(nu))
    for _ in range(rounds):
        new = (mu / np.maximum(kernel @ v, 1e-300)) ** give_a * shift_a
        v = (nu / np.maximum(kernel.T @ new, 1e-300)) ** give_b * shift_b
        if soft is not None:
            a, b = reg * np.log(np.maximum(new, 1e-300)) + row[:, 0], reg * np.log(np.maximum(v, 1e-300)) + col[0]
            mass = [np.log((weight * np.exp((f.min() - f) / price)).sum()) - f.min() / price for weight, f, price in ((mu, a, hard), (nu, b, soft))]
            whole = np.exp(hard * soft / (hard + soft) * (mass[0] - mass[1]) / reg)
            new, v = new * whole, v / whole
        moved, u = np.abs(np.log(np.maximum(new, 1e-300)) - np.log(np.maximum(u, 1e-300))).max(), new
        if moved < tolerance:
            break
    return u[:, None] * kernel * v[None, :]


def halflife_rates(names: DataFrame, known: DataFrame) -> DataFrame:
    """``name, d0, d1``: decay rates of RNA and protein from half-lives (``known``: known, rna, prot) of the names that share the longest prefix.

    A missing mean half-life of protein is that of RNA times the ratio of both
    means over all names. Rates are held between a tenth and ten times their
    mean; one without a half-life is null.
    """
    ratio = known.agg((F.avg("prot") / F.avg("rna")).alias("ratio"))
    means = [prefix_fallback(names, known.select("known", c), c).select("name", F.col("value").alias(c)) for c in ("rna", "prot")]
    half = means[0].join(means[1], "name").join(F.broadcast(ratio)).select("name", "rna", F.coalesce("prot", F.col("rna") * F.col("ratio")).alias("prot"))
    rates = half.select("name", *[(F.log(F.lit(2.0)) / F.nullif(F.col(c), F.lit(0.0))).alias(d) for c, d in (("rna", "d0"), ("prot", "d1"))])
    mean = rates.agg(F.avg("d0").alias("m0"), F.avg("d1").alias("m1"))
    held = lambda d, m: F.when(F.col(d).isNotNull(), F.greatest(F.least(F.col(d), 10 * F.col(m)), F.col(m) / 10)).alias(d)
    return rates.join(F.broadcast(mean)).select("name", held("d0", "m0"), held("d1", "m1"))


def prefix_fallback(names: DataFrame, known: DataFrame, value: str, steps: int = 10) -> DataFrame:
    """``name, matched, n_known, value``: the mean value of the known names that begin with the longest part of a name.

    Parts are 100 %, 90 %, ... of the name's length, rounded down; the first that
    any known name begins with counts, the empty one matches all. Every prefix of
    a known name is a row of a table, so the search is an equi-join.
    """
    prefixes = known.select(F.explode(F.sequence(F.lit(1), F.length("known"))).alias("n"), "known", value).groupBy(F.substring(F.col("known"), F.lit(1), F.col("n")).alias("matched"))
    table = prefixes.agg(F.count(F.lit(1)).alias("n_known"), F.avg(value).alias("value"))
    overall = known.agg(F.count(F.lit(1)).alias("all_known"), F.avg(value).alias("all_value"))
    parts = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.substring(F.col("name"), F.lit(1), F.floor(F.length("name") * (steps - i) / steps).cast("int"))))
    tried = names.select("name", F.explode(parts).alias("matched")).join(table, "matched")
    best = tried.groupBy("name").agg(F.max_by(F.struct("matched", "n_known", "value"), F.length("matched")).alias("b"))
    return names.select("name").join(best, "name", "left").join(F.broadcast(overall)).select(
        "name", F.coalesce("b.matched", F.lit("")).alias("matched"), F.coalesce("b.n_known", "all_known").alias("n_known"), F.when(F.col("b").isNull(), F.col("all_value")).otherwise(F.col("b.value")).alias("value")
    )
