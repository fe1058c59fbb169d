"""Selection of genes and cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronocount.session import cut


def cells_per_time_sample(cells: DataFrame) -> DataFrame:
    """``time_h, sample_id, n_cells``; null keys are groups."""
    return cells.groupBy("time_h", "sample_id").agg(F.count(F.lit(1)).alias("n_cells"))


def seeded(key: str, seed: int = 0) -> Column:
    """Order of rows that depends on key and seed alone, not on partitions; SQL engines make the same one."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))


def group_rank(rows: DataFrame, groups: list[str], key: str, seed: int = 0) -> DataFrame:
    """``rows`` with ``rank`` and ``group_size``: the place of each row in its group by a seeded hash of ``key``.

    A group is ranked in 256 parts of the hash's range: the parts are sorted by
    tasks of their own, and their sizes say where each one's ranks begin. Null
    keys of groups are a group.
    """
    rows = rows.withColumn("_h", seeded(key, seed)).withColumn("_part", F.substring("_h", 1, 2)).withColumn("_g", F.to_json(F.struct(F.lit(0), *groups)))
    sizes = rows.groupBy("_g", "_part").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_g", "_part", before.alias("_start"), F.sum("_n").over(group).alias("group_size"))
    rank = F.row_number().over(Window.partitionBy("_g", "_part").orderBy("_h", key))
    return rows.withColumn("rank", rank).join(starts, ["_g", "_part"]).withColumn("rank", F.col("rank") + F.col("_start")).drop("_h", "_part", "_g", "_start")


def subset_cells(cells: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` cells by seeded hash, all if there are fewer."""
    return cells.orderBy(seeded("cell_id", seed), "cell_id").limit(n)


def subsample_fixed(cells: DataFrame, groups: list[str], n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` cells of each group, by seeded hash."""
    return group_rank(cells, groups, "cell_id", seed).filter(F.col("rank") <= n).drop("rank", "group_size")


def subsample_per_group(cells: DataFrame, per_run: int = 10_000, seed: int = 0) -> DataFrame:
    """At most ``per_run`` / number of times cells per (time, sample), by seeded hash."""
    n_times = cells.agg(F.greatest(F.count_distinct("time_h"), F.lit(1)).alias("n_times"))
    ranked = group_rank(cells, ["time_h", "sample_id"], "cell_id", seed).join(F.broadcast(n_times))
    return ranked.filter(F.col("rank") <= F.floor(F.lit(per_run) / F.col("n_times"))).drop("rank", "group_size", "n_times")


def split_train_test(cells: DataFrame, rate: float = 0.6, seed: int = 0) -> DataFrame:
    """``cells`` with ``part``: of n cells of a (time, sample) the first floor(n * rate) by seeded hash are 'train', the others 'test'."""
    ranked = group_rank(cells, ["time_h", "sample_id"], "cell_id", seed)
    part = F.when(F.col("rank") <= F.floor(F.col("group_size") * F.lit(rate)), F.lit("train")).otherwise(F.lit("test"))
    return ranked.withColumn("part", part).drop("rank", "group_size")


def shuffled(trajectories: DataFrame, group: str, key: str, batch: int, seed: int) -> DataFrame:
    """``trajectories`` with ``batch``: their batches of a turn; another ``seed`` (the turn's number) puts them together anew."""
    ranked = group_rank(trajectories, [group], key, seed)
    return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / F.lit(batch)).cast("bigint")).drop("rank", "group_size")


def repeat_min_choice(keys: DataFrame, n_wanted: int, key: str, seed: int = 0) -> DataFrame:
    """``keys`` with ``times``: how often each is chosen when ``n_wanted`` are: all equally often, the rest once more, first by seeded hash."""
    ranked = group_rank(keys, [], key, seed)
    times = F.floor(F.lit(n_wanted) / F.col("group_size")) + (F.col("rank") <= F.lit(n_wanted) % F.col("group_size")).cast("bigint")
    return ranked.withColumn("times", times.cast("bigint")).drop("rank", "group_size")


def select_cells_for_rates(cells: DataFrame, most: int = 200, seed: int = 0) -> DataFrame:
    """``cell_id, sample_id`` of at most ``most`` cells of each sample at time 0, by seeded hash."""
    ranked = group_rank(cells.filter("time_h = 0"), ["sample_id"], "cell_id", seed)
    return ranked.filter(F.col("rank") <= most).select("cell_id", "sample_id")


def batch_size_plan(cells: DataFrame, quantile: float = 0.8, largest: int = 1024) -> DataFrame:
    """``sample_id, n_traj, batch_size``: trajectories per sample from the quantile of cells per time, cut into batches beyond the largest."""
    per_time = cells.filter("time_h is not null").groupBy("sample_id", "time_h").agg(F.count(F.lit(1)).alias("n"))
    n = per_time.groupBy("sample_id").agg(F.floor(F.percentile("n", F.lit(quantile))).cast("bigint").alias("n_traj"))
    return n.withColumn("batch_size", F.when(F.col("n_traj") > largest, F.lit(largest)).otherwise(F.col("n_traj")).cast("bigint"))


def mode_frequencies(modes: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """``gene_id, by, f``: share of cells of each group whose gene is in the upper mode.

    ``modes`` has the (cell, gene) pairs in the upper mode; all others are in the lower.
    """
    n = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    up = modes.join(cells.select("cell_id", *by), "cell_id").groupBy("gene_id", *by).agg(F.count(F.lit(1)).alias("k"))
    panel = modes.agg(F.collect_set("gene_id").alias("panel"))
    grid = n.join(F.broadcast(panel)).select(*by, "n", F.explode("panel").alias("gene_id"))
    same = reduce(lambda a, b: a & b, [grid["gene_id"] == up["gene_id"], *[grid[c].eqNullSafe(up[c]) for c in by]])
    return grid.join(up, same, "left").select(grid["gene_id"], *[grid[c] for c in by], "n", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("f"))


def temporal_variation(modes: DataFrame, cells: DataFrame) -> DataFrame:
    """``gene_id, time_h, variation``: change of the mode shares from each time to the next of a sample, over both modes, summed over samples."""
    f = mode_frequencies(modes, cells.filter("time_h is not null and sample_id is not null"), ["sample_id", "time_h"])
    step = F.lead("f").over(Window.partitionBy("gene_id", "sample_id").orderBy("time_h")) - F.col("f")
    return f.withColumn("d", 2 * F.abs(step)).filter("d is not null").groupBy("gene_id", "time_h").agg(F.sum("d").alias("variation"))


def celltype_variation(modes: DataFrame, cells: DataFrame) -> DataFrame:
    """``gene_id, cell_type, variation``: difference of the mode shares between a type and all others of a sample, over both modes, summed over samples.

    Samples with one type give nothing.
    """
    f = mode_frequencies(modes, cells.filter("cell_type is not null and sample_id is not null"), ["sample_id", "cell_type"])
    sample = Window.partitionBy("gene_id", "sample_id")
    rest_n = F.sum("n").over(sample) - F.col("n")
    rest = (F.sum(F.col("f") * F.col("n")).over(sample) - F.col("f") * F.col("n")) / F.nullif(rest_n, F.lit(0))
    return f.withColumn("d", 2 * F.abs(F.col("f") - rest)).filter("d is not null").groupBy("gene_id", "cell_type").agg(F.sum("d").alias("variation"))


def select_de_genes(temporal: DataFrame, by_type: DataFrame, n_time: int = 5, n_type: int = 3, least: float = 0.01) -> DataFrame:
    """``gene_id, kind, at, rank``: the genes of largest variation at each time and for each type, those above ``least`` only; ties by gene."""

    def top(df: DataFrame, kind: str, at: str, n: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(at).orderBy(F.col("variation").desc(), "gene_id"))
        best = df.withColumn("variation", F.round("variation", 9)).withColumn("rank", rank).filter((F.col("rank") <= n) & (F.col("variation") >= least))
        return best.select("gene_id", F.lit(kind).alias("kind"), F.col(at).cast("string").alias("at"), F.col("rank").cast("bigint").alias("rank"))

    return top(temporal, "temporal", "time_h", n_time).unionByName(top(by_type, "type", "cell_type", n_type))


def kept_if_variable(listed: DataFrame, temporal: DataFrame, least: float = 0.01) -> DataFrame:
    """``gene_id`` of listed genes whose variation over all times is above ``least``."""
    total = temporal.groupBy("gene_id").agg(F.sum("variation").alias("v")).filter(F.col("v") > least)
    return listed.select("gene_id").distinct().join(total, "gene_id", "left_semi")


def quantiles(values: DataFrame, value: str, at: list[float]) -> list[float | None]:
    """The quantiles ``at`` of a numeric column, between two values by their distance; nulls and NaN don't count, without values all are null.

    Values are counted, the different ones sorted in ranges by tasks of their
    own, and the ranges' sizes say in which ones the wanted ranks lie, so no task
    holds the column. A value that a third of all rows have is one row there.
    """
    v = F.col(value).cast("double")
    counted = values.filter(v.isNotNull() & ~F.isnan(v)).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranges = cut(counted.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    sizes = sorted(ranges.groupBy("part").agg(F.sum("n").alias("n"), F.min("v").alias("least")).collect(), key=lambda r: r["least"])
    starts, total = {}, 0
    for r in sizes:
        starts[r["part"]], total = total, total + r["n"]
    if not total:
        return [None] * len(at)
    places = [q * (total - 1) for q in at]
    wanted = sorted({int(f) for p in places for f in (p // 1, -(-p // 1))})
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    start = F.create_map(*[F.lit(x) for pair in starts.items() for x in pair])
    holding = [p for p, begin in starts.items() for n in [next(r["n"] for r in sizes if r["part"] == p)] if any(begin <= w < begin + n for w in wanted)]
    ranked = ranges.filter(F.col("part").isin(holding)).select("v", "n", (start[F.col("part")] + upto).alias("upto"))
    hit = reduce(lambda a, b: a | b, [(F.col("upto") > w) & (F.col("upto") - F.col("n") <= w) for w in wanted])
    rows = ranked.filter(hit).collect()
    by_rank = {w: r["v"] for w in wanted for r in rows if r["upto"] - r["n"] <= w < r["upto"]}
    return [by_rank[int(p // 1)] + (by_rank[int(-(-p // 1))] - by_rank[int(p // 1)]) * (p % 1) for p in places]


def panel_bins(values: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """``key, bin``: number of the quantile bin (0 first, closed above) of each value; nulls have none."""
    edges = [e for e in quantiles(values, value, [i / n for i in range(1, n)]) if e is not None]
    number = reduce(lambda a, b: a + b, [(F.col(value) > e).cast("int") for e in edges], F.lit(0))
    return values.filter(F.col(value).isNotNull()).select(key, number.alias("bin"))
