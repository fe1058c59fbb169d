"""Grouping records into similarity clusters.

Method: parallel pivot correlation clustering. In rounds, the free records that
no similar free record precedes in hash order (the local minima) become pivots;
all records similar to a pivot are taken by it and leave. This gives the same
pivots as going through all records one by one in hash order. Then members go to
the closest pivot, and pivots become the medoids of their members.

Two records are similar if the cosine of their profiles is at least a threshold.
Profiles are log counts less their means, seen in the leading principal
components, for which sums over all records are made once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronocount.operators.counts import gene_and_x, unpacked
from chronocount.session import cut

#: Free records that a round looks for local minima among, those of lowest hash; doubled from round to round up to the
#: second number, which is also the most vectors that any task holds besides its own batch.
FIRST_ROUND, BLOCK = 256, 4096


def count_profiles(packed: DataFrame, panel: list[int], least_total: int = 20) -> DataFrame:
    """``key, total, x``: the counts of each cell over ``panel`` as one array, for cells whose counts sum to ``least_total`` at least.

    A gene without a row, or not measured, is 0 in the profile.
    """
    genes = np.array(sorted(panel), dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _, code = unpacked(b)
            gene, x = gene_and_x(code)
            m = np.zeros((len(b), len(genes)), dtype=np.int32)
            m[np.repeat(np.arange(len(b)), b["codes"].str.len()), np.searchsorted(genes, gene)] = np.maximum(x, 0)
            total = m.sum(axis=1, dtype=np.int64)
            keep = total >= least_total
            yield pd.DataFrame({"key": b["cell_id"].to_numpy()[keep], "total": total[keep], "x": list(m[keep])})

    return packed.mapInPandas(run, "key bigint, total bigint, x array<int>")


def components(profiles: DataFrame, width: int, explained: float = 0.9) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading principal directions of ``log1p(x)`` over all records: as many as explain that part of the variance.

    Each task sends one row per gene; the driver sees width + 1 of them, whatever
    the number of records.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width + 1, width + 1))
        for b in batches:
            a = np.hstack([np.log1p(_matrix(b["x"], width)), np.ones((len(b), 1))])
            total += a.T @ a
        yield pd.DataFrame({"i": np.arange(width + 1, dtype=np.int32), "s": list(total)})

    if not width:
        return np.zeros(0), np.zeros((0, 0))
    whole = F.array(*[F.sum(F.col("s")[j]) for j in range(width + 1)]).alias("s")
    found = profiles.select("x").mapInPandas(sums, "i int, s array<double>").groupBy("i").agg(whole).orderBy("i").toPandas()
    g = _matrix(found["s"], width + 1)
    if not len(g):
        return np.zeros(width), np.zeros((width, 0))
    n = max(g[-1, -1], 1.0)
    mean = g[-1, :-1] / n
    value, vector = np.linalg.eigh(g[:-1, :-1] / n - np.outer(mean, mean))
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    lead = np.flatnonzero(value > 1e-9)
    if len(lead):
        lead = lead[: 1 + np.searchsorted(np.cumsum(value[lead]), explained * value[lead].sum() * (1 - 1e-12))]
    vector = vector[:, lead]
    # One sign of the two that an axis can have: that of its largest entry.
    return mean, vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(lead))])


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.concatenate([np.zeros(0), *column]).reshape(-1, width)


def unit_profiles(profiles: DataFrame, mean: np.ndarray, directions: np.ndarray, seed: int = 0) -> DataFrame:
    """``key, order, z``: unit vectors in the directions' space, and the seeded hash of the key.

    One more place holds 1 for a record at the mean, which so is similar to its like alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            z = (np.log1p(_matrix(b["x"], len(mean))) - mean) @ directions
            size = np.linalg.norm(z, axis=1, keepdims=True)
            z = np.hstack([np.where(size < 1e-12, 0, z / np.maximum(size, 1e-12)), size < 1e-12])
            yield b[["key", "order"]].assign(z=list(z.astype(np.float32)))

    return profiles.select("key", F.xxhash64(F.lit(seed), "key").alias("order"), "x").mapInPandas(run, "key bigint, order bigint, z array<float>")


def pivots(units: DataFrame, width: int, threshold: float) -> DataFrame:
    """The rows of ``units`` (key, order, z) that are pivots.

    A round looks at the free records of lowest hash, so whatever precedes one of
    them is among them too: those that no similar one precedes are local minima
    of all free records. A round's records and pivots are ``BLOCK`` at most; the
    pivots are a table, and so are the records still free.
    """
    free, batch, made = units, FIRST_ROUND, []
    while True:
        low = cut(free.orderBy("order", "key").limit(batch))
        seen = low.orderBy("order", "key").toPandas()
        if not len(seen):
            return reduce(DataFrame.unionByName, made) if made else low

        def minima(batches: Iterator[pd.DataFrame], z: np.ndarray = _matrix(seen["z"], width), order: np.ndarray = seen["order"].to_numpy(), key: np.ndarray = seen["key"].to_numpy()) -> Iterator[pd.DataFrame]:
            for b in batches:
                o, k = b["order"].to_numpy()[:, None], b["key"].to_numpy()[:, None]
                before = (order < o) | ((order == o) & (key < k))
                yield b[~(before & (_matrix(b["z"], width) @ z.T >= threshold)).any(axis=1)]

        new = cut(low.repartition(units.sparkSession.sparkContext.defaultParallelism, "key").mapInPandas(minima, units.schema))
        made.append(new)

        def still_free(batches: Iterator[pd.DataFrame], z: np.ndarray = _matrix(new.select("z").toPandas()["z"], width)) -> Iterator[pd.DataFrame]:
            for b in batches:
                # A pivot is similar to itself, but for the last digit.
                yield b[~(_matrix(b["z"], width) @ z.T >= min(threshold, 1 - 1e-6)).any(axis=1)]

        free, batch = cut(free.mapInPandas(still_free, units.schema)), min(batch * 2, BLOCK)


def _blocks(centres: DataFrame) -> Iterator[pd.DataFrame]:
    """The rows of a table of centres, ``BLOCK`` at a time."""
    rows = []
    for r in centres.toLocalIterator():
        rows.append(r)
        if len(rows) == BLOCK:
            yield pd.DataFrame(rows, columns=centres.columns)
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=centres.columns)


def assigned(units: DataFrame, centres: DataFrame, width: int) -> DataFrame:
    """``key, z, cluster, closeness``: each record with the closest of ``centres`` (cluster, z); of equals the one with the smaller number.

    Centres come to the tasks in blocks, one after the other, so a task holds no
    more than one of them, however many clusters there are.
    """
    out = units.select("key", "z", F.lit(None).cast("bigint").alias("cluster"), F.lit(-2.0).alias("closeness"))
    for block in _blocks(centres.select("cluster", "z").orderBy("cluster")):

        def run(batches: Iterator[pd.DataFrame], names: np.ndarray = block["cluster"].to_numpy(), z: np.ndarray = _matrix(block["z"], width)) -> Iterator[pd.DataFrame]:
            for b in batches:
                # Rounded, so that equal ones are equal in every batch.
                s = np.round(_matrix(b["z"], width) @ z.T, 9)
                at = s.argmax(axis=1)
                best = s[np.arange(len(b)), at]
                nearer = best > b["closeness"].to_numpy()
                # A number, or none yet, in one column of 64 bits.
                cluster = b["cluster"].astype("Int64").where(~nearer, names[at])
                yield b[["key", "z"]].assign(cluster=cluster, closeness=np.where(nearer, best, b["closeness"]))

        out = out.mapInPandas(run, "key bigint, z array<float>, cluster bigint, closeness double")
        if len(block) == BLOCK:
            out = cut(out)
    return cut(out)


def medoids(members: DataFrame, width: int) -> DataFrame:
    """``cluster, z``: the medoid of each cluster of ``members`` (key, z, cluster): the member with the highest sum of cosines to all members.

    That sum is the product with the sum of the members' vectors, which is made
    before the shuffle, so a hot cluster is one row of each task.
    """
    total = members.groupBy("cluster").agg(F.array(*[F.sum(F.col("z")[i].cast("double")) for i in range(width)]).alias("s"))
    score = reduce(lambda a, b: a + b, [F.col("z")[i].cast("double") * F.col("s")[i] for i in range(width)])
    scored = members.join(total, "cluster").select("cluster", "z", F.struct(F.round(score, 6).alias("score"), (-F.col("key")).alias("k")).alias("best"))
    return scored.groupBy("cluster").agg(F.max_by("z", "best").alias("z"))


def cluster_cells(packed: DataFrame, threshold: float = 0.6, least_total: int = 20, rounds: int = 2, seed: int = 0) -> DataFrame:
    """``key, cluster, closeness``: every cell whose counts sum to ``least_total`` at least, with its cluster.

    ``closeness`` is the cosine to the cluster's medoid. A cluster has the key of
    its pivot as its number; how many there are follows from the data. Same
    input, seed and threshold give the same clusters, whatever the partitions.
    No cells give no rows.
    """
    panel = [r[0] for r in packed.select(F.explode("codes").alias("c")).select(F.shiftright("c", 21)).distinct().collect()]
    profiles = cut(count_profiles(packed, panel, least_total))
    mean, directions = components(profiles, len(panel))
    width = directions.shape[1] + 1
    units = cut(unit_profiles(profiles, mean, directions, seed))
    centres = pivots(units, width, threshold).select(F.col("key").alias("cluster"), "z")
    for _ in range(rounds):
        centres = cut(medoids(assigned(units, centres, width), width))
    return assigned(units, centres, width).select("key", "cluster", "closeness")


def prevailing_labels(clustered: DataFrame, labels: DataFrame) -> DataFrame:
    """``cluster, label, n_label``: the most frequent label (ties: the first in order) of each cluster; null labels don't count.

    ``labels`` has ``key, label``. Counts by (cluster, label) are made first, so
    a cluster or label that holds a third of all rows is a few rows here.
    """
    n = clustered.join(labels, "key").filter("label is not null").groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("n_label"))
    first = F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("n_label").desc(), "label"))
    return n.withColumn("r", first).filter("r = 1").drop("r")


def describe(clustered: DataFrame, labels: DataFrame, typical: int = 5) -> DataFrame:
    """``cluster, size, label, n_label, typical``: size, prevailing label, and the keys of the most typical members, closest first."""
    order = Window.partitionBy("cluster").orderBy(F.col("closeness").desc(), "key")
    near = clustered.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= typical)
    keys = near.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "key"))), lambda x: x["key"]).alias("typical"))
    size = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return size.join(keys, "cluster").join(prevailing_labels(clustered, labels), "cluster", "left").select("cluster", "size", "label", "n_label", "typical")
