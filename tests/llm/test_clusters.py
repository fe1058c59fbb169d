import numpy as np
import pytest
from pyspark.sql import functions as F

from chronocount.llm.clusters import FIRST_ROUND, assigned, cluster_cells, components, describe, medoids, pivots, prevailing_labels
from chronocount.operators.counts import pack_by_cell


def planted(spark, sizes=(300, 80, 20), seed=0):
    rng = np.random.default_rng(seed)
    levels = rng.choice([0.5, 30.0], (len(sizes), 40), p=[0.6, 0.4])
    truth = np.repeat(np.arange(len(sizes)), sizes)
    x = rng.poisson(levels[truth])
    rows = [(int(c), int(g), int(x[c, g])) for c in range(len(x)) for g in range(40) if x[c, g]]
    return truth, spark.createDataFrame(rows, "cell_id bigint, gene_id int, x bigint")


def test_planted_groups(spark):
    truth, counts = planted(spark)
    got = {r["key"]: r["cluster"] for r in cluster_cells(pack_by_cell(counts)).collect()}
    groups = {}
    for c, k in got.items():
        groups.setdefault(k, set()).add(int(truth[c]))
    assert len(got) == 400 and all(len(g) == 1 for g in groups.values()) and len(groups) <= 6


def test_partitions_do_not_matter(spark):
    _, counts = planted(spark, (60, 40))
    out = [sorted((r["key"], r["cluster"]) for r in cluster_cells(pack_by_cell(counts.repartition(n))).collect()) for n in (1, 5)]
    assert out[0] == out[1]


@pytest.mark.parametrize(("n", "dim", "threshold"), [(600, 3, 0.9), (3000, 8, 0.85)])
def test_pivots_are_those_of_the_serial_algorithm(spark, n, dim, threshold):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(n, dim))
    z = (z / np.linalg.norm(z, axis=1, keepdims=True)).astype(np.float32)
    order = rng.permutation(n)
    units = spark.createDataFrame([(i, int(order[i]), z[i].tolist()) for i in range(n)], "key bigint, order bigint, z array<float>")
    serial, free = [], np.ones(n, bool)
    for i in np.argsort(order):
        if free[i]:
            serial.append(int(i))
            free &= z.astype(float) @ z[i].astype(float) < threshold
    got = pivots(units, dim, threshold)
    assert {r["key"] for r in got.collect()} == set(serial) and (dim == 3 or len(serial) > FIRST_ROUND)
    members = assigned(units, got.select(F.col("key").alias("cluster"), "z"), dim)
    names = np.array(sorted(serial))
    at = names[(z.astype(float) @ z[names].T.astype(float)).argmax(1)]
    assert {r["key"]: r["cluster"] for r in members.collect()} == dict(enumerate(at.tolist()))
    best = {r["cluster"]: r["z"] for r in medoids(members, dim).collect()}
    assert set(best) == set(serial)
    for k in serial[:5]:
        own = z[at == k].astype(float)
        assert np.allclose(best[k], own[(own @ own.T).sum(1).argmax()], atol=1e-5)


def test_blocks_of_centres(spark, monkeypatch):
    rng = np.random.default_rng(2)
    z = rng.normal(size=(200, 4)).astype(np.float32)
    units = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(z)], "key bigint, order bigint, z array<float>")
    centres = units.filter("key < 50").select(F.col("key").alias("cluster"), "z")
    whole = {tuple(r) for r in assigned(units, centres, 4).drop("z").collect()}
    monkeypatch.setattr("chronocount.llm.clusters.BLOCK", 7)
    assert {tuple(r) for r in assigned(units, centres, 4).drop("z").collect()} == whole


def test_components_explain_the_variance(spark):
    rng = np.random.default_rng(3)
    x = np.round(np.exp(rng.normal(size=(500, 3)) * [1.0, 0.5, 0.1] + 5)).astype(int)
    profiles = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "key bigint, total bigint, x array<int>")
    mean, one = components(profiles, 3, 0.7)
    assert np.allclose(mean, np.log1p(x).mean(axis=0)) and one.shape == (3, 1) and components(profiles, 3, 0.9)[1].shape == (3, 2) and components(profiles, 3, 1.0)[1].shape == (3, 3)


def test_labels_and_description(spark):
    clustered = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.95), (3, 0, 0.9), (4, 1, 1.0)], "key bigint, cluster bigint, closeness double")
    labels = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, None), (9, "c")], "key bigint, label string")
    assert [tuple(r) for r in prevailing_labels(clustered, labels).collect()] == [(0, "a", 1)]
    got = {r["cluster"]: (r["size"], r["label"], r["typical"]) for r in describe(clustered, labels).collect()}
    assert got == {0: (3, "a", [2, 1, 3]), 1: (1, None, [4])}


def test_edge_cases(spark):
    _, counts = planted(spark, (30,))
    assert cluster_cells(pack_by_cell(counts.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, 1, 50), (2, 1, 50), (3, 1, 50), (4, 1, 2), (5, 1, None), (1, 1, 50)], "cell_id bigint, gene_id int, x bigint")
    got = cluster_cells(pack_by_cell(odd)).collect()
    assert {r["key"] for r in got} == {1, 2, 3} and len({r["cluster"] for r in got}) == 1
