"""The fit by turns: its parts against plain versions, and a planted network."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronocount.operators import compare, dynamics, evaluate, fit, mixture, network, trajectory
from chronocount.session import tables_dir

TIMES = [0.0, 6.0, 12.0, 24.0, 36.0, 48.0, 60.0, 72.0, 84.0, 96.0]
FN4 = [(0, 1, 10), (1, 2, 10), (1, 3, 10), (3, 4, 10), (4, 1, -10), (2, 2, 10), (3, 3, 10)]


def planted(edges, genes, basal, d0, d1, n_cells, seed=0):
    """Counts (cell, gene) and times of cells of a jump process that meets its stimulus at time 0; each cell is seen once."""
    w = np.zeros((genes + 1, genes + 1))
    for s, t, v in edges:
        w[s, t] = v
    net = dynamics.Network(w, np.append(0.0, np.full(genes, basal)), np.full(genes + 1, 0.02), np.full(genes + 1, d1), np.full(genes + 1, d0 * 5))
    seeds = np.arange(n_cells, dtype=np.uint64) + np.uint64(1000 * seed + 7)
    p = dynamics.jump_path(net, np.zeros((n_cells, genes + 1)), np.array([0.0, 100.0]), seeds)[-1]
    p[:, 0] = 1
    t = np.arange(n_cells) * len(TIMES) // n_cells
    prot = dynamics.jump_path(net, p, np.array(TIMES), seeds + np.uint64(10**6))[t, np.arange(n_cells)]
    prot[t == 0, 0] = 0
    rng = np.random.default_rng(seed)
    return w, t, rng.poisson(rng.gamma(5 * net.kon(prot)[:, 1:] + 1e-9) / 0.2)


def tables(spark, t, x):
    n, g = x.shape
    counts = spark.createDataFrame(pd.DataFrame({"cell_id": np.repeat(np.arange(n), g), "gene_id": np.tile(np.arange(1, g + 1), n).astype(np.int32), "x": x.ravel().astype(np.int64)}))
    cells = spark.createDataFrame(pd.DataFrame({"cell_id": np.arange(n), "sample_id": np.where(np.arange(n) % 2, "a", "b"), "time_h": np.array(TIMES)[t]}))
    return counts, cells


def test_planted_network(spark):
    w, t, x = planted(FN4, 4, -5.0, 0.2, 0.04, 600)
    counts, cells = tables(spark, t, x)
    hist = compare.histogram(counts, cells, ["time_h"]).cache()
    mixed = mixture.fit_mixtures(hist).cache()
    levels = fit.count_levels(mixture.assign_modes(hist, mixed), mixed)
    genes = [1, 2, 3, 4]
    to_fit = fit.cells_to_fit(counts, cells, levels, genes).cache()
    rates = spark.createDataFrame([(g, 0.04) for g in genes], "gene_id int, d1 double")
    panel = fit.panel_of(mixed, genes, rates, TIMES)
    assert (panel.low[1:] < 0.2).all() and (panel.upper[:, 1:].max(axis=0) > 0.5).all() and (panel.scale[1:, 1:] == 1).all()
    with pytest.warns(UserWarning, match="not at rest"):
        found = fit.fit_network(to_fit, panel, least_rounds=3, most_rounds=3)
    scored = spark.createDataFrame(
        [(i, j, float(abs(found.network.w[i, j])), bool(w[i, j])) for j in range(1, 5) for i in range(5) if i != j], "src int, tgt int, score double, truth boolean"
    )
    share = evaluate.random_baseline(scored, "truth").first()[0]
    assert evaluate.aupr(scored, "score", "truth").first()[0] > share + 0.3
    # Self-regulation and the inhibition are there, with their signs.
    assert found.network.w[3, 3] > 1 and found.network.w[4, 1] < -1 and len(found.errors) == 3
    paths = found.trajectories.toPandas()
    assert not paths.duplicated(["sample_id", "id", "t"]).any() and paths.groupby(["sample_id", "id"]).size().eq(len(TIMES)).all()
    cell_time = dict(enumerate(t))
    assert all(cell_time[c] == k for c, k in zip(paths["cell"], paths["t"]))
    again = fit.unit_trajectories(found.trajectories, panel).toPandas()
    assert len(again) == len(paths) and np.stack(again["prot"]).max() <= 1 + 1e-6
    learned = fit.rates_of(fit.unit_trajectories(found.trajectories, panel), found.network, panel, genes).toPandas()
    assert (learned["d1"] > 0).all() and learned["ratio"].between(1, 50).all()


def test_no_cells(spark):
    panel = fit.Panel([0.0, 1.0], np.full(3, 0.1), np.full(3, 0.1), np.full((2, 3), 0.5), np.ones((3, 3)))
    none = spark.createDataFrame([], "cell_id bigint, sample_id string, time_h double, xs array<double>, kon array<double>, odds array<double>, more string")
    found = fit.fit_network(none, panel)
    assert not found.network.w.any() and found.errors == [] and found.trajectories.count() == 0
    one = spark.createDataFrame([(1, None, 0.0, [0.0] * 3, [1.0] * 3, [0.0] * 3), (2, "s", None, [0.0] * 3, [1.0] * 3, [0.0] * 3)], "cell_id bigint, sample_id string, time_h double, xs array<double>, kon array<double>, odds array<double>")
    assert fit.fit_network(one, panel).errors == []


def test_modes_keep_their_weight():
    rng = np.random.default_rng(0)
    odds, kon = rng.normal(size=(200, 2)), rng.random((200, 2))
    for entropy in (0.0, 0.3):
        up = fit.updated_modes(odds, kon, np.zeros(200, bool), np.array([0.1, 0.1]), np.array([0.25, 0.5]), 1.0, entropy)
        assert np.allclose(up.mean(axis=0), [0.25, 0.5], atol=0.03)
        assert odds[up[:, 0], 0].min() >= odds[~up[:, 0], 0].max()
    # With the network's word, cells that it holds high come first.
    near = fit.updated_modes(np.zeros((4, 1)), np.array([[0.9], [0.1], [0.8], [0.2]]), np.ones(4, bool), np.array([0.1]), np.array([0.5]), 0.1, 0.0)
    assert near[:, 0].tolist() == [True, False, True, False]


def test_switch_time_is_the_first_that_is_nearer_to_the_end():
    panel = fit.Panel([0.0, 10.0], np.array([1.0, 5.0]), np.array([1.0, 0.0]), np.zeros((2, 2)), np.ones((2, 2)))
    net = fit.Network(np.array([[0.0, 0.0], [0.0, 20.0]]), np.array([0.0, -10.0]))
    p0, p1, zero, one = np.array([[1.0, 0.0]]), np.array([[1.0, 1.0]]), np.array([[0.0]]), np.array([[1.0]])
    out = fit.switched(net, panel, np.array([[0.5]]), p0, np.array([[0.0, 0.0]]), zero, p1, np.array([[1.0, 1.0]]), one, 10.0)
    brute = next(k / 25 for k in range(1, 25) if (q := fit.flow(zero, zero, one, np.minimum(0.5 / (k / 25), 1), 5.0, k / 25 * 10)[0, 0]) > 0.5)
    assert out[0, 0] == pytest.approx(brute)
    # No change of mode: the old one stays.
    assert fit.switched(net, panel, np.array([[0.5]]), p0, np.array([[0.0, 0.9]]), zero, p1, np.array([[1.0, 1.0]]), one, 10.0)[0, 0] == 0.5


def test_levels_of_two_modes_are_regressed(spark):
    """Gradient steps by hand give the same optimum."""
    rng = np.random.default_rng(5)
    prot = np.hstack([np.ones((400, 1)), rng.random((400, 2))])
    low = np.array([1.0, 0.2, 0.05])
    kon = np.hstack([np.ones((400, 1)), np.where(rng.random((400, 2)) < 1 / (1 + np.exp(-4 * (prot[:, 1:] - 0.5))), 1.0, low[1:])])
    rows = spark.createDataFrame([(p.tolist(), k.tolist(), 1.0) for p, k in zip(prot, kon)], "prot array<double>, kon array<double>, weight double")
    scale = np.array([[0, 0.2, 0.2], [0, 1, 1], [0, 1, 0.0]])
    got = network.fit_rows(rows, scale, low, strength=0.01, tolerance=1e-12)
    assert got.open == 0 and got.error < got.error_before and got.w[2, 2] == 0

    def objective(u, j):
        s = prot @ (scale[:, j] * u[:3]) + u[3]
        k = low[j] + (1 - low[j]) / (1 + np.exp(-s))
        return -(kon[:, j] * np.log(k) + (1 - kon[:, j]) * np.log(np.maximum(1 - k, 1e-300))).mean() + 0.01 * np.abs(u[:3]).sum()

    for j in (1, 2):
        u = np.append(np.where(scale[:, j] > 0, got.w[:, j] / np.where(scale[:, j] > 0, scale[:, j], 1), 0), got.b[j])
        best = objective(u, j)
        for k in range(4):
            for step in (-1e-3, 1e-3):
                if k == 3 or scale[k, j] > 0:
                    v = u.copy()
                    v[k] += step
                    assert objective(v, j) >= best - 1e-9
    held = network.fit_rows(rows, scale, low, start=fit.Network(got.w, got.b), reference=fit.Network(got.w, got.b), strength=5.0, ridge=5.0)
    assert np.allclose(held.w, got.w, atol=1e-6)
    larger = network.refined_rows(rows, got, low)
    assert larger.error <= got.error + 1e-9 and ((larger.w == 0) | (got.w != 0)).all() and larger.w[1, 1] == pytest.approx(got.w[1, 1])


def test_nearest_states(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random((20, 2, 3)), rng.random((15, 2, 3))
    frame = lambda m: spark.createDataFrame([(i % 2, i, v[0].tolist(), v[1].tolist()) for i, v in enumerate(m)], "g int, key int, prot array<double>, kon array<double>")
    got = {r["key"]: r["match"] for r in trajectory.nearest_states(frame(a), frame(b), "g", 3).collect()}
    for i in range(20):
        d = [(round(np.abs(a[i, 0] - b[j, 0]).sum() / 3 + np.abs(a[i, 1] - b[j, 1]).sum() * 2 / 3, 9), j) for j in range(15) if j % 2 == i % 2]
        assert got[i] == min(d)[1]


def test_mixed_step_solves_its_equation(spark):
    p, dt = 0.3, 1e-4
    for k in range(int(2 / dt)):
        p += dt * 0.7 * (0.2 + (0.9 - 0.2) * k * dt / 2 - p)
    got = spark.range(1).select(trajectory.next_state_mixed(F.lit(0.3), F.lit(0.7), F.lit(0.2), F.lit(0.9), F.lit(1.0), F.lit(2.0))).first()[0]
    assert got == pytest.approx(p, abs=1e-3)


@pytest.mark.parametrize("density", [0.0, 0.3, 1.0])
def test_cost_against_every_move(density):
    """The cost of every move as its definition has it, with genes that nothing acts on."""
    rng = np.random.default_rng(3)
    n, m, g = 30, 40, 9
    low = np.append(0.0, rng.uniform(0.05, 0.9, g))
    levels = lambda rows: np.hstack([np.ones((rows, 1)), np.where(rng.random((rows, g)) < 0.5, 1.0, low[1:])])
    p0, k0, k1 = np.hstack([np.ones((n, 1)), rng.random((n, g))]), levels(n), levels(m)
    l0, l1, alpha = k0[:, 1:] * rng.uniform(0.8, 1.2, (n, g)), k1[:, 1:] * rng.uniform(0.8, 1.2, (m, g)), rng.random((n, g))
    net = fit.Network(np.where(rng.random((g + 1, g + 1)) < density, rng.normal(size=(g + 1, g + 1)) * 5, 0), rng.normal(size=g + 1))
    panel = fit.Panel([0.0, 6.0], rng.uniform(0.01, 0.2, g + 1), low, np.zeros((2, g + 1)), np.ones((g + 1, g + 1)))
    for turn in (1, 3):
        want = np.empty((n, m))
        for i in range(n):
            for j in range(m):
                prot = fit.flow(p0[i, 1:], l0[i], l1[j], alpha[i], panel.d1[1:], 6.0)
                want[i, j] = ((1 - 1 / g) * ((k1[j] - k0[i])[1:] ** 2).sum() + ((prot - p0[i, 1:]) ** 2).sum() / g) / turn
                k = np.clip(net.kon(np.append(1.0, prot), low), 1e-6, 1 - 1e-6)
                want[i, j] -= (1 - 1 / turn) * (k1[j, 1:] * np.log(k) + (1 - k1[j, 1:]) * np.log(1 - k)).sum()
        assert np.abs(fit._cost(net, panel, p0, k0, l0, alpha, k1, l1, 6.0, turn) - np.minimum(want, 100)).max() < 1e-4


def test_late_couplings_come_to_rest():
    """Where missed targets cost far more than the entropy, as in late turns, plain rounds take thousands."""
    rng = np.random.default_rng(0)
    args = rng.random((60, 50)) + 5, np.full(60, 1 / 60), np.full(50, 1 / 50), 0.15, 20.0
    q = trajectory.sinkhorn(*args, rounds=40)
    assert np.abs(q - trajectory.sinkhorn(*args, rounds=50_000, tolerance=1e-13)).max() < 1e-6 * q.max()


def test_regression_sums_only_targets_that_are_not_at_rest(spark, monkeypatch):
    """Sums of rows by their definition; a target at rest isn't summed again, and a measured error needs no curvature."""
    rng = np.random.default_rng(7)
    a, y, n, w, low = np.hstack([rng.random((300, 4)), np.ones((300, 1))]), rng.random((300, 3)), rng.random((300, 1)), rng.normal(size=(5, 3)), np.array([0.1, 0.0, 0.6])
    p = 1 / (1 + np.exp(-a @ w))
    k = low + (1 - low) * p
    h = n * (1 - low) * p * p * (1 - p) / k
    want = [-(n * (y * np.log(k) + (1 - y) * np.log(1 - k))).sum(axis=0)[:, None], np.full((3, 1), n.sum()), (n * (k - y) * p / k).T @ a, np.stack([((a * x[:, None]).T @ a)[np.triu_indices(5)] for x in h.T])]
    assert np.allclose(network._terms(a, y, n, w, low), np.hstack(want), rtol=1e-5)
    asked, sums = [], network._sums
    monkeypatch.setattr(network, "_sums", lambda rows, names, *more: asked.append((names.tolist(), more[-1])) or sums(rows, names, *more))
    kon = np.hstack([np.ones((300, 1)), np.tile([0.5], (300, 1)), np.where(rng.random((300, 1)) < a[:, 1:2], 1.0, 0.1)])
    rows = spark.createDataFrame([(p[:3].tolist(), v.tolist(), 1.0) for p, v in zip(a, kon)], "prot array<double>, kon array<double>, weight double")
    found = network.fit_rows(rows, np.array([[0, 1, 1], [0, 0, 1], [0, 0, 1.0]]), np.array([1.0, 0.0, 0.1]), strength=0.01)
    assert asked[0] == ([1, 2], True) and asked[-1] == ([2], True) and found.open == 0
    network.fit_rows(rows, np.ones((3, 3)), np.array([1.0, 0.0, 0.1]), start=found, rounds=0)
    assert asked[-1] == ([1, 2], False)


def test_tables_of_earlier_turns_are_deleted(spark):
    rng = np.random.default_rng(8)
    low = np.array([1.0, 0.1, 0.1])
    cells = [(i, "s", float(i % 2), [1.0, *rng.random(2).tolist()], [1.0, *np.where(rng.random(2) < 0.5, 1.0, 0.1).tolist()], [0.0, *rng.normal(size=2).tolist()]) for i in range(40)]
    df = spark.createDataFrame(cells, "cell_id bigint, sample_id string, time_h double, xs array<double>, kon array<double>, odds array<double>")
    panel = fit.Panel([0.0, 1.0], np.full(3, 0.1), low, np.full((2, 3), 0.5), np.ones((3, 3)))
    folder = tables_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with pytest.warns(UserWarning, match="not at rest"):
        found = fit.fit_network(df, panel, least_rounds=3, most_rounds=3)
    # What is left are the last turn's states and the list of samples.
    assert len(set(os.listdir(folder)) - before) == 2 and found.trajectories.count() == 40


def test_fixed_network_writes_only_states(spark, monkeypatch):
    """With a given network the trajectories are read once a turn, so no table of them with their weights is made."""
    rng = np.random.default_rng(9)
    low = np.array([1.0, 0.1, 0.1])
    cells = [(i, "s", float(i % 2), [1.0, *rng.random(2).tolist()], [1.0, *np.where(rng.random(2) < 0.5, 1.0, 0.1).tolist()], [0.0, *rng.normal(size=2).tolist()]) for i in range(40)]
    df = spark.createDataFrame(cells, "cell_id bigint, sample_id string, time_h double, xs array<double>, kon array<double>, odds array<double>")
    panel = fit.Panel([0.0, 1.0], np.full(3, 0.1), low, np.full((2, 3), 0.5), np.ones((3, 3)))
    net, written, cut = fit.Network(rng.normal(size=(3, 3)), np.zeros(3)), [], fit.cut
    monkeypatch.setattr(fit, "cut", lambda df: written.append(df.columns) or cut(df))
    with pytest.warns(UserWarning, match="not at rest"):
        found = fit.fit_network(df, panel, fixed=net, least_rounds=2, most_rounds=2)
    assert len(found.errors) == 2 and sum("weight" in c for c in written) == 0 and sum("prot" in c for c in written) == 3
    assert found.errors[-1] == pytest.approx(network.fit_rows(fit.weighted(found.trajectories.select("sample_id", "prot", "kon")), panel.scale, panel.low, start=net, rounds=0).error)
