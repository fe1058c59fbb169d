"""Invariants and small brute-force checks of the core operators."""

import datetime as dt
import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronocount.functions.nb import nb_pmf
from chronocount.operators import compare, depth, dynamics, evaluate, fit, mixture, network, selection, trajectory
from chronocount.operators.counts import counts_long, one_row_per_cell, pack_by_cell, plain_label
from chronocount.sources import text
from chronocount.streaming.events import daily_counts, run_daily_counts


def test_pack_by_cell(spark):
    rows = [(1, 1, 5), (1, 1, 5), (1, 2, None), (1, 3, -1), (1, 4, 2_000_000), (2, 1, 0), (1, 2, 7), (None, 1, 1), (3, None, 1)]
    df = spark.createDataFrame(rows, "cell_id bigint, gene_id int, x bigint").withColumn("codes", F.lit("clash"))
    got = {tuple(r) for r in counts_long(pack_by_cell(df.repartition(3))).collect()}
    assert got == {(1, 1, 5), (1, 2, 7), (1, 3, None), (1, 4, None), (2, 1, 0)}
    assert pack_by_cell(df.limit(0)).count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("Stem-Early ",), ("stem_early",), (" n/a",), (None,), ("Unknown ",), ("Glia A",)], "t string")
    assert [r[0] for r in df.select(plain_label("t")).collect()] == ["stemearly", "stemearly", None, None, None, "gliaa"]


def test_first_delivery(spark):
    df = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 2)), (1, "b", dt.datetime(2024, 1, 1)), (None, "c", None)], "cell_id bigint, cell_type string, load_ts timestamp")
    assert [tuple(r)[:2] for r in one_row_per_cell(df).collect()] == [(1, "b")]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(0)
    x = rng.negative_binomial(2, 0.3, (60, 5)) * (rng.random((60, 5)) < 0.7)
    counts = spark.createDataFrame([(i, g, int(x[i, g])) for i in range(60) for g in range(5) if x[i, g]], "cell_id bigint, gene_id int, x bigint")
    cells = spark.createDataFrame([(i, float(i % 3), f"s{i % 2}", "ab"[i % 2], 1.0) for i in range(60)], "cell_id bigint, time_h double, sample_id string, cell_type string, rd double")
    return x, counts, cells


def test_moments_with_zeros(small):
    x, counts, cells = small
    got = {r["gene_id"]: r for r in depth.gene_moments(counts, cells).collect()}
    for g in range(5):
        assert got[g]["mean"] == pytest.approx(x[:, g].mean()) and got[g]["var"] == pytest.approx(x[:, g].var())


def test_cv2_against_matrix(small):
    x, counts, cells = small
    c = np.cov(x.T) / np.outer(x.mean(0), x.mean(0))
    assert depth.cv2_read_depth(counts, cells).first()["cv2"] == pytest.approx(max((c.sum() - np.trace(c)) / 20, 0))


def test_pearson_against_matrix(small):
    x, counts, cells = small
    c = np.corrcoef(x.T)
    got = compare.pearson_matrix(pack_by_cell(counts), list(range(5)), 60).collect()
    assert len(got) == 10 and compare.pearson_matrix(pack_by_cell(counts.limit(0)), [], 60).count() == 0
    for r in got:
        assert r["r"] == pytest.approx(c[r["gene_a"], r["gene_b"]])


def test_partial_correlation_and_components_against_matrix(spark, small):
    x, counts, cells = small
    packed, panel = pack_by_cell(counts), list(range(5))
    inverse = np.linalg.inv(np.corrcoef(x.T))
    got = {(r["gene_a"], r["gene_b"]): r["sign"] for r in compare.partial_corr_sign(compare.pearson_matrix(packed, panel, 60), panel).collect()}
    assert got == {(i, j): -int(np.sign(inverse[i, j])) for i in range(5) for j in range(i + 1, 5)}
    assert compare.partial_corr_sign(compare.pearson_matrix(packed.limit(0), [], 0), []).count() == 0
    # A cell without rows isn't packed.
    own = x[x.sum(axis=1) > 0]
    value, vector = np.linalg.eigh(np.cov(np.log1p(own).T))
    pc = {r["cell_id"]: r["pc"] for r in compare.principal_components(packed, panel, 2).collect()}
    lead = vector[:, ::-1][:, :2]
    lead = lead * np.sign(lead[np.abs(lead).argmax(axis=0), [0, 1]])
    assert all(np.allclose(pc[i], np.log1p(x[i]) @ lead, atol=1e-6) for i in pc) and len(pc) == len(own)
    assert compare.principal_components(packed.limit(0), panel, 2).count() == 0


def test_evenly_spaced_times(spark):
    df = spark.createDataFrame([(float(t), "clash") for t in range(23)] + [(None, "x")], "time_h double, _i string")
    got = sorted(r["time_h"] for r in compare.evenly_spaced(df, "time_h", 10).collect())
    assert got == [float(v) for v in np.round(np.linspace(0, 22, 10)).astype(int)]
    assert compare.evenly_spaced(df.filter("time_h < 4"), "time_h", 10).count() == 4 and compare.evenly_spaced(df.limit(0), "time_h").count() == 0


def test_transport_cost_by_hand(spark):
    # 0, 0, 4 against 1, 3: two thirds stay below, the half of the other side ends at 1/2.
    rows = [("g", True, 0, 2), ("g", True, 4, 1), ("g", False, 1, 1), ("g", False, 3, 1), ("h", True, 1, 1)]
    df = spark.createDataFrame(rows, "k string, early boolean, x bigint, n bigint")
    got = compare.transport_cost(df, ["k"], F.col("early")).collect()
    assert len(got) == 1 and got[0]["cost"] == pytest.approx(1 / 2 * 1 + 1 / 6 * 9 + 1 / 3 * 1)


def test_signs_and_prior_matrix_by_hand(spark):
    effects = {"inhibits": -1, "Downregulation": -1, "antagonist of": -1, "down": 1, "block": 1, "up-regulates": 1, "transcriptional repression": -1, None: 1, "": 1}
    df = spark.createDataFrame([(e,) for e in effects], "effect string")
    assert [r[0] for r in df.select(network.effect_sign("effect")).collect()] == list(effects.values())
    genes = spark.createDataFrame([(0, "Stim", "x"), (1, "A", "x"), (2, "B", "x"), (3, "C", "x"), (4, None, "x")], "gene_id int, gene_name string, w string")
    pairs = spark.createDataFrame([("A", "B", 1), ("B", "A", -1)], "src string, tgt string, sign int")
    got = {(r["src"], r["tgt"]): r["w"] for r in network.prior_matrix(pairs, genes).collect()}
    want = {(s, t): 0.0 if s == 0 else 1.0 for s in range(5) for t in range(1, 5)} | {(s, t): 0.0 for s in (2, 3, 4) for t in (1, 2)} | {(3, 2): 0.0, (1, 1): 1.0, (2, 2): 1.0}
    assert got == want


def test_starting_states_by_hand(spark):
    rows = [(1, 1, 0.0, 0.1), (2, 1, 0.3, 0.1), (3, 1, 2.0, 1.0), (4, 2, 0.7, 1.0)]
    df = spark.createDataFrame(rows, "cell_id int, gene_id int, x double, level double")
    got = {r["cell_id"]: r["prot"] for r in trajectory.initial_states(df).collect()}
    shrink = lambda x, m: x - (x - m) * (a := (abs(x - m) / (2 * m)) ** 2) / (1 + a)
    s = [shrink(x, m) for _, g, x, m in rows if g == 1]
    s = [v - min(s) for v in s]
    low = [0.1 + 0.9 * np.sqrt(v / max(s[1], s[2] / 2)) / 2 for v in s[:2]]
    assert got[1] == pytest.approx(low[0]) and got[2] == pytest.approx(low[1]) and got[3] == pytest.approx(1.0) and got[4] == 1.0


def test_half_lives(spark):
    known = spark.createDataFrame([("Abcd", 2.0, 10.0), ("Abce", 4.0, None), ("Z", 1.0, None)], "known string, rna double, prot double")
    names = spark.createDataFrame([("Abcd",), ("Abce",), ("Qq",), ("Zz",)], "name string")
    got = {r["name"]: (r["d0"], r["d1"]) for r in trajectory.halflife_rates(names, known).collect()}
    ratio = 10.0 / (7 / 3)
    assert got["Abcd"] == pytest.approx((np.log(2) / 2, np.log(2) / 10)) and got["Abce"] == pytest.approx((np.log(2) / 4, np.log(2) / (4 * ratio)))
    assert got["Qq"] == pytest.approx((np.log(2) / (7 / 3), np.log(2) / 10)) and got["Zz"] == pytest.approx((np.log(2), np.log(2) / ratio))


def test_low_modes_are_not_pushed_up():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.poisson(rng.gamma(0.05, 4.0, 4000)), rng.poisson(rng.gamma(5.0, 4.0, 1000))])
    v, n = np.unique(x, return_counts=True)
    k, c, w = mixture.fit_gene(np.zeros(len(v)), v, n)
    assert k[0] / c < 0.5 and 14 < k[1] / c < 30


def test_poisson_genes_stop_at_equal_sets(spark, small):
    _, counts, cells = small
    got = {r["gene_id"] for r in depth.poisson_genes(counts, cells).collect()}
    assert got == {r["gene_id"] for r in depth.poisson_genes(counts, cells, rounds=50).collect()}


def test_seeded_ranks_and_batches(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(300)], "key int, g string")
    for n in (1, 7):
        ranks = selection.group_rank(df.repartition(n), ["g"], "key", 5).collect()
        for g in ("hot", None):
            own = sorted((r for r in ranks if r["g"] == g), key=lambda r: hashlib.md5(f"5|{r['key']}".encode()).hexdigest())
            assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and {r["group_size"] for r in own} == {len(own)}
    one, two = ({r["key"]: r["batch"] for r in selection.shuffled(df, "g", "key", 50, turn).collect()} for turn in (1, 2))
    assert one != two and set(one.values()) == {0, 1, 2, 3}


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=700), np.full(300, 0.25)])
    df = spark.createDataFrame([(float(x), "clash") for x in v] + [(None, "a"), (float("nan"), "b")], "v double, n string").repartition(5)
    at = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert selection.quantiles(df, "v", at) == pytest.approx(np.quantile(v, at).tolist())
    assert selection.quantiles(df.limit(0), "v", [0.5]) == [None] and selection.panel_bins(df.limit(0), "n", "v", 4).count() == 0


def test_shared_folder(spark):
    from chronocount import session

    df = session.cut(spark.range(3).toDF("a"))
    assert df.count() == 3 and session.tables_dir(spark).startswith(session.shared_dir(spark))

    class Far:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: Far.conf)

    with pytest.raises(RuntimeError):
        session.shared_dir(Far)


def test_partitions_do_not_matter(spark, small):
    _, counts, cells = small
    out = [sorted(map(tuple, compare.histogram(counts.repartition(n), cells.repartition(n), ["time_h"]).collect())) for n in (1, 7)]
    assert out[0] == out[1]
    drawn = [sorted(map(tuple, mixture.sample_nb(counts.repartition(n), ["cell_id", "gene_id"], F.lit(2.0), F.lit(0.5)).collect())) for n in (1, 7)]
    assert drawn[0] == drawn[1]


def test_empty_tables(spark, small):
    _, counts, cells = small
    none = counts.limit(0)
    assert depth.gene_moments(none, cells).count() == 0
    assert compare.histogram(none, cells, ["time_h"]).count() == 0
    assert {r["rd"] for r in depth.read_depth(none, cells, none.select("gene_id")).collect()} == {1.0}


def test_nb_pmf_sums_to_one(spark):
    total = spark.range(400).agg(F.sum(nb_pmf(F.col("id"), F.lit(3.7), F.lit(0.2)))).first()[0]
    assert total == pytest.approx(1, abs=1e-9)


def test_fit_recovers_two_modes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.poisson(rng.gamma(1.0, 2.0, 3000)), rng.poisson(rng.gamma(40.0, 2.0, 3000))])
    v, n = np.unique(x, return_counts=True)
    k, c, w = mixture.fit_gene(np.zeros(len(v)), v, n)
    assert k[0] / c < 8 and 65 < k[1] / c < 95 and w[0.0].sum() == pytest.approx(1)
    assert (w[0.0] * k / c).sum() == pytest.approx(x.mean(), rel=0.2)


def test_sinkhorn_marginals():
    rng = np.random.default_rng(2)
    cost, mu, nu = rng.random((20, 15)), np.full(20, 1 / 20), rng.dirichlet(np.ones(15))
    q = trajectory.sinkhorn(cost, mu, nu, 0.1)
    assert np.allclose(q.sum(1), mu, atol=1e-5) and np.allclose(q.sum(0), nu, atol=1e-5)
    free = trajectory.sinkhorn(cost, mu, nu, 0.1, soft=1e6)
    assert np.allclose(free, q, atol=1e-4)


def _net(g=4):
    w = np.zeros((g, g))
    w[0, 1], w[1, 2], w[1, 3] = 6, 6, -6
    return dynamics.Network(w, np.array([0, -3.0, -3.0, 3.0]), np.full(g, 0.05), np.full(g, 0.2), np.full(g, 4.0))


def test_levels_of_a_wide_network_come_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    w, b, low, prot = rng.normal(size=(9, 40)), rng.normal(size=40), rng.random(40), rng.random((50, 5))
    frame = pd.DataFrame({"key": range(50), "gene": [np.array([2, 4, 6, 7, 99])] * 50, "prot": list(prot)})
    monkeypatch.setattr("chronocount.operators.network.VALUES", 400)
    parts = list(network._levels(frame, np.arange(9), w, b, low))
    assert max(k.size for _, k in parts) == 400 and [i for p, _ in parts for i in p["key"]] == list(range(50))
    up = 1 / (1 + np.exp(-(b + prot[:, :4] @ w[[2, 4, 6, 7]])))  # gene 99 is in no edge
    assert np.allclose(np.concatenate([k for _, k in parts]), low * (1 - up) + up)
    edges = spark.createDataFrame([(s, t, float(w[s, t])) for s in range(9) for t in range(40)], "src int, tgt int, w double")
    at = spark.createDataFrame([(t, float(b[t]), float(low[t])) for t in range(40)], "tgt int, b double, low double")
    states = spark.createDataFrame([(i, g, float(prot[i, j])) for i in range(50) for j, g in enumerate((2, 4, 6, 7, 99))], "key bigint, gene_id int, prot double")
    got = {(r["key"], r["tgt"]): r["kon"] for r in network.kon(states, edges, at.select("tgt", "b"), "key", at.select("tgt", "low")).collect()}
    assert len(got) == 2000 and all(got[i, t] == pytest.approx(low[t] * (1 - up[i, t]) + up[i, t]) for i in range(50) for t in range(40))


def test_simulation_and_perturbation(spark):
    states = spark.createDataFrame([(i, [1.0, 0.1, 0.1, 0.1]) for i in range(30)], "cell_id bigint, prot array<double>")
    combos = spark.createDataFrame([(1, [1], []), (2, [], [1])], "combo_id bigint, off array<int>, on array<int>")
    end = {(r["combo_id"], r["cell_id"]): r for r in dynamics.simulate(states, _net(), [0.0, 40.0], combos=combos).filter("time_h = 40").collect()}
    assert end[1, 0]["prot"][1] < 0.01 and end[1, 0]["prot"][3] > 0.8
    assert end[2, 0]["prot"][1] > 0.99 and end[2, 0]["prot"][2] > 0.8 and end[2, 0]["prot"][3] < 0.3
    jumps = np.array([r["prot"] for r in dynamics.simulate(states, _net(), [0.0, 40.0], jumps=True).filter("time_h = 40").collect()])
    assert (jumps >= 0).all() and 0.4 < jumps[:, 1].mean() < 1.6
    again = [sorted((r["cell_id"], r["time_h"], tuple(r["prot"])) for r in dynamics.simulate(states.repartition(n), _net(), [0.0, 5.0], jumps=True).collect()) for n in (1, 6)]
    assert again[0] == again[1]


def test_ode_without_edges_is_exact():
    net = dynamics.Network(np.zeros((2, 2)), np.array([0, 100.0]), np.zeros(2), np.full(2, 0.1), np.ones(2))
    path = dynamics.ode_path(net, np.array([[1.0, 0.0]]), np.array([0.0, 5.0]))
    assert path[1][0][1] == pytest.approx(1 - np.exp(-0.5), rel=1e-6) and path[1][0][0] == 1.0


def test_planted_network_is_found(spark):
    rng = np.random.default_rng(4)
    prot = rng.random((800, 5))
    true = {(1, 2): 8.0, (3, 4): -8.0}
    rows, ys = [], []
    for i, p in enumerate(prot):
        rows.append((i, p.tolist()))
        for t in range(5):
            s = sum(w * (p[a] - 0.5) for (a, b), w in true.items() if b == t)
            ys.append((i, t, float(rng.random() < 1 / (1 + np.exp(-s)))))
    mask = spark.createDataFrame([(t, [float(g != t) for g in range(5)]) for t in range(5)], "tgt int, m array<double>")
    got = network.regress(spark.createDataFrame(rows, "k int, prot array<double>"), spark.createDataFrame(ys, "k int, tgt int, y double"), mask, "k", 0.01)
    scored = got.filter("src >= 0 and src <> tgt").withColumn("truth", F.when(F.expr("(src = 1 and tgt = 2) or (src = 3 and tgt = 4)"), 1).otherwise(0))
    assert evaluate.aupr(scored, "w", "truth").first()[0] > 0.9
    signs = {(r["src"], r["tgt"]): r["w"] for r in got.collect()}
    assert signs[1, 2] > 0 > signs[3, 4]


def test_regression_is_the_optimum_over_all_tasks(spark):
    rng = np.random.default_rng(7)
    common = rng.random((600, 1))
    prot = 0.97 * common + 0.03 * rng.random((600, 6))  # nearly equal states: gradient rounds stop far from the optimum
    prob = 1 / (1 + np.exp(-60 * (prot[:, 1] - prot[:, 2]) - 4 * (prot[:, 0] - 0.5)))
    y = (rng.random((600, 2)) < np.stack([prob, 1 - prob], axis=1)).astype(float)
    states = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(prot)], "k int, prot array<double>")
    ys = spark.createDataFrame([(i, t, float(y[i, t])) for i in range(600) for t in range(2)], "k int, tgt int, y double")
    mask = spark.createDataFrame([(t, [0.5] + [1.0] * 5) for t in range(2)], "tgt int, m array<double>")
    parts = [{(r["src"], r["tgt"]): r["w"] for r in network.regress(states.repartition(n), ys, mask, "k", 0.002).collect()} for n in (1, 5)]
    assert parts[0] == pytest.approx(parts[1], abs=1e-6)
    for t in range(2):
        w = np.array([parts[0][i, t] for i in (*range(6), -1)])
        m = np.array([0.5] + [1.0] * 5)
        off = 1 / (1 + np.exp(-(prot @ w[:-1] + w[-1]))) - y[:, t]
        slope = m * (prot.T @ off) / 600
        assert abs(off.mean()) < 1e-5
        assert np.allclose(slope[w[:-1] != 0], -0.002 * np.sign(w[:-1][w[:-1] != 0]), atol=1e-5) and (np.abs(slope) < 0.002 + 1e-5).all()


def test_sources(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("0\t0\t6\n0\t0\t1\n1\t5\t7\n\n")
    got = {tuple(r) for r in text.scan_text_matrix(spark, str(tmp_path / "m.tsv")).collect()}
    assert got == {(0, 1, 0.0, 0), (0, 2, 6.0, 1), (1, 1, 0.0, 5), (1, 2, 6.0, 7)}
    (tmp_path / "g.tsv").write_text("0   Stimulus\n1\tAbc1\n")
    assert [tuple(r) for r in text.scan_gene_names(spark, str(tmp_path / "g.tsv")).orderBy("gene_id").collect()] == [(0, "Stimulus"), (1, "Abc1")]
    (tmp_path / "r.txt").write_text("1 1\n.2\t0.04\n.4 x\n")
    assert [tuple(r) for r in text.scan_rates(spark, str(tmp_path / "r.txt")).orderBy("gene_id").collect()] == [(1, 0.2, 0.04), (2, 0.4, None)]
    (tmp_path / "p.csv").write_text(",A,B\nA,1,-2\nB,,1\n")
    assert {tuple(r) for r in text.scan_prior_matrix(spark, str(tmp_path / "p.csv")).collect()} == {("A", "A", 1.0), ("A", "B", 2.0), ("B", "A", None), ("B", "B", 1.0)}
    (tmp_path / "k.tsv").write_text("KO\tOV\nA1, B2\t0\n0\t0\n0\tC\n")
    assert [tuple(r)[1:] for r in text.scan_perturbations(spark, str(tmp_path / "k.tsv")).orderBy("combo_id").collect()] == [(["A1", "B2"], []), ([], ["C"])]
    (tmp_path / "t.txt").write_text("6\n12\n\n")
    assert sorted(r[0] for r in text.scan_time_list(spark, str(tmp_path / "t.txt")).collect()) == [0.0, 6.0, 12.0]
    text.sink_tables({"a": spark.range(3)}, str(tmp_path / "out"))
    text.sink_report(spark.range(2), str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "out/a.parquet")).count() == 3 and spark.read.csv(str(tmp_path / "rep"), header=True).count() == 2


def test_stream_equals_table(spark, tmp_path):
    day = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [(i, day(1 + i % 6, i % 24), i % 3, "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string")
    df.write.parquet(str(tmp_path / "in"))
    run_daily_counts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    table = {tuple(r) for r in daily_counts(df).collect()}
    stream = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert stream and stream <= table


def test_prefix_fallback(spark):
    known = spark.createDataFrame([("Abcd", 1.0), ("Abce", 3.0), ("Z", 8.0)], "known string, v double")
    names = spark.createDataFrame([("Abcd",), ("Abcx",), ("Qq",)], "name string")
    got = {r["name"]: (r["matched"], r["n_known"], r["value"]) for r in trajectory.prefix_fallback(names, known, "v").collect()}
    assert got == {"Abcd": ("Abcd", 1, 1.0), "Abcx": ("Abc", 2, 2.0), "Qq": ("", 3, 4.0)}


def test_graph_paths(spark):
    edges = spark.createDataFrame([(1, "a", "m", 1), (2, "m", "b", -1), (3, "a", "c", 1), (4, "c", "b", 1), (5, "a", "d", -1)], "key int, src string, tgt string, sign int")
    listed = spark.createDataFrame([("a",), ("b",), ("d",)], "node string")
    assert {tuple(r) for r in network.prior_paths(edges, listed, 3).collect()} == {("a", "d", -1, 1), ("a", "b", 1, 2)}
    reach = {tuple(r) for r in network.graph_reach(edges, edges.select("src").filter("src = 'a'"), 2).collect()}
    assert ("a", "b", 2) in reach and ("a", "a", 0) in reach


def test_pipeline(spark, tmp_path):
    from chronocount.plans import pipeline

    pipeline.run(spark, "/root/testdata/sf0.001", str(tmp_path), ["depth", "split", "mixture", "modes", "selection", "states"])
    assert spark.read.parquet(str(tmp_path / "selected.parquet")).count() > 0
    modes = spark.read.parquet(str(tmp_path / "mixture.parquet"))
    assert modes.groupBy("gene_id", "time_h").agg(F.sum("w").alias("w")).filter("abs(w - 1) > 1e-6").count() == 0
    with pytest.raises(ValueError):
        pipeline.run(spark, "/root/testdata/sf0.001", str(tmp_path), ["nothing"])


def test_pipeline_passes_its_tables_on(spark, tmp_path, monkeypatch):
    from chronocount.plans import base, pipeline

    source, out = "/root/testdata/sf0.001", str(tmp_path)
    monkeypatch.setattr(pipeline.fit, "fit_network", partial(fit.fit_network, least_rounds=1, most_rounds=1))
    pipeline.run(spark, source, out)
    table = lambda t: spark.read.parquet(f"{out}/{t}.parquet")
    genes = sorted(r[0] for r in table("selected").select("gene_id").distinct().collect())
    parts = {r["cell_id"]: r["part"] for r in table("split").collect()}
    for name, part in (("states", "train"), ("test_states", "test")):
        states = table(name).collect()
        assert states and {parts[r["cell_id"]] for r in states} == {part} and all(len(r[c]) == len(genes) + 1 for r in states for c in ("kon", "xs", "odds", "prot"))
    # The level of a count is that of its mode.
    modes = {(r["gene_id"], r["time_h"], r["x"]): r["kon"] for r in table("modes").collect()}
    x = {(r["cell_id"], r["gene_id"]): r["x"] for r in depth.depth_corrected(base.counts(spark, source), table("rd")).collect()}
    for r in table("states").collect():
        assert r["kon"][1:] == [modes[g, r["time_h"], x.get((r["cell_id"], g), 0)] for g in genes]
    assert {parts[r["cell"]] for r in table("trajectories").select("cell").distinct().collect()} == {"train"}
    for name in ("edges", "unit_edges"):
        assert {(r["src"], r["tgt"]) for r in table(name).collect()} == {(s, t) for s in (-1, 0, *genes) for t in genes}
    assert {r["part"] for r in table("test_errors").collect()} == {"train", "test"}
    times = {r[0] for r in base.cells(spark, source).select("time_h").dropna().distinct().collect()}
    assert {(r["time_h"], r["gene_id"]) for r in table("simulated").collect()} == {(t, g) for t in times for g in genes} and table("checked").count() > 0
    # Another depth gives other edges, other edges give another simulation.
    before = {(r["src"], r["tgt"]): r["w"] for r in table("edges").collect()}
    table("rd").select("cell_id", (F.col("rd") * F.when(F.col("cell_id") % 2 == 0, 4.0).otherwise(0.25)).alias("rd")).write.parquet(f"{out}/other.parquet")
    table("other").write.mode("overwrite").parquet(f"{out}/rd.parquet")
    pipeline.run(spark, source, out, ["mixture", "modes", "states", "network"])
    assert before != {(r["src"], r["tgt"]): r["w"] for r in table("edges").collect()}
    high = [(s, t, 9.0 if s == -1 else 0.0) for s in (-1, 0, *genes) for t in genes]
    spark.createDataFrame(high, "src int, tgt int, w double").write.mode("overwrite").parquet(f"{out}/unit_edges.parquet")
    pipeline.run(spark, source, out, ["simulation"])
    assert all(r["prot"] > 0.5 for r in table("simulated").filter("time_h = 96").collect())


def test_perturbation_of_every_cell_of_the_dataset(spark):
    rng = np.random.default_rng(8)
    prot = np.hstack([np.ones((30, 1)), rng.random((30, 3))])
    states = spark.createDataFrame([("ab"[i % 2], i, p.tolist()) for i, p in enumerate(prot)], "dataset string, cell_id bigint, prot array<double>")
    sets = [(1, "a", [1], []), (2, "b", [], [1]), (3, "b", [2], [3])]
    times = [0.0, 6.0, 40.0]
    got = {(r["set_id"], r["time_h"]): r for r in dynamics.perturbed_means(states, spark.createDataFrame(sets, "set_id bigint, dataset string, off array<int>, on array<int>"), _net(), times).collect()}
    assert len(got) == 9
    for k, d, off, on in sets:
        p = prot["ab".index(d) :: 2].copy()
        p[:, off], p[:, on] = 0.0, 1.0
        for t, want in zip(times, dynamics.ode_path(_net().perturbed(off, on), p, np.array(times))):
            assert got[k, t]["n_cells"] == 15 and np.allclose(got[k, t]["prot"], want.mean(axis=0), atol=1e-9)


def test_paths_are_near_the_exact_ones_in_few_steps(monkeypatch):
    rng = np.random.default_rng(3)
    net = dynamics.Network(rng.normal(0, 2, (30, 30)), rng.normal(size=30), np.append(rng.random(28) * 0.3, [0.0, 1.0]), rng.uniform(0.01, 0.3, 30), np.ones(30))
    p, times = np.hstack([np.ones((40, 1)), rng.random((40, 29))]), np.array([3.0, 9.0, 9.1, 24.0, 99.0])

    def euler(dt):
        q, out = p.copy(), [p.copy()]
        for t in np.diff(times):
            n = int(np.ceil(t / dt))
            for _ in range(n):
                k = net.kon(q)
                q[:, 1:] = (k + (q - k) * np.exp(-net.d1 * t / n))[:, 1:]
            out.append(q.copy())
        return np.stack(out)

    a, b, c = (euler(0.02 / f) for f in (1, 2, 4))
    seen, kept = [], dynamics._schedule
    monkeypatch.setattr(dynamics, "_schedule", lambda *x: seen.append(kept(*x)) or seen[-1])
    got = dynamics.ode_path(net, p, times)
    assert np.abs(got - (a - 6 * b + 8 * c) / 3).max() < 2e-4  # steps of 0.01 / 0.3 are 3e-3 away
    assert len(seen[0]) < 80 and sum(map(len, seen)) < 1000
    # A path doesn't depend on those beside it, nor on other times asked for.
    assert np.allclose(dynamics.ode_path(net, p[7:9], times), got[:, 7:9], atol=1e-12)
    assert np.allclose(dynamics.ode_path(net, p, times[[0, 1, 3, 4]]), got[[0, 1, 3, 4]], atol=1e-12)


def test_perturbed_cells_and_sets_meet_in_the_task(spark, monkeypatch):
    rng = np.random.default_rng(9)
    prot = np.hstack([np.ones((70, 1)), rng.random((70, 3))])
    data = ["b" if i % 7 == 0 else "a" for i in range(70)]
    states = spark.createDataFrame([(data[i], i, p.tolist()) for i, p in enumerate(prot)], "dataset string, cell_id bigint, prot array<double>")
    sets = spark.createDataFrame([(k, d, [1] if k % 2 else [], [2, 3] if k % 3 else [1 + k % 3]) for k, d in enumerate("aab" * 7)], "set_id bigint, dataset string, off array<int>, on array<int>")
    sets = sets.withColumn("off", F.array_except("off", "on"))
    whole = {(r["set_id"], r["time_h"]): r for r in dynamics.perturbed_means(states, sets, _net(), [0.0, 6.0, 40.0]).collect()}
    # Neither pairs nor paths pass an exchange: cells go to parts and salts, sums come out.
    plan = dynamics.perturbed_means(states, sets, _net(), [0.0, 6.0, 40.0])._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    for name, value in (("PART", 20), ("PATHS", 60), ("SETS", 3), ("BLOCK", 16)):
        monkeypatch.setattr(dynamics, name, value)
    got = {(r["set_id"], r["time_h"]): r for r in dynamics.perturbed_means(states, sets, _net(), [0.0, 6.0, 40.0]).collect()}
    assert len(got) == 63 and got.keys() == whole.keys()
    for k, r in got.items():
        assert r["n_cells"] == whole[k]["n_cells"] == (10 if k[0] % 3 == 2 else 60) and np.allclose(r["prot"], whole[k]["prot"], atol=1e-12)


def test_states_of_one_time_are_those_among_all(spark):
    from chronocount.plans import dynamics_queries

    (every, _, genes), (few, _, same) = (dynamics_queries.to_fit(spark, "/root/testdata/sf0.001", *at) for at in ((), (0.0,)))
    want = {r["cell_id"]: r["prot"] for r in every.filter("time_h = 0").collect()}
    got = {r["cell_id"]: r["prot"] for r in few.collect()}
    assert want and genes == same and got.keys() == want.keys() and all(got[k][1:] == want[k][1:] for k in want)


def test_every_listed_perturbation_comes_out(spark):
    from chronocount.plans import base, dynamics_queries

    source = "/root/testdata/sf0.001"
    got = dynamics_queries.perturb(spark, source).collect()
    listed = {tuple(r) for r in spark.read.parquet(f"{source}/ko_ov_list.parquet").select("combo_id", "dataset").distinct().collect()}
    times = {r[0] for r in base.cells(spark, source).select("time_h").dropna().distinct().collect()}
    done = [r for r in got if r["reason"] is None]
    assert {(r["combo_id"], r["dataset"]) for r in got} == listed
    per = {}
    for r in done:
        per.setdefault((r["combo_id"], r["dataset"]), set()).add((r["time_h"], r["gene_id"]))
        assert 0 <= r["prot"] <= 1 and r["n_cells"] > 0
    assert per and all(v == {(t, g) for t in times for g in range(1, 65)} for v in per.values())
    assert len(done) == len(per) * len(times) * 64 and len(got) - len(done) == len(listed) - len(per)
