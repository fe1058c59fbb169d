import numpy as np
import pytest

from chronocount.llm.vectors import _among_all, expand_pairs, make_table, near_pairs, nearest, probes, tried_pairs, usable


def frame(spark, v, ids=None):
    ids = range(len(v)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(np.float32(x)) for x in r], "clash") for i, r in zip(ids, v)], "key bigint, v array<float>, rep string")


def test_probes_cover_the_radius():
    rng = np.random.default_rng(0)
    t = make_table(6, 4, 3.0, 1)
    a = rng.normal(size=(500, 6)) * 5
    d = rng.normal(size=(500, 6))
    b = a + d / np.linalg.norm(d, axis=1, keepdims=True) * rng.random((500, 1)) * 0.5
    row, at, score = probes(t, a, 0.5)
    seen = set(zip(row.tolist(), at.tolist()))
    assert all((i, h) in seen for i, h in enumerate(t.bucket(t.slots(b)[0]).tolist())) and score[:500].max() == 0


@pytest.mark.parametrize("dim", [1, 2, 24])
def test_near_pairs_against_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(400, dim)) * (40 if dim < 3 else 3)
    v[200:300] = v[:100] + rng.normal(size=(100, dim)) * 0.5 / np.sqrt(dim)
    v[300:320] = v[0]
    v = v.astype(np.float32)
    pairs, members = near_pairs(usable(frame(spark, v), "key", "v", dim), dim, 0.5)
    d = np.sqrt(((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(-1))
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if d[i, j] <= 0.5}
    assert {tuple(r) for r in expand_pairs(pairs, members).collect()} == want
    assert pairs.count() < len(want)


def test_near_pairs_over_parts(spark, monkeypatch):
    """Pairs that planes part, between parts and within them."""
    monkeypatch.setattr("chronocount.llm.vectors.LEAST_PART", 64)
    monkeypatch.setattr("chronocount.llm.vectors.LEAF", 16)
    rng = np.random.default_rng(7)
    v = rng.normal(size=(1500, 3)).astype(np.float32) * 2
    pairs, members = near_pairs(usable(frame(spark, v), "key", "v", 3), 3, 0.5)
    d = np.sqrt(((v[:, None].astype(float) - v[None].astype(float)) ** 2).sum(-1))
    want = {(i, j) for i in range(1500) for j in range(i + 1, 1500) if d[i, j] <= 0.5}
    assert {tuple(r) for r in expand_pairs(pairs, members).collect()} == want and pairs.count() == len(want)


def test_a_dense_cluster_is_not_tried_pair_by_pair():
    """Eight times the vectors of one cluster: far less than eight times the pairs tried for each."""
    rng = np.random.default_rng(8)
    each = [sum(n for _, _, n in tried_pairs(rng.normal(size=(rows, 24)) * 0.7, 0.5)) / rows for rows in (4_000, 32_000)]
    assert each[1] < 3 * each[0] and each[1] < 3_200


def test_unusable_vectors(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])]
    df = usable(spark.createDataFrame(rows, "key bigint, v array<float>"), "key", "v", 2)
    assert {r["key"] for r in df.collect()} == {1}
    pairs, members = near_pairs(df, 2, 0.5)
    assert pairs.count() == 0 and members.count() == 1 and expand_pairs(pairs, members).count() == 0
    none = df.filter("key < 0")
    assert near_pairs(none, 2, 0.5)[0].count() == 0 and nearest(none, none, 2).count() == 0


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    v = (rng.normal(size=(20, 12)) * 4)[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 12))
    base = usable(frame(spark, v), "key", "v", 12)
    got = {}
    for r in nearest(base.filter("key % 50 = 0"), base, 12, k=10, full=150).collect():
        got.setdefault(r["key"], set()).add(r["neighbour"])
    hits = 0
    for q in range(0, 2000, 50):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        assert len(got[q]) == 10
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits / 400 >= 0.9


def test_few_vectors_are_all_found(spark):
    base = usable(frame(spark, [[0.0, 0.0], [100.0, 0.0], [0.0, 900.0], [0.0, 0.0]]), "key", "v", 2)
    got = [(r["key"], r["rank"], r["neighbour"]) for r in nearest(base, base, 2, k=5).orderBy("key", "rank").collect()]
    assert len(got) == 12 and got[:3] == [(0, 1, 3), (0, 2, 1), (0, 3, 2)]


def test_blocks_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.integers(0, 4, (300, 3)).astype(float)  # many ties
    base = usable(frame(spark, v), "key", "v", 3)
    want = []
    for q in range(0, 300, 30):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        order = [int(i) for i in np.lexsort((np.arange(300), d)) if i != q][:5]
        want += [(q, r + 1, i, d[i]) for r, i in enumerate(order)]
    monkeypatch.setattr("chronocount.llm.vectors.PART", 16)
    got = [tuple(r) for r in _among_all(base.filter("key % 30 = 0"), base, 3, 5).orderBy("key", "rank").collect()]
    assert got == want
