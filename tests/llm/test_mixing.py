import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from chronocount.llm.mixing import bounded_knapsack, fill, mix_plan, mixed_documents, reached_shares, token_sizes


def test_knapsack_against_brute_force():
    rng = random.Random(0)
    for _ in range(100):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4)))
        counts = np.array([rng.randrange(0, 4) for _ in range(4)])
        budget = rng.randrange(1, 120)
        take = bounded_knapsack(lengths, counts, budget)
        sums = {sum(a * int(b) for a, b in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])}
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_fill_is_full():
    rng = np.random.default_rng(0)
    lengths, counts = np.arange(50, 900, 7), rng.integers(1, 300, 122)
    for budget in (10, 1_000, 1_000_000, 10**9):
        take = fill(lengths, counts, budget, 4096)
        total = (lengths * take).sum()
        assert total <= budget and (take <= counts).all()
        if 1_000 <= budget <= 1_000_000:
            assert total == budget


def test_fill_is_optimal_in_the_end():
    rng = random.Random(3)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(2, 60, 2), 3)))
        counts = np.array([rng.randrange(0, 5) for _ in range(3)])
        budget = rng.randrange(1, 300)
        take = fill(lengths, counts, budget, 4, None)
        sums = {sum(a * int(b) for a, b in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])}
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def _docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randrange(1, 40)), "hot" if i % 3 == 0 else rng.choice(["a", "b", "none", None])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "", "a")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("n_tokens", F.lit("clash"))


def test_mix(spark):
    targets = spark.createDataFrame([("hot", 0.2, 1), ("a", 0.5, 3), ("b", 0.1, 2), ("absent", 0.1, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    sizes = token_sizes(_docs(spark), "doc_id", "text", "source")
    plan = mix_plan(sizes, targets)
    rows = {r["source"]: r for r in plan.collect()}
    assert set(rows) == {"hot", "a", "b", "absent"} and not rows["absent"]["reachable"] and rows["absent"]["taken_tokens"] == 0
    for r in rows.values():
        assert r["reachable"] == (r["max_repeats"] * r["own_tokens"] >= r["target_share"] * r["total_tokens"])
        if r["reachable"]:
            assert r["taken_tokens"] == r["budget"]
    got = {r["source"]: (r["t"], r["m"]) for r in mixed_documents(sizes, plan).groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("t"), F.max("copies").alias("m")).collect()}
    for source, (tokens, most) in got.items():
        assert tokens == rows[source]["taken_tokens"] and most <= rows[source]["max_repeats"]
    assert abs(sum(r["reached_share"] for r in reached_shares(plan).collect()) - 1) < 1e-9


def test_same_seed_same_documents(spark):
    targets = spark.createDataFrame([("hot", 0.3, 1), ("a", 0.1, 1)], "source string, target_share double, max_repeats int")
    out = []
    for n in (1, 6):
        sizes = token_sizes(_docs(spark).repartition(n), "doc_id", "text", "source")
        out.append(sorted(map(tuple, mixed_documents(sizes, mix_plan(sizes, targets), seed=5).collect())))
    assert out[0] == out[1]


def test_empty(spark):
    docs = _docs(spark)
    targets = spark.createDataFrame([("a", 0.5, None), ("b", None, 2)], "source string, target_share double, max_repeats int")
    plan = mix_plan(token_sizes(docs.limit(0), "doc_id", "text", "source"), targets)
    assert {r["taken_tokens"] for r in plan.collect()} == {0}
    assert mix_plan(token_sizes(docs, "doc_id", "text", "source"), targets.limit(0)).count() == 0
