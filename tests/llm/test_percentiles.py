import math
import random

import numpy as np
import pandas as pd
import pytest

from chronocount.llm.percentiles import _from_image, _image, percentiles, value_counts


def expected(values, p):
    values = sorted(values)
    return values[max(math.ceil(p * len(values)), 1) - 1]


@pytest.mark.parametrize("whole", [True, False])
def test_against_sorting(spark, whole):
    rng = random.Random(0)
    make = (lambda: rng.choice([0, 0, 0, rng.randrange(10**6)])) if whole else (lambda: rng.gauss(0, 1) * 10 ** rng.randrange(5))
    rows = [(rng.choice("abc") if i % 3 else "hot", rng.randrange(4), float(make())) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, part int, x double")
    parts = value_counts(df, ["g", "part"], "x")
    merged = value_counts(parts, ["g"], "v", "n")
    at = (0.0, 0.1, 0.5, 0.99, 1.0)
    got = {(r["g"], r["p"]): r["value"] for r in percentiles(merged, ["g"], at, 0.0 if whole else 1e-3, whole).collect()}
    for g in ("a", "b", "c", "hot"):
        for p in at:
            want = expected([x for k, _, x in rows if k == g], p)
            assert got[g, p] == want if whole else want <= got[g, p] <= want + 1e-3


def test_images_keep_the_order():
    v = np.array([-math.inf, -1e308, -2.5, -1e-320, 0.0, 5e-324, 1.0, 1.5, 1e308, math.inf])
    i = _image(v)
    assert (np.diff(i) > 0).all() and _image(np.array([-0.0]))[0] == 0 and (_from_image(pd.Series(i)).to_numpy() == v).all()


def test_error_bound_saves_passes(spark):
    rows = [("a", float(i * i)) for i in range(1000)]
    df = value_counts(spark.createDataFrame(rows, "g string, x double"), ["g"], "x")
    for error in (1.0, 1000.0):
        r = percentiles(df, ["g"], (0.5,), error).first()
        want = expected([x for _, x in rows], 0.5)
        assert want <= r["value"] <= want + error


def test_edge_cases(spark):
    rows = [("a", None), ("a", float("nan")), (None, 5.0), (None, 5.0), ("b", -3.0), ("c", float("inf")), ("d", -math.inf), ("d", 1e-300), ("d", math.inf)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {(r["g"], r["n"], r["value"]) for r in percentiles(value_counts(df, ["g"], "x"), ["g"], (0.5,)).collect()}
    assert got == {(None, 2, 5.0), ("b", 1, -3.0), ("c", 1, math.inf), ("d", 3, 1e-300)}
    assert percentiles(value_counts(df.limit(0), ["g"], "x"), ["g"], (0.5,)).count() == 0
