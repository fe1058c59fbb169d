"""Every query of the core with SQL against DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from chronocount.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = duck.sql(registry.SQL[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    b = sorted(tuple(map(plain, r)) for r in duck.sql(f"SELECT {quoted} FROM ({registry.SQL[name]})").fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"mixture_fit", "assign_basins", "ks_vs_mixture", "genie3", "predict_cell_types", "alternate_fit", "infer_test", "refine_network", "refit_trajectories", "jump_simulate"}))
def test_runs_without_sql(spark, name):
    df = registry.QUERIES[name](spark, FOLDER)
    assert df.count() >= 0 and df.columns
