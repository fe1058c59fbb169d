"""The registered queries on the smallest tables: against SQL where there is some, else that they run."""

import math
import os

import duckdb
import pytest

from chronocount.llm import queries

FOLDER = "/root/testdata/sf0.001"
FOUND = {
    "p2_found": ["cell_id", "cell_type"], "p3_found": ["cell_a", "cell_b"], "p4_found": ["tab", "entry_id", "gene_id"], "p6_found": ["doc_id", "item_id"],
    "p7_found": ["source"], "p8_found": ["doc_a", "doc_b"],
}


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else f"{float(v):.8g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    b = sorted(tuple(map(plain, r)) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert df.columns == FOUND.get(name, df.columns)
    rows = df.collect()
    assert len(rows) == len({str(r) for r in rows}) and rows
