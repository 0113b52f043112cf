"""Every registered query of the library against its DuckDB text."""

import math
import os

import duckdb
import pytest

from millrace.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v) if not isinstance(v, (int, str, type(None), bool)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in ORACLES:
        assert name == "svm_linear_cv"  # a trained model's hits: SQL cannot say how many
        n = duck.sql("SELECT count(*) FROM embeddings WHERE label IN (3, 9)").fetchall()[0][0]
        assert len(rows) == 1 and rows[0].n == n and 0 <= rows[0].n_correct <= n
        return
    want = duck.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    got = sorted(([plain(r[c]) for c in cols] for r in rows), key=str)
    assert got == sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=str)
