"""Every registered query with SQL gives DuckDB's rows; every query without runs."""

import glob
import os

import duckdb
import pytest

from tallgrass.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or v != v:
        return None
    return v.isoformat() if hasattr(v, "isoformat") else (round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        return
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    got = sorted(repr([plain(r[c]) for c in order]) for r in rows)
    assert got == sorted(repr([plain(r[columns.index(c)]) for c in order]) for r in want.fetchall())
