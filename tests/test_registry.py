"""Every registered query against its DuckDB twin."""

import os

import duckdb
import pytest

from eventloom.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{small}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return c


def cell(v):
    return None if v is None else str(round(v, 6) if isinstance(v, float) else v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, con, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    rows = sorted([tuple(cell(v) for v in r) for r in df.select(*cols).collect()], key=str)
    if name not in ORACLES:
        assert rows
        return
    want = con.execute(f"SELECT {', '.join(f'\"{c}\"' for c in cols)} FROM ({ORACLES[name]})").fetchall()
    assert rows == sorted([tuple(cell(v) for v in r) for r in want], key=str)
