"""Every registered query against its DuckDB SQL on the small tables."""

import math
import os

import duckdb
import pytest

from slotgrid.plans import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _cell(x):
    return round(x, 6) + 0.0 if isinstance(x, float) and not math.isnan(x) else x


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_cell(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got or name not in ORACLE_SQL
    if name in ORACLE_SQL:
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]})").fetchall()
        assert got == sorted((tuple(map(_cell, r)) for r in want), key=repr)
