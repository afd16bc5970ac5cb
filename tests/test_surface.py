"""Every query of the catalogue against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from sparkloom.plans.surface import ORACLES, QUERIES
from sparkloom.sources.tables import NAMES


@pytest.fixture(scope="session")
def duck(folder):
    con = duckdb.connect()
    for n in NAMES:
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(name, spark, folder, duck):
    df = QUERIES[name](spark, folder)
    got = df.collect()
    assert name in ORACLES, "every query of the surface can be put in SQL"
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, got) == rows(columns, found.fetchall())
