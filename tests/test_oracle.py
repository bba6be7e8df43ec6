"""Every query of the engine against DuckDB on the same tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

from brindle.queries import ORACLE_SQL, QUERIES
from brindle.session import TABLES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return None if isinstance(v, float) and math.isnan(v) else v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, cursor.fetchall())


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
