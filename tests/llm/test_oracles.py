"""The text queries against DuckDB on the same tables."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from brindle.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) > 0 and Counter(rows) == Counter(cursor.fetchall())
