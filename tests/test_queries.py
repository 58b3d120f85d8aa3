"""Every registered query with SQL against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tendermill.catalog import load

CHECKED = {n: q for n, q in load().items() if q.sql is not None}


@pytest.fixture(scope="session")
def db(tiny):
    connection = duckdb.connect()
    for path in Path(tiny).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1.1e-4)
    return a == b


@pytest.mark.parametrize("name", sorted(CHECKED))
def test_query_matches_sql(spark, db, tiny, name):
    q = CHECKED[name]
    df = q.run(spark, tiny)
    found = db.execute(q.oracle())
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    want = _rows(columns, found.fetchall())
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want)
    assert all(_close(a, b) for g, w in zip(got, want) for a, b in zip(g, w))
