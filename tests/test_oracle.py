"""Every registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from orrery.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(name, spark, sf, duck):
    frame = QUERIES[name](spark, sf)
    columns = sorted(frame.columns)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert a == b
