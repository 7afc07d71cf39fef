"""Every registered query runs; those with SQL give what DuckDB gives."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from oracle import database, expected, rows

from ferrule import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return database(SF)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    got = df.collect()
    if name in queries.ORACLES:
        columns, want = expected(db, queries.ORACLES[name])
        assert sorted(df.columns) == columns
        assert rows(got, df.columns) == want
    else:
        assert got and len(df.columns) > 0
