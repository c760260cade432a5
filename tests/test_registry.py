"""Every registered query against its SQL, run by DuckDB over the same tables."""

import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract

SF = Path(os.environ.get("REGISTRY_SF_DIR", "/root/testdata/sf0.001"))
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in SF.glob("*.parquet"):
        connection.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return connection


def normal(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


def table(names, rows):
    order = sorted(range(len(names)), key=lambda at: names[at])
    cells = [tuple(normal(row[at]) for at in order) for row in rows]
    return sorted(cells, key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = QUERIES[name](spark, str(SF))
    rows = result.collect()
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [column[0] for column in found.description]
    expected = found.fetchall()
    assert sorted(names) == sorted(result.columns)
    assert len(rows) == len(expected)
    mine, theirs = table(result.columns, rows), table(names, expected)
    wrong = [pair for pair in zip(mine, theirs) if pair[0] != pair[1]]
    assert not wrong, wrong[:3]
    assert {str(c) for c in QUERIES} >= set(ORACLES)


def test_entry(spark):
    assert contract.entry(spark).count() >= 1
