"""Every registered query with SQL gives the rows of that SQL on DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def con(sf):
    connection = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        connection.execute(f"create view {path.stem} as from '{path}'")
    return connection


def canonical(records, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        return "nan" if isinstance(v, float) and math.isnan(v) else v

    rows = [tuple(plain(r[i]) for i in order) for r in records]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    relation = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in relation.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(relation.fetchall(), columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "c_custkey"


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
