"""Every named query against SQL run by DuckDB on the same files."""

import glob
import math
import os

import duckdb
import pytest

from musterline.plans import catalog, comparison_sql

QUERIES = catalog.queries()
SQL = comparison_sql.statements()


@pytest.fixture(scope="module")
def duck(data_dir):
    connection = duckdb.connect()
    for path in glob.glob(f"{data_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from read_parquet('{path}')")
    yield connection
    connection.close()


def _kind(value):
    return value if not isinstance(value, float) or not math.isnan(value) else None


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_kind(row[i]) for i in order) for row in rows), key=repr)


def test_each_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, data_dir, name):
    ours = QUERIES[name](spark, data_dir)
    theirs = duck.execute(SQL[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(ours.columns) == sorted(columns)
    expected = rows_by_name(columns, theirs.fetchall())
    actual = rows_by_name(ours.columns, [tuple(r) for r in ours.collect()])
    assert len(actual) == len(expected)
    assert actual == expected
