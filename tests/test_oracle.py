"""Every query against the same query in SQL on another engine, over the whole tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from modlytics.plans.catalog import QUERIES
from modlytics.plans.oracle import ORACLE as SQL

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def duck(small):
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    yield connection
    connection.close()


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v) for v in r))


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, small, name):
    result = QUERIES[name](spark, small)
    columns = sorted(result.columns)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = _sorted(tuple(r[i] for i in places) for r in cursor.fetchall())
    assert _sorted(tuple(r) for r in result.select(*columns).collect()) == expected


def test_entry(spark):
    assert contract.entry(spark).count() == 20
