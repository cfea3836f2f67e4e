"""Every registered query against its SQL twin."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from catalog.queries import ALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, SQL = entry.queries(), entry.oracle_sql()
# Queries of the optional training-data operators may have no SQL; their own tests cover them.
OWN = [query.__name__ for query in ALL]


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


def _rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(_plain(v) for v in row) for row in frame[names].itertuples(index=False))


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    return str(value)


def test_same_keys():
    assert set(OWN) <= SQL.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, duck, small, name):
    ours = _rows(QUERIES[name](spark, small).toPandas())
    theirs = _rows(duck.execute(SQL[name]).df())
    assert ours[0] == theirs[0]
    assert len(ours[1]) == len(theirs[1])
    assert ours[1] == theirs[1]
    assert ours[1], "an empty result proves nothing"


def test_entry(spark):
    assert entry.entry(spark).count() >= 0
