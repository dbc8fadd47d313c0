"""Every query of the library against its SQL, on the smallest tables."""

import decimal

import duckdb
import pytest

from boardframe.plans import book_queries, file_queries, page_queries, registry  # noqa: F401
from boardframe.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, tables, name):
    found = QUERIES[name](spark, SF)
    want = tables.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    got = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    assert got == sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=repr)
