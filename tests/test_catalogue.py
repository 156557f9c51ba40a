"""Every query of the library that has SQL against it in the other engine, on the tables of the correctness gate; test_properties.py has the others."""

import decimal
import os

import duckdb
import pytest

from faunaflux.plans import catalogue

SF = "/root/testdata/sf0.01"
QUERIES, ORACLES = catalogue.load()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


def plain(rows):
    return sorted((tuple(float(v) if isinstance(v, (float, decimal.Decimal)) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(rows)
