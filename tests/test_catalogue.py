"""Every catalogued query against its SQL."""

import glob
import os

import duckdb
import pytest

from sparkloom.plans import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", catalogue.queries())
def test_matches_sql(spark, duck, name):
    found = catalogue.queries()[name](spark, DATA)
    wanted = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(names) == sorted(found.columns)
    rows = [tuple(r) for r in found.select(*(f"`{n}`" for n in names)).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, wanted.fetchall()))
