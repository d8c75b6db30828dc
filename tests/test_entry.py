import importlib
import os

import pytest

import __spark_entry__
from quernstone.plans import catalogue

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    importlib.reload(__spark_entry__)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = catalogue.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = con.execute(f"select {', '.join(columns)} from ({catalogue.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in got.select(columns).collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
