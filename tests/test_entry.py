"""The driver's entry points, and every query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: [(str(type(v)), str(v)) for v in r])


@pytest.mark.parametrize("name", [n for n in __spark_entry__.oracle_sql() if not n.startswith(("op", "pipeline"))])
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert ordered(got) == ordered([tuple(r[names.index(c)] for c in df.columns) for r in want.fetchall()])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_import_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "tessera.llm", None)
    monkeypatch.setitem(sys.modules, "tessera.llm.queries", None)
    assert __spark_entry__.queries() and not any(n.startswith("op") for n in __spark_entry__.queries())
