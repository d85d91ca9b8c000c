"""Every query with SQL agrees with it on the smallest tables."""

import math
import os
import sys

import pytest

import __spark_entry__ as entry
from spanloom.plans import queries as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.5f}"
    return str(value)


@pytest.mark.parametrize("name", plans.SQL)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    cur = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(n)]) for n in order) for r in cur.fetchall())
    got = sorted(tuple(plain(r[n]) for n in order) for r in df.collect())
    assert got == want


def test_core_without_the_other_queries(monkeypatch):
    """What stands beside the core may be gone, or lack a package."""
    monkeypatch.setitem(sys.modules, "spanloom.llm", None)
    monkeypatch.delitem(sys.modules, "spanloom.llm.queries", raising=False)
    assert set(entry.queries()) == set(plans.QUERIES) and set(entry.oracle_sql()) == set(plans.SQL)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
