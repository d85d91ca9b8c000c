"""Queries of the operators agree with their SQL on the smallest tables, and their results have one row for each row they are asked for."""

import math
import os

import pytest

from spanloom.llm import oracles, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, bool):
        return str(value)
    return f"{float(value):.5f}" if isinstance(value, (int, float)) else str(value)


@pytest.mark.parametrize("name", oracles.SQL)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    cur = c.execute(oracles.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in cur.fetchall())
    got = sorted(tuple(plain(r[n]) for n in sorted(names)) for r in df.collect())
    assert got == want
    if name == "quoted_conversations":
        assert sum(float(r[sorted(names).index("n_linked")]) for r in got) > 0


def test_shared_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from spanloom.llm import common

    nothing = SimpleNamespace(get=lambda *_: None)
    cluster = SimpleNamespace(conf=nothing, sparkContext=SimpleNamespace(getConf=lambda: nothing, master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://shared/x"), sparkContext=cluster.sparkContext)
    assert common.shared_folder(named) == "hdfs://shared/x" and common.fresh(["a", "A_", "b"], "a", "c") == ["a__", "c"]
