"""What is many rows for each row of a table is not broadcast, however small Spark takes it to be."""

from pyspark.sql import functions as F

from spanloom.llm import resemblance, simhash


def plans(monkeypatch, module):
    """The plans of the tables that a module stores, by name."""
    found, store = {}, module.store

    def watched(df, name):
        found[name] = df._jdf.queryExecution().executedPlan().toString()
        return store(df, name)

    monkeypatch.setattr(module, "store", watched)
    return found


def test_tables_of_fingerprints(spark, monkeypatch):
    distinct = simhash.store(spark.range(2_000).select(F.xxhash64("id").alias("fp")), "distinct")
    found = plans(monkeypatch, simhash)
    simhash.links(distinct).collect()
    assert "SortMergeJoin" in found["buckets0"] and "Broadcast" not in found["buckets0"]


def test_buckets_of_sets(spark, monkeypatch):
    buckets = F.array(*(F.xxhash64("id", F.lit(i)) for i in range(24)))
    distinct = simhash.store(spark.range(500).select(F.xxhash64("id").alias("fp"), buckets.alias("buckets")), "distinct")
    found = plans(monkeypatch, resemblance)
    resemblance.shared_buckets(distinct).collect()
    assert "SortMergeJoin" in found["shared"] and "Broadcast" not in found["shared"]
