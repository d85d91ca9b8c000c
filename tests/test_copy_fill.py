"""Copy fill of ranges with one shuffle, against joins of cells."""

import random

from pyspark.sql import functions as F

from spanloom.operators import assemblies, scores


def tables(spark, rng):
    rows = [(k, rng.randint(1, 3), o, s := rng.randint(0, 40), s + rng.randint(0, 12), rng.randint(1, 9)) for k in range(4) for o in range(5)]
    members = spark.createDataFrame(rows, "k long, row long, ord long, low long, high long, score long")
    spans = members.groupBy("k", "row").agg(F.min("low").alias("low"), F.max("high").alias("high")).withColumn("high", F.col("high") + 9).withColumn("part", F.lit(1))
    return spans.unionByName(spans.where("k = 1").withColumn("part", F.lit(2))), members


def test_equal_to_joined_cells(spark):
    spans, members = tables(spark, random.Random(3))
    cells = scores.softmax(members.select("k", "row", "ord", F.explode(F.sequence("low", "high")).alias("col"), "score").withColumn("score", F.col("score") + F.col("col") % 3), ["k", "col"])
    owner = cells.groupBy("k", "row", "col").agg(F.min("ord").alias("ord"))
    owned = spans.select("k", "row", "part", F.explode(F.sequence("low", "high")).alias("col")).join(owner, ["k", "row", "col"], "left")
    skip = cells.groupBy("k", "col").agg((1 - F.sum("conf")).alias("skip"))
    want = assemblies.copy_fill(owned, cells.drop("row"), skip, ["k"], "col", ["ord"])
    got = assemblies.copy_fill_ranges(spans, members, F.col("score") + F.col("col") % 3, "k", "row", "ord", ["part"], stretch=8)
    rows = lambda f: sorted((r.k, r.row, r.part, r.col, -1 if r.ord is None else r.ord, -1 if r.conf is None else round(r.conf, 9)) for r in f.collect())
    assert rows(got) == rows(want) and any(r[4] == -1 for r in rows(got)) and any(r[5] == -1 for r in rows(got))


def test_one_shuffle(spark):
    spans, members = tables(spark, random.Random(4))
    spans = spark.createDataFrame(spans.collect(), spans.schema)
    plan = assemblies.copy_fill_ranges(spans, members, F.col("score"), "k", "row", "ord", ["part"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
