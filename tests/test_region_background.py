"""Composition of regions with one shuffle of alignments, against cells that are joined and dealt again."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import regions, scores


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("known", [False, True])
def test_equal_to_joined_cells(spark, seed, known):
    rng = random.Random(seed)
    spans = [(r, s := rng.randint(0, 50), s + rng.choice([0, 5, 90])) for r in range(6)]
    rows = []
    for r, s, e in spans[1:]:  # the first is of repeats alone
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(s, e)
            rows.append((r, len(rows), a, [rng.randint(0, 14) for _ in range(rng.randint(0, e - a + 1))], s, e))
    found = spark.createDataFrame(spans, "k int, low long, high long")
    a = spark.createDataFrame(rows, "k int, ord long, target_start long, codes array<int>, low long, high long")
    a = a if known else a.drop("low", "high")
    want = scores.background(scores.region_bases(a, found, ["k"], "ord", low="low", high="high"), ["k"], "pos", "code", width=7, stretch=20)
    got = scores.region_background(a, found, ["k"], "ord", low="low", high="high", width=7, stretch=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(e - s + 1 for _, s, e in spans) == got.count()


def test_one_shuffle(spark):
    """No cell is shuffled."""
    a = spark.range(100).select((F.col("id") % 5).alias("k"), F.col("id").alias("ord"), F.col("id").alias("target_start"), F.array(F.lit(1), F.lit(2)).alias("codes"))
    found = spark.range(5).select(F.col("id").alias("k"), F.lit(0).alias("low"), F.lit(101).alias("high"))
    plan = scores.region_background(a, found, ["k"], "ord", low="low", high="high")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_rows_meet_few_regions(spark):
    """Of a long target's regions a row meets those of its bin, and none are broadcast."""
    found = spark.range(2_000).select(F.lit(1).alias("target_id"), F.col("id").alias("region"), (F.col("id") * 10).alias("region_start"), (F.col("id") * 10 + 6).alias("region_end"))
    rows = spark.range(0, 20_000, 5).select(F.lit(1).alias("target_id"), F.col("id").alias("target_start"))
    out = regions.assign(rows, found)
    assert sorted((r.target_start, r.region) for r in out.collect()) == [(x, x // 10) for x in range(0, 20_000, 5)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "/ 128" in plan
