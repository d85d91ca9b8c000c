"""Repeats read in splits, numbers without one task, pages written by tasks that fail or run again, chunks of sequences."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import order, regions
from spanloom.plans import view
from spanloom.sources import pages, readers


def repeats(n):
    return [{"SequenceName": f"chr{i % 3}", "Start": 10 * i, "Length": 3, "Other": [1, [2]], "Period": 2, "Consensus": "AT", "PositionScoreDeltas": [0.5, -1.0, i / 7]} for i in range(n)]


@pytest.mark.parametrize(("indent", "size"), [(None, "64b"), (2, "500b"), (None, "100m")])
def test_repeats_in_splits(spark, tmp_path, indent, size):
    (tmp_path / "r.json").write_text(json.dumps({"Version": "1", "Repeats": repeats(200)}, indent=indent))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = readers.read_repeats(spark, str(tmp_path / "r.json")).orderBy("repeat_id").collect()
        assert size == "100m" or spark.read.option("lineSep", "}").text(str(tmp_path / "r.json")).rdd.getNumPartitions() > 20
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.repeat_id, r.target_name, r.target_start, r.target_end, r.consensus, r.period, list(r.scores)) for r in got] == [
        (i + 1, x["SequenceName"], x["Start"], x["Start"] + 2, "AT", 2, x["PositionScoreDeltas"]) for i, x in enumerate(repeats(200))]


def test_odd_repeat_files(spark, tmp_path):
    for text, n in (('{"Repeats": []}', 0), ('{"Repeats":[]\n}\n', 0), (json.dumps({"Repeats": repeats(1)}) + "\n", 1)):
        (tmp_path / "r.json").write_text(text)
        assert readers.read_repeats(spark, str(tmp_path / "r.json")).count() == n
    (tmp_path / "r.json").write_text(json.dumps({"Repeats": [repeats(1)[0] | {"Inner": {"a": 1}}]}))
    with pytest.raises(Exception, match="not a flat repeat"):
        readers.read_repeats(spark, str(tmp_path / "r.json")).collect()


def test_numbers_by_ranges(spark):
    rng = random.Random(1)
    at = sorted(rng.sample(range(900), 200))
    frame = spark.createDataFrame([(i, rng.randint(0, 5)) for i in at], "o long, v long").repartition(5)
    for width in (32, 1 << 20):
        got = {r.o: (r.n, r.t) for r in order.totals_before(order.totals_before(frame, "o", name="n", width=width), "o", F.col("v"), name="t", width=width).collect()}
        values = {r.o: r.v for r in frame.collect()}
        assert got == {o: (i, sum(values[x] for x in at[:i])) for i, o in enumerate(at)}
    with pytest.raises(Exception, match="beyond the ranges"):
        order.totals_before(frame, "o", width=16).collect()
    plan = readers.dictionary(frame.withColumn("name", F.col("v").cast("string")), "name", "o")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_region_faults(spark):
    """Regions that touch, and a run of alignments that is parted, are told."""
    a = spark.createDataFrame([(1, 1, "+", 0, 5), (1, 1, "+", 7, 9), (1, 2, "+", 20, 25), (2, 1, "-", 3, 8)], "target_id long, query_id long, strand string, target_start long, target_end long")
    right = regions.regions(a, 3)
    assert {tuple(r) for r in regions.faults(a, right, 3).collect()} == {(1, 0, 0), (2, 0, 0)}
    wrong = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 6, 22), (1, 2, 20, 25), (2, 0, 3, 8)], "target_id long, region long, region_start long, region_end long")
    assert {tuple(r) for r in regions.faults(a.where("query_id = 1"), wrong, 3).collect()} == {(1, 1, 1), (2, 0, 0)}


def test_pages(spark, tmp_path):
    found = spark.createDataFrame([(f"chr/{i % 4}-{i}", f"<p>{i} é</p>") for i in range(40)], "title string, html string").repartition(4)
    out = tmp_path / "pages"
    for _ in range(2):
        pages.write_pages(found, str(out))
    assert {f.name: f.read_text() for f in out.glob("*.html")} == {pages.file_name(f"chr/{i % 4}-{i}"): f"<p>{i} é</p>" for i in range(40)}
    assert (out / "_SUCCESS").exists() and not list(out.glob(".[!_]*-*"))
    failing = found.withColumn("html", F.when(F.col("title") == "chr/3-39", F.raise_error(F.lit("no page"))).otherwise(F.col("html"))).coalesce(1)
    with pytest.raises(Exception, match="no page"):
        pages.write_pages(failing, str(tmp_path / "failed"))
    assert not (tmp_path / "failed" / "_SUCCESS").exists()
    assert all(f.read_text().endswith("</p>") for f in (tmp_path / "failed").glob("*.html"))
    writer = pages.PageWriter(str(tmp_path / "aborted"))
    done = writer.write(iter([{"title": "a", "html": "x"}]))
    writer.abort([done, None])
    assert not list((tmp_path / "aborted").glob("*.html"))


def test_chunks(spark):
    s = spark.createDataFrame([(1, 100, 2599, "A" * 1000 + "C" * 1000 + "G" * 500), (2, 5, 5, "T"), (3, 1, 0, "")], "region_id long, start long, end long, target_sequence string")
    got = view.chunks(s, ["region_id"])
    assert [(r.region_id, r.chunk, r.start, r.end, len(r.sequence), r.sequence[0]) for r in got.orderBy("region_id", "chunk").collect()] == [
        (1, 0, 100, 1100, 1000, "A"), (1, 1, 1100, 2100, 1000, "C"), (1, 2, 2100, 2600, 500, "G"), (2, 0, 5, 6, 1, "T")]
    windows = spark.createDataFrame([(1, 1000, 1299), (2, 0, 300), (2, 6, 9)], "region_id long, low long, high long")
    assert sorted((r.region_id, r.chunk) for r in view.letters_in(got, windows, ["region_id"]).collect()) == [(1, 0), (1, 1)]
