"""The command, its pages, and the columnwise operators held to the kernel's."""

import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.config import Settings
from spanloom.operators import kernel, regions, scores
from spanloom.plans import adjudicate, view
from spanloom.sources import readers

from .test_interval import MATRIX


def line(name, start, query, qs, text, strand=0):
    n = sum(c.isalpha() for c in text)
    return f"199,1.0,0.0,0.0,{name},{start},{start + n - 1},500,{query},,{qs},{qs + n - 1},100,{strand},,,{text},m1"


BODY = "ACGTTGCAACGGTCATTGACCGTAACGTTGCAACGGTCATTGACCGTA" * 2


@pytest.fixture
def files(tmp_path):
    rows = [line("chr1", 100, "famA", 1, BODY), line("chr1", 260, "famA", 110, BODY), line("chr1", 150, "famC", 1, BODY[:60]), line("chr2", 50, "famB", 1, BODY, 1)]
    (tmp_path / "a.caf").write_text("\n".join(rows) + "\n")
    (tmp_path / "m.txt").write_text(MATRIX)
    (tmp_path / "r.json").write_text('{"Repeats":[{"SequenceName":"chr1","Start":300,"Length":40,"Consensus":"AT","Period":2,"PositionScoreDeltas":[' + ",".join(["2.0"] * 40) + "]}]}")
    (tmp_path / "ref.bed").write_text("chr1 119 200 x 0 + 119 200 0 3 1,79,1 -1,1,-1 1 d\nchr1 900 950 y 0 + 900 950 0 3 1,48,1 -1,1,-1 2 d\nchr2 60 70 z 0 - 60 70 0 3 1,8,1 -1,1,-1 3 d\n")
    return tmp_path


def test_settings_of_the_command():
    args = cli.parser().parse_args(["a", "m", "-J", "1e-3", "-L", "7", "-T", "20", "-F", "2"])
    assert cli.settings(args) == Settings(query_jump=1e-3, skip_loop=7, target_join_distance=20, fudge_distance=2)
    assert cli.settings(cli.parser().parse_args(["a", "m"])) == Settings()
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["a"])


def test_command(spark, files, capsys):
    out = files / "viz"
    assert cli.main([str(files / "a.caf"), str(files / "m.txt"), "-U", str(files / "r.json"), "--viz", "--assembly-viz", "--viz-out", str(out), "--viz-ref-bed", str(files / "ref.bed")]) == 0
    printed = capsys.readouterr().out.splitlines()
    want = adjudicate.run(spark, str(files / "a.caf"), str(files / "m.txt"), str(files / "r.json")).collect()
    assert len(printed) == len(want) and {x.split()[0] for x in printed} == {"chr1", "chr2"}
    data = {}
    for kind in ("regions", "assemblies"):
        assert (out / kind / "_SUCCESS").exists() and not list((out / kind).glob(".*"))
        for f in sorted((out / kind).glob("*.html")):
            data.setdefault(kind, {})[f.stem] = json.loads(re.search(r'type="application/json">(.*?)</script>', f.read_text(), re.S)[1])
    one = data["regions"]["chr1-0-100-355"]
    assert one["target_sequence"][:8] == BODY[:8] and len(one["target_sequence"]) >= 256 and [x["name"] for x in one["reference"]] == ["x"] and len(one["repeats"]) == 1
    assert {len(a["members"]) for a in one["assemblies"]} == {1, 2} and one["rounds"][0]["confidence"]
    for r in one["rounds"]:
        assert set(r) == {"conclusive", "ambiguous", "inactive", "resolved", "unresolved", "competed", "confidence"}
    page = data["assemblies"]["0-1-fwd"]
    assert (page["target_start"], page["target_end"], page["consensus_start"], page["consensus_end"]) == (100, 355, 1, 205)
    assert [(x["from"], x["to"], x["start"], x["end"]) for x in page["links"]] == [(1, 2, 147, 307), (2, 1, 307, 147)] and len(page["assemblies"][0]["target"]) == 2
    assert (page["prev"], page["next"], page["suffix"]) == (2, 2, "fwd") and data["assemblies"]["1-3-rev"]["consensus_end"] == 96


def test_unsorted_reference_is_refused(spark, files):
    (files / "bad.bed").write_text("chr1 9 20 x 0 + 9 20 0 1 1 0 1 d\nchr2 9 20 x 0 + 9 20 0 1 1 0 1 d\nchr1 30 40 x 0 + 30 40 0 1 1 0 1 d\n")
    with pytest.raises(ValueError, match="chr1"):
        cli.checked(readers.read_bed(spark, str(files / "bad.bed")))
    cli.checked(readers.read_bed(spark, str(files / "ref.bed")))


def test_pages_before_and_after(spark):
    rows = []
    for i, q in enumerate((4, 7, 9, 11)):
        rows.append(("assembly", 0, i, i, 1, 5, q, None, None, "+", None, None))
        rows.append(("member", 0, 0, i, 1, 5, None, 2, 6, None, 0.5, i))
    found = spark.createDataFrame(rows, "kind string, region_id long, seq int, row long, start long, end long, query_id long, query_start long, query_end long, strand string, confidence double, ali_id long")
    none = spark.createDataFrame([], "region_id long, query_id long, strand string, target_start long, target_end long, query_start long, query_end long, ali_id long")
    got = {r.query_id: json.loads(r.payload) for r in view.assembly_payloads(found, none, 5).collect()}
    assert {q: (p["prev"], p["next"]) for q, p in got.items()} == {4: (11, 7), 7: (11, 9), 9: (7, 11), 11: (9, 4)}


def test_row_confidences_and_domain(spark, files):
    found = adjudicate.outputs(readers.read_alignments(spark, str(files / "a.caf")), readers.read_matrices(spark, str(files / "m.txt")), detail=True)
    rows = {(r.region_id, r.row): r for r in view.row_confidences(found).collect()}
    assert len(rows) == 3 and all(0 < r.max_conf <= 1 for r in rows.values()) and any(r.in_trace for r in rows.values())
    assert view.in_domain(spark.createDataFrame([(1, 5), (5, 9), (9, 12)], "start long, end long"), 5, 9).count() == 1


def test_columns_agree_with_the_kernel(spark):
    rng = random.Random(21)
    whole, cells = [], []
    for key, n in enumerate((1, 2, 14, 15, 16, 17, 31, 60, 130)):
        for i in range(n):
            cells.append((key, i, rng.randint(-5, 6), rng.randint(-3, 0), rng.choice([0, 1, 2, 3, 3, 5, 14])))
    frame = spark.createDataFrame(cells, "k long, pos long, s long, g long, code long")
    got = (
        scores.windowed_scores(frame, ["k"], "pos", "s", "g").withColumnRenamed("window", "w")
        .join(scores.repeat_scores(frame, ["k"], "pos", "s").withColumnRenamed("window", "r"), ["k", "pos"])
        .join(scores.centred_mean(frame, ["k"], "pos", "s"), ["k", "pos"]).join(scores.background(frame, ["k"], "pos", "code", stretch=40), ["k", "pos"])
    ).orderBy("k", "pos").toPandas()
    for key in got.k.unique():
        own = [c for c in cells if c[0] == key]
        s, g, codes = (np.array([c[i] for c in own]) for i in (2, 3, 4))
        mine = got[got.k == key]
        assert np.allclose(mine.w, kernel.window_scores(s.astype(float), g.astype(float), 15)) and np.allclose(mine.r, kernel.repeat_scores(s.astype(float), 31)) and np.allclose(mine.smooth, kernel.smooth(s.astype(float), 15))
        row = kernel.Row(("ali", 0), 1, "+", 0, len(own) - 1, target=codes)
        assert np.allclose(mine[["bg_a", "bg_c", "bg_g", "bg_t"]], kernel.background(len(own), 0, [row], 61))
        whole.append(len(own))
    assert sum(whole) == len(got)


def test_background_of_overlapping_rows():
    """The last row that covers a column gives its base; columns that none covers count a quarter each."""
    rows = [kernel.Row(("ali", 0), 1, "+", 2, 5, target=np.array([0, 0, 12, 13, 0, 0])), kernel.Row(("ali", 1), 1, "+", 4, 6, target=np.array([1, 1, 1]))]
    share = kernel.background(9, 0, rows, 1)
    assert share.tolist() == [[0.25] * 4] * 2 + [[1, 0, 0, 0]] * 2 + [[0, 1, 0, 0]] * 3 + [[0.25] * 4] * 2


@pytest.mark.parametrize("width", [3, 1000])
def test_merged(spark, width):
    rng = random.Random(width)
    rows = [(rng.randint(0, 2), s := rng.randint(0, 120), s + rng.randint(1, 9) + 60 * (rng.random() < 0.05), 1) for _ in range(120)]
    frame = spark.createDataFrame(rows, "k long, s long, e long, n long").drop("n")
    for gap in (0, 3):
        found = regions.merged(frame, ["k"], "s", "e", gap, width)
        plain = regions.islands(frame, ["k"], "s", "e", gap)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.select("k", "s", "e", "n").collect()))


def test_membership(spark):
    from spanloom.operators import joins

    rows = spark.createDataFrame([(i, "x") for i in range(4)], "k long, other string")
    seen = spark.createDataFrame([(1, True), (1, True), (2, False)], "k long, ok boolean")
    assert sorted(map(tuple, joins.membership(rows, seen.where("ok"), seen, ["k"]).collect())) == [(0, "never"), (1, "hit"), (3, "never")]
    assert joins.membership(rows, seen.where(F.lit(False)), seen, ["k"]).count() == 2
