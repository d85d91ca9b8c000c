"""Readers, edit strings, regions and windows against goldens and brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.config import Settings
from spanloom.functions import alphabet
from spanloom.operators import blocks, kernel, regions, scores
from spanloom.plans import adjudicate
from spanloom.sources import readers, sinks

GOLDEN = {
    "AATTGG": ([0, 0, 3, 3, 2, 2], [0, 0, 3, 3, 2, 2]), "AAG/CAA": ([0, 0, 2, 0, 0], [0, 0, 1, 0, 0]),
    "AA-GC-TA+GG+A": ([0, 0, 2, 1, 3, 0, 12, 13, 0], [0, 0, 12, 13, 3, 0, 2, 2, 0]), "A-C--G-T": ([0, 1, 2, 3], [0, 12, 13, 3]),
    "A+C+-G-T": ([0, 12, 2, 3], [0, 1, 12, 3]), "A/C/G": ([0], [2]), "A-CG": ([0, 1, 2], [0, 12, 13]),
}
REJECTED = ["-A-C", "+A+C", "A-G/C-T", "A/+C+", "A-G+C", "acgt"]
MATRIX = """#matrix m1
#gap-open -27
#gap-ext -5
#lambda 0.12
#fi 0.295 0.205 0.205 0.295
#fj 0.295 0.205 0.205 0.295
A C G T N
9 -17 -8 -19 -1
-16 12 -16 -7 -1
-7 -16 12 -16 -1
-19 -8 -17 9 -1
-1 -1 -1 -1 -1
"""


def test_decode(spark):
    df = spark.createDataFrame([(x,) for x in [*GOLDEN, *REJECTED]], "text string").withColumn("d", alphabet.decode(F.col("text")))
    for r in df.collect():
        if r.text in GOLDEN:
            assert (list(r.d.target), list(r.d.query)) == GOLDEN[r.text], r.text
        else:
            assert r.d is None, r.text


def test_decode_long(spark):
    """Strings of tens of thousands of edits: neither the pattern's depth nor the time grows beyond the string's length."""
    n = 20_000
    texts = [t * n for t in ("AA-GC-TA+GG+A", "A-C--G-T", "AAG/CAA")] + ["A/C" + "/G" * n, "A-" + "C" * n, "A-G+C" * n, "A" * n + "a"]
    got = [r.d for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", alphabet.decode(F.col("text")).alias("d")).orderBy("i").collect()]
    for d, t in zip(got, texts):
        unit = GOLDEN.get(t[: len(t) // n])
        assert unit is None or (list(d.target), list(d.query)) == (unit[0] * n, unit[1] * n)
    assert (list(got[3].target), list(got[3].query)) == ([0], [2])
    assert list(got[4].target) == [0] + [1] * n and list(got[4].query) == [0, 12] + [13] * (n - 1)
    assert got[5] is None and got[6] is None


def test_matrices():
    m = readers.parse_matrices(MATRIX + "#matrix m2\nA C\n1 2\n3 4\n")
    assert m["m1"].raw[0][1] == -17 and m["m1"].raw[12][0] == 0.0 and m["m2"].raw[1][0] == 3 and m["m2"].gap_open == -27
    assert m["m1"].opening == pytest.approx(-3.24)
    with pytest.raises(ValueError):
        readers.parse_matrices("#other 1\n")
    with pytest.raises(ValueError):
        readers.parse_matrices(MATRIX.replace("-1 -1 -1 -1 -1\n", ""))


def test_score_params(spark):
    r = spark.range(1).select(*(F.lit(n).alias(f"n{n}") for n in (1, 10, 100)))
    for n, want in ((1, (-126.642180114673, -67.542496061159, -4.221406003822)), (10, (-128.944765207667, -68.770541444089, -4.298158840256)), (100, (-131.247350300661, -69.998586827019, -4.374911676689))):
        p = scores.score_params(F.col(f"n{n}"), 1e-55, 30.0)
        got = r.select(p["query_jump"], p["query_to_skip"], p["skip_loop"]).first()
        assert list(got) == pytest.approx(want, abs=1e-9)
    assert scores.skip_adjust(1e-55, 30.0) == pytest.approx(0.014677992676220697)


def test_bed_goldens(spark):
    lines = ["c 9122 17126 x 0 + 11504 11675 0 3 2382,171,5451 -1,2382,-1 1 d", "c 18184829 18191691 y 0 - 18188369 18189819 0 7 3540,76,0,959,0,14,1872 -1,3540,-1,3724,-1,4976,-1 2 d e"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    a, b = blocks.from_bed(df.select(*readers.parse_bed(F.col("value")))).orderBy("name").collect()
    assert tuple(a.left) == (9123, 11504) and tuple(a.right) == (11676, 17126) and [tuple(x)[:2] for x in a.aligned] == [(11505, 11675)] and a.inner == []
    assert [tuple(x)[:2] for x in b.aligned] == [(18188370, 18188445), (18188554, 18189512), (18189806, 18189819)]
    assert [tuple(x) for x in b.inner] == [(18188446, 18188553, 0), (18189513, 18189805, 0)] and tuple(b.left) == (18184830, 18188369) and tuple(b.right) == (18189820, 18191691)


@pytest.mark.parametrize("width", [7, 1000])
def test_regions(spark, width):
    rng = random.Random(width)
    rows = [(rng.randint(1, 3), rng.randint(1, 3), rng.choice("+-"), s, s + rng.randint(1, 6)) for s in (rng.randint(1, 150) for _ in range(90))]
    df = spark.createDataFrame(rows, "target_id long, query_id long, strand string, target_start long, target_end long")
    got = {(r.target_id, r.region_start, r.region_end) for r in regions.regions(df, 4, bin_width=width).collect()}
    want = set()
    for t in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[3], r[1]))
        reach = sorted((a[3], max([a[4]] + [b[4] for b in own[i + 1 :] if b[1:3] == a[1:3] and b[3] - a[4] <= 4])) for i, a in enumerate(own))
        cur = list(reach[0])
        for s, e in reach[1:]:
            if s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                want.add((t, *cur))
                cur = [s, e]
        want.add((t, *cur))
    assert got == want


def test_windows():
    rng = np.random.default_rng(3)
    for n in (1, 2, 14, 15, 16, 17, 31, 60):
        s, g = rng.integers(-5, 6, n).astype(float), rng.integers(-3, 1, n).astype(float)
        want, total, left, right = [], (s + g)[:15].sum(), 0, 15
        for i in range(n):
            if i:
                lo, hi = max(0, i - 15), min(n - 1, i + 15)
                total -= (s[lo - 1] + g[lo]) if lo != left else 0
                total += (s[hi] + g[hi]) if hi != right else 0
                left, right = lo, hi
            want.append(total)
        assert np.allclose(kernel.window_scores(s, g, 15), want), n
        padded = np.concatenate([np.zeros(15), s, np.zeros(60)])
        want = [0.0] + [padded[:31].sum() + padded[32 : i + 32].sum() - padded[:i].sum() for i in range(1, n)]
        assert np.allclose(kernel.repeat_scores(s, 31), want), n


def random_rows(rng, n, span=14):
    rows = []
    for i in range(n):
        s = rng.randint(0, span)
        e = s + rng.randint(1, 7)
        q = rng.randint(1, 30)
        strand = rng.choice("+-")
        rows.append(kernel.Row(("ali", i), rng.randint(1, 2), strand, s, e, q if strand == "+" else q + e - s, q + e - s if strand == "+" else q, np.array([rng.randint(0, 3) for _ in range(e - s + 1)]), np.array([rng.randint(0, 3) for _ in range(e - s + 1)])))
    return sorted(rows, key=lambda r: (r.start, r.query_id, r.key))


def tables():
    m = readers.parse_matrices(MATRIX)["m1"]
    return kernel.Tables(np.array(m.scores), np.array(m.core), m.opening, m.extension)


def test_assemblies_partition_the_rows():
    rng = random.Random(5)
    for _ in range(60):
        own = [r for r in random_rows(rng, 8) if r.strand == "+"]
        groups = kernel.joined(own, 6)
        assert sorted(m.key for g in groups for m in g) == sorted(r.key for r in own)
        for g in groups:
            for m in g:
                m.conf = np.full(m.end - m.start + 1, 0.5)
            a = kernel.assemble(g)
            assert all(x[2] < y[1] for x, y in itertools.pairwise(a.pieces))
            assert all(m.start <= s <= e <= m.end for m, s, e in a.pieces)


def test_joins_take_the_lightest_edge():
    rows = [kernel.Row(("ali", i), 1, "+", s, e, q, q + e - s) for i, (s, e, q) in enumerate([(0, 10, 1), (12, 20, 12), (40, 50, 22), (11, 19, 900)])]
    rows.sort(key=lambda r: r.start)
    groups = {tuple(m.key[1] for m in g) for g in kernel.joined(rows, 100)}
    assert groups == {(0, 3), (1, 2)}  # 3 runs on from 0 as well, and is nearer; after it nothing does


def test_path_is_the_best_of_all():
    rng = random.Random(11)
    for _ in range(25):
        rows = random_rows(rng, 4, 5)
        for r in rows:
            r.matrix = tables()
            r.conf = np.array([rng.random() for _ in range(r.end - r.start + 1)])
        start, end = min(r.start for r in rows), max(r.end for r in rows)
        groups = [kernel.assemble(g) for q in (1, 2) for s in "+-" for g in kernel.joined([r for r in rows if r.query_id == q and r.strand == s], 10)]
        grid = kernel.Collapsed(sorted(groups, key=lambda a: a.start), [], np.array([rng.random() for _ in range(end - start + 1)]), start)
        active = grid.active()[:5]
        jump, leave = -2.0, -1.2
        cells = [range(grid.first[c], grid.first[c + 1]) for c in active]

        def score(p, grid=grid):
            total = grid.log[p[0]]
            for a, b in itertools.pairwise(p):
                ra, rb, ghost_a, ghost_b = grid.row[a], grid.row[b], grid.owner[a] < 0 and grid.row[a] > 0, grid.owner[b] < 0 and grid.row[b] > 0
                if ra == rb:
                    step = 0.0
                elif ghost_a:
                    return -np.inf
                elif ra == 0 or rb == 0:
                    step = leave + (kernel.GHOST_PENALTY if ghost_b else 0)
                else:
                    step = jump + (kernel.GHOST_PENALTY if ghost_b else 0)
                total += step + grid.log[b]
            return total

        best = max(score(p) for p in itertools.product(*cells))
        assert score(grid.path(active, jump, leave).tolist()) == pytest.approx(best)


def test_loop_settles_every_region():
    rng = random.Random(7)
    for _ in range(40):
        rows = random_rows(rng, 7)
        for r in rows:
            r.matrix = tables()
        reps = [kernel.Row(("rep", 1), 0, "+", 3, 12, scores=np.ones(10), name="(2:AT)#tandem repeat")]
        found, rounds = kernel.adjudicate(rows, reps, Settings(target_join_distance=8, fudge_distance=1))
        assert [x["target_start"] for x in found] == sorted(x["target_start"] for x in found)
        sizes = [sum(e - s + 1 for _, s, e in r["segments"]) for r in rounds]
        assert sizes == sorted(sizes, reverse=True)
        assert all(0 <= x["confidence"] <= 1 for x in found)


def test_end_to_end(spark, tmp_path):
    def line(name, start, query, qs, text, strand=0):
        n = sum(c.isalpha() for c in text)
        return f"199,1.0,0.0,0.0,{name},{start},{start + n - 1},500,{query},,{qs},{qs + n - 1},100,{strand},,,{text},m1"

    body = "ACGTTGCAACGGTCATTGACCGTAACGTTGCAACGGTCATTGACCGTA" * 2
    (tmp_path / "a.caf").write_text("\n".join([line("chr1", 100, "famA", 1, body), "", line("chr1", 260, "famA", 110, body), line("chr2", 50, "famB", 1, body, 1)]) + "\n")
    (tmp_path / "m.txt").write_text(MATRIX)
    (tmp_path / "r.json").write_text('{"Repeats":[{"SequenceName":"chr1","Start":400,"Length":40,"Consensus":"AT","Period":2,"PositionScoreDeltas":[' + ",".join(["2.0"] * 40) + "]}]}")
    out = adjudicate.run(spark, str(tmp_path / "a.caf"), str(tmp_path / "m.txt"), str(tmp_path / "r.json"))
    got = out.orderBy("region_id", "target_start").toPandas()
    fam = got[got.query_name == "famA"]
    assert set(got.query_name) >= {"famA", "famB"} and fam.join_id.nunique() == 1  # both parts are one element
    assert got[got.query_name == "famB"].strand.tolist() == ["-"] and (got.confidence > 0.4).all()
    text = sinks.aligned(out, ["region_id"], sinks.ANNOTATION).select("region_id", "line").toPandas()
    assert text.groupby("region_id").line.apply(lambda x: x.str.len().nunique()).eq(1).all()
    html = sinks.pages(spark.createDataFrame([("t", '{"a":"</script>"}')], "title string, payload string")).first().html
    assert "<\\/script>" in html


def test_line_numbers_and_bed_order(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\n\nb\n   \nc\n")
    assert [tuple(r) for r in readers.lines(spark, str(tmp_path / "x.txt")).orderBy("line").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    rows = [(1, "p", 5), (2, "p", 3), (3, "q", 1), (4, "p", 9)]
    got = {r.chrom: (r.sorted, r.contiguous) for r in readers.bed_order(spark.createDataFrame(rows, "line long, chrom string, chrom_start long")).collect()}
    assert got == {"p": (False, False), "q": (True, True)}
