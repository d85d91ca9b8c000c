"""The scoring chain as one plan, held to the kernel's, which works a region at a time."""

import random

import numpy as np
import pytest

from spanloom.config import Settings
from spanloom.operators import confidence, kernel
from spanloom.sources import readers

from .test_interval import MATRIX

LOCATED = "region_id long, ali_id long, query_id long, target_start long, target_end long, matrix string, target_codes array<tinyint>, query_codes array<tinyint>"
REPEATS = "region_id long, repeat_id long, target_start long, target_end long, scores array<double>"


def codes(rng, own):
    """Target and query codes over the target's letters, with gaps of both sides, some at the end."""
    t, q, n, own = [], [], len(own), iter(own)
    while sum(x < 12 for x in t) < n:
        kind = rng.random()
        if kind < 0.08 and t:
            for i in range(rng.randint(1, 4)):
                t.append(12 if i == 0 and t[-1] < 12 else 13)
                q.append(rng.randint(0, 3))
        elif kind < 0.16 and t:
            for i in range(min(rng.randint(1, 4), n - sum(x < 12 for x in t))):
                t.append(next(own))
                q.append(12 if i == 0 and q[-1] < 12 else 13)
        else:
            t.append(next(own))
            q.append(t[-1] if rng.random() < 0.8 else rng.choice([0, 1, 2, 3, 7]))
    if rng.random() < 0.3:
        t.append(12)
        q.append(2)
    return t, q


@pytest.mark.parametrize("settings", [Settings(), Settings(score_window=5, background_window=9, half_mean=3), Settings(exact_window=True, score_window=7)])
def test_chain_equals_the_kernel(spark, settings):
    rng = random.Random(7)
    text = MATRIX + "#matrix m2\n#gap-open -15\n#lambda 0.2\nA C G T\n5 -4 -4 -4\n-4 5 -4 -4\n-4 -4 5 -4\n-4 -4 -4 5\n"
    matrices = readers.parse_matrices(text)
    rows, reps, genome = [], [], [rng.choice([0, 1, 2, 3, 0, 1, 2, 3, 5]) for _ in range(9000)]
    for region in range(8):
        for i in range(rng.randint(0 if region else 3, 7)):
            start, n = 1000 * region + rng.randint(0, 150), rng.choice([1, 2, 14, 15, 16, 17, 40, 120])
            rows.append((region, len(rows) + 1, rng.randint(1, 3), start, start + n - 1, rng.choice(["m1", "m2"]), *codes(rng, genome[start : start + n])))
        for i in range(rng.randint(0, 2)):
            start, n = 1000 * region + rng.randint(0, 300), rng.choice([1, 10, 16, 17, 50])
            reps.append((region, len(reps) + 1, start, start + n - 1, [rng.random() * 3 for _ in range(n)]))
    a, r = spark.createDataFrame(rows, LOCATED), spark.createDataFrame(reps, REPEATS)
    found = confidence.confidences(a, matrices, settings, r)
    got = {(x.kind, x.id, x.col): x.smooth for x in found.collect()}
    left = {(x.region_id, x.col): x.skip for x in confidence.skip_confidences(found, confidence.region_spans(a, r), settings).collect()}
    tables = {k: kernel.Tables(np.array(m.scores), np.array(m.core), m.opening, m.extension) for k, m in matrices.items()}
    want, skip = {}, {}
    for region in {x[0] for x in (*rows, *reps)}:
        mine = [kernel.Row(("ali", i), q, "+", s, e, target=np.array(t), query=np.array(c), matrix=tables[m]) for g, i, q, s, e, m, t, c in rows if g == region]
        own = [kernel.Row(("rep", i), 0, "+", s, e, scores=np.array(x)) for g, i, s, e, x in reps if g == region]
        mine.sort(key=lambda x: (x.start, x.query_id, x.key))
        low, high = min(x.start for x in (*mine, *own)), max(x.end for x in (*mine, *own))
        rest = kernel.confidences(mine, own, low, high - low + 1, settings)
        want |= {(*x.key, x.start + i): v for x in (*mine, *own) for i, v in enumerate(x.conf.tolist())}
        skip |= {(region, low + i): v for i, v in enumerate(rest.tolist())}
    assert got.keys() == want.keys() and left.keys() == skip.keys()
    assert all(got[k] == pytest.approx(v, rel=1e-8, abs=1e-12) for k, v in want.items())
    assert all(left[k] == pytest.approx(v, rel=1e-8, abs=1e-12) for k, v in skip.items())
    assert confidence.confidences(a.limit(0), matrices, settings).count() == 0


def test_characters_are_not_shuffled(spark):
    """Alignments are dealt, and no sort holds a matrix."""
    located = spark.createDataFrame([(1, 7, 3, "m", [0, 1], [0, 2])], "region_id long, ali_id long, target_start long, matrix string, target_codes array<int>, query_codes array<int>")
    m = readers.Matrix("m", -27.0, -5.0, 0.12, [0.25] * 4, [0.25] * 4, [[1.0] * 15 for _ in range(15)])
    plan = confidence.columns(located, {"m": m})._jdf.queryExecution().executedPlan().toString()
    head = plan[: plan.index("Exchange hashpartitioning")]
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate posexplode" in head
    assert "table" not in head[: head.rindex("Window")]
