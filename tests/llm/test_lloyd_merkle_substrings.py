"""Clustering, manifest and substring removal against plain versions, with nulls, ties, repeated rows, long texts, empty tables and clashing names."""

import hashlib
import random
import zlib

import numpy as np

from spanloom.llm import lloyd, merkle, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ", own string, grp string, part int, n_words int, kept string, v string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, v string, cluster int")


def slow_lloyd(rows, k, rounds, dim, scale=256):
    kept = [(i, [int(np.floor(x * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, h(f"2:{r[0]}"), r[1]))
    centroids = [v for _, v in order[:k]]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        centroids = [[sum(col) // len(col) for col in zip(*(v for (_, v), j in zip(kept, of) if j == i))] if i in of else c for i, c in enumerate(centroids)]
    return sorted(((i, near(v)[1], min(near(v)[0], 2**63 - 1)) for i, v in kept), key=str), centroids


def test_lloyd(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(300)]
    rows += [(300 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(40)] + [(7, rows[7][1]), (None, [1.0, 1.0, 1.0, 1.0]), (-3, [0.0] * 4)]
    odd = [(900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4), (903, [float("inf"), 0.0, 0.0, 0.0]), (904, [1.0]), (905, []), (906, [0.0] * 5)]
    for extra in ([], [(950, [1e15, 0.0, 0.0, 0.0]), (951, [-4e7, 3e8, 0.0, 1.0])]):
        frame = vectors(spark, rows + odd + extra).repartition(5)
        found, centroids = lloyd.cluster(frame, k=9, rounds=5, dim=4)
        want, slow = slow_lloyd(rows + odd + [(i, [max(min(x, 2.0**53 / 256), -(2.0**53) / 256) for x in v]) for i, v in extra], 9, 5, 4)
        assert sorted((tuple(r) for r in found.collect()), key=str) == want and centroids.tolist() == slow
    out = lloyd.inertia(found, centroids).toPandas()
    assert len(out) == len(want) and set(out.inertia) == {min(out.drop_duplicates("cluster").cluster_inertia.sum(), 2**63 - 1)}
    assert all(r.centroid_sha256 == h(",".join(map(str, slow[r.cluster]))) for r in out.itertuples())
    few, held = lloyd.cluster(vectors(spark, rows[:3]), k=9, dim=4)
    assert few.count() == 3 and len(held) == 3
    same, held = lloyd.cluster(vectors(spark, [(i, [1.0] * 4) for i in range(20)]), k=5, dim=4)
    assert {(r.cluster, r.distance) for r in same.collect()} == {(0, 0)} and held.tolist() == [[256] * 4] * 5
    nothing, held = lloyd.cluster(vectors(spark, odd), k=5, dim=4)
    assert nothing.count() == 0 and lloyd.inertia(nothing, held).count() == 0


def slow_merkle(rows):
    def leaf(r, text):
        return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r[0], r[3], r[2], r[4], text)))

    def climb(nodes):
        """Root, and each leaf's siblings before and after, level by level."""
        paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for p, i in zip(paths, at):
                a = i // 8 * 8
                p.append((level[a:i], level[i + 1 : a + 8]))
            level, at = [h(*level[i : i + 8]) for i in range(0, len(level), 8)], [i // 8 for i in at]
        return level[0], paths

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    root, tops = climb([trees[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        subroot, paths = trees[g]
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths):
            now = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                now = leaf(r, None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            way = path + top
            proof = h(*(d for before, after in way for d in before + after))
            for before, after in way:
                now = h(*before, now, *after)
            out.append((r[0], own, subroot, root, proof, now, now == root))
    return sorted(out, key=str)


def test_merkle(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["Abc", "abc", "", None, "é Ü " * 3, "Z" * 70_000]), rng.choice(["en", "de", "de", "fr", None, "é"]), rng.choice(["s", None]), rng.choice([3, None])) for i in range(700)]
    rows += [(i, "Q", f"l{i:02d}", "s", 1) for i in range(1000, 1012)] + [(5000 + i, "t", "zz", None, 0) for i in range(64)] + [rows[3], rows[3], (None, "N", "en", None, None), (-5, "X", "en", "s", 2)]
    frame = lambda some, n=6: spark.createDataFrame([(*r, "o", "g", 1, 2, "k", "v") for r in some], DOCS + CLASH).repartition(n)
    want = slow_merkle(rows)
    for part in (16, 100, 1 << 16):
        got = merkle.proofs(frame(rows), part=part)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert {r[6] for r in want} == {True, False}
    for few in (rows[:1], rows[:8], rows[:9], [r for r in rows if r[2] == "zz"]):
        assert sorted((tuple(r) for r in merkle.proofs(frame(few, 1), part=4).collect()), key=str) == slow_merkle(few)
    assert merkle.proofs(frame(rows).limit(0)).count() == 0
    kept = merkle.manifest(frame(rows), part=50).toPandas()
    n = sum(r[2] == "de" for r in rows)
    levels = []
    while n > 1:
        n = -(-n // 8)
        levels.append(n)
    own = kept[kept.grp == "=de"]
    assert own.groupby("level").size().tolist() == levels and not own.duplicated(["level", "place"]).any()
    subroot = next(w[2] for w in want if any(r[0] == w[0] and r[2] == "de" for r in rows))
    assert own[own.level == len(levels)].digest.tolist() == [subroot]


def slow_strip(rows, length):
    split = [(2**63 - 1 if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for own, w in split:
        for a in range(len(w) - length + 1):
            key = tuple(w[a : a + length])
            first[key] = min(first.get(key, own), own)
    out = []
    for (i, _), (own, w) in zip(rows, split):
        gone = {b for a in range(len(w) - length + 1) if first[tuple(w[a : a + length])] < own for b in range(a, a + length)}
        out.append((i, len(w), len(gone), b" ".join(x for b, x in enumerate(w) if b not in gone).decode()))
    return sorted(out, key=str)


def test_substrings(spark):
    rng = random.Random(4)
    few, many = [f"w{i}" for i in range(3)], [f"v{i}é" for i in range(400)]
    passages = [" ".join(rng.choice(many) for _ in range(rng.randint(10, 60))) for _ in range(12)]
    rows = []
    for i in range(260):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(rng.choice([few, many, many])) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        rows.append((i * 3 - 50, rng.choice([" ", "\n", "\t ", "\x0b"]).join(parts)))
    rows += [(900 + i, rows[40][1]) for i in range(30)] + [rows[40], (rows[41][0], passages[0] + " end"), (None, passages[1]), (None, passages[1] + " x"), (None, None), (1, ""), (2, " \n")]
    rows += [(2000, "a b " * 30_000), (2001, "a b " * 40), (2002, passages[2] + " " + passages[2]), (2003, " ".join(["q"] * 20)), (2004, " ".join(["q"] * 12)), (2005, " ".join(["q"] * 12))]
    frame = spark.createDataFrame([(*r, "en", "s", 1, "o", "g", 1, 2, "k", "v") for r in rows], DOCS + CLASH).repartition(7)
    names = ["doc_id", "n_words_", "n_removed", "kept_"]
    for length, most, states in ((13, 2048, 100_000), (13, 1, 50), (4, 2, 100_000)):
        got = substrings.strip(frame, length=length, most=most, states=states)
        assert got.columns == [*frame.columns, *names[1:]]
        found = sorted((tuple(r) for r in got.select(*names).collect()), key=str)
        assert found == slow_strip(rows, length)
        assert any(r[2] for r in found)
    assert substrings.strip(frame.limit(0)).count() == 0


def test_automaton_against_search():
    rng = random.Random(1)
    for _ in range(60):
        machine, added = substrings.Automaton(), []
        for owner in range(12):
            s = [rng.choice("abc").encode() for _ in range(rng.randint(1, 25))]
            for length in (1, 3, 5):
                want = [min((o for o, t in added for b in range(len(t)) if t[b : b + length] == s[a : a + length]), default=None) for a in range(len(s) - length + 1)]
                assert machine.stream(s, length) == want
            machine.add(s, owner)
            added.append((owner, s))


def test_long_texts_in_chunks(monkeypatch):
    rng = random.Random(3)
    text = [rng.choice(["a", "b", "c", "d"]).encode() for _ in range(5000)]
    whole = substrings.pieces(text, 13)
    monkeypatch.setattr(substrings, "CHUNK", 37)
    assert all(np.array_equal(a, b) for a, b in zip(whole, substrings.pieces(text, 13)))
