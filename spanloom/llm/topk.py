"""Exact top-k by integer inner product: pivot-table elimination.

Vectors are turned into integers, floor(scale * x). Pivots are vectors far apart from each other: of ``SAMPLE`` rows with the smallest hashes
of their ids (a fixed number, whatever the table's size) one after the other is taken whose nearest pivot so far is farthest. Each
row's distances to all pivots are computed once, when its shard is read. The largest ``|d(q, p) - d(x, p)|`` is a lower bound of d(q, x), so
(|q|^2 + |x|^2 - bound^2) / 2 is an upper bound of the inner product. Candidates are evaluated in the order of that bound, until the next
bound is below the last score to keep: what is left can neither beat nor tie it. Where sums stay below 2^53 they are exact in
doubles; where they may not, they are worked in whole numbers of any size, and vectors with components beyond ``LARGE``
have no bounds but are evaluated always.

Defined results: null vectors, vectors with null or non-finite components and rows with a null id take no part; zero and
empty vectors do; a score beyond 2^63 - 1 or below its negative is that, and ranks as that; a component whose multiple by ``scale`` is infinite counts as the largest double; repeated
rows are candidates each, and one query; ties go to the smaller id; fewer candidates than k give all of them; vectors of different
lengths never meet; other columns, whatever their names, have no part; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors

PIVOTS, SAMPLE = 32, 512
ROWS = 64  # queries whose bounds are worked at a time
FIRST = 256  # candidates evaluated at first
LARGE = 2.0**40
LONG = (1 << 63) - 1


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0))


def whole(rows: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), as doubles."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(rows * scale), posinf=np.finfo(float).max, neginf=-np.finfo(float).max)


def exact_scores(a: np.ndarray, most: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of rows with ``q`` as longs. ``most``: each row's largest component."""
    with np.errstate(over="ignore", invalid="ignore"):
        safe, sums = most * (np.abs(q).max(initial=0) * max(1, len(q))) < 2**52, a @ q
    if safe.all():
        return sums.astype(np.int64)
    out = np.where(safe, sums, 0.0).astype(np.int64)
    parts = [int(x) for x in q]
    for i in np.flatnonzero(~safe).tolist():
        out[i] = min(max(sum(int(x) * y for x, y in zip(a[i].tolist(), parts)), -LONG), LONG)
    return out


def far_apart(rows: np.ndarray, n: int) -> np.ndarray:
    """At most n of the rows, each as far as can be from those before."""
    if not len(rows):
        return rows
    picked, left = [0], distances(rows, rows[:1])[:, 0]
    while len(picked) < min(n, len(rows)) and left.max() > 0:
        picked.append(int(left.argmax()))
        left = np.minimum(left, distances(rows, rows[picked[-1:]])[:, 0])
    return rows[picked]


class Index:
    def __init__(self, own: np.ndarray, rows: np.ndarray, pivots: dict[int, np.ndarray]) -> None:
        self.rows, self.groups = vectors.copies(rows, own)
        self.first = np.array([g[0] for g in self.groups])
        self.most = np.abs(self.rows).max(axis=1, initial=0)
        self.large = self.most > LARGE
        near = np.where(self.large[:, None], 0.0, self.rows)
        self.pivots = pivots.get(rows.shape[1], np.zeros((0, rows.shape[1])))
        self.table, self.square = distances(near, self.pivots), (near**2).sum(axis=1)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all products, above all rounding."""
        big = np.abs(queries).max(axis=1, initial=0) > LARGE
        near = np.where(big[:, None], 0.0, queries)
        low = np.zeros((len(queries), len(self.rows)))
        for mine, theirs in zip(distances(near, self.pivots).T, self.table.T):
            np.maximum(low, np.abs(mine[:, None] - theirs[None, :]), out=low)
        square = (near**2).sum(axis=1)[:, None]
        bound = np.minimum((square + self.square - low**2) / 2, np.sqrt(square * self.square)) + 1e-9 * (square + self.square) + 1e-3
        bound[:, self.large] = np.inf
        bound[big] = np.inf
        return bound


def top(frame: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, every: int = 50, k: int = 5, scale: float = 256.0, pivots: int = PIVOTS, **sizes: int) -> DataFrame:
    """query_id, rank, vec_id, score (long): for each row whose id ``every`` divides, the k rows with the highest scores."""
    rows = vectors.valid(frame, vec_id, embedding, nonzero=False)
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect():
        sample.setdefault(len(r["v"]), []).append(r["v"])
    spread = {}
    for size, some in sample.items():
        some = whole(np.array(some, float).reshape(len(some), size), scale)
        spread[size] = far_apart(some[np.abs(some).max(axis=1, initial=0) <= LARGE], pivots)

    def build(own: np.ndarray, v: np.ndarray) -> Index:
        return Index(own, whole(v, scale), spread)

    def ask(index: Index, ids: np.ndarray, queries: np.ndarray) -> vectors.Found:
        out = []
        queries = whole(queries, scale)
        for at in range(0, len(queries), ROWS):
            block = queries[at : at + ROWS]
            for i, (q, v, b) in enumerate(zip(ids[at : at + ROWS].tolist(), block, index.bounds(block)), at):
                order = np.argsort(-b)
                scores, done, step = np.zeros(0, np.int64), 0, FIRST
                while done < len(order):
                    some = order[done : done + step]
                    scores = np.concatenate([scores, exact_scores(index.rows[some], index.most[some], v)])
                    done, step = min(done + step, len(order)), step * 2
                    # The query's own vector may hold one place, so the k + 1st distinct vector's score must stand above the rest.
                    if done < len(order) and done > k and np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] > b[order[done]]:
                        break
                edge = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1] if len(scores) > k else scores.min()
                keep = np.flatnonzero(scores >= edge)
                keep = keep[np.lexsort((index.first[order[keep]], -scores[keep]))][: k + 1]
                some, best = vectors.best(q, k, scores[keep], [index.groups[x] for x in order[keep]])
                out.append((np.full(len(some), i), some, best))
        return tuple(np.concatenate(x) for x in zip(*out))

    return vectors.search(rows, every, k, build, ask, "long", **sizes)
