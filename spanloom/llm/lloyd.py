"""Centroid clustering by plain Lloyd rounds over whole numbers.

Vectors become integers, floor(scale * x). The first centroids are the vectors with the smallest hashes of their ids. In a round the
centroids, k rows of whole numbers whatever the table's size, are broadcast; ``mapInPandas`` takes integer squared differences to one centroid after the
other, the nearest wins (of equals the lower index), and each task gives one row for each centroid that it met: a count and sums by component. ``groupBy`` merges these by addition,
so that no order of rows, tasks or attempts can change a bit, and the driver gets k rows. The integer vectors are written to the shared folder once.

Components are held within +-2^53. A vector with a component beyond ``LARGE`` has its differences worked in whole numbers of any size, and a distance
beyond 2^63 - 1 is returned as that; so are sums of distances.

Defined results: null vectors, vectors of another length and vectors with null or non-finite components take no part and get no row; repeated rows take part each, and
of equal hashes the smaller vector is the earlier centroid; a row with a null id takes part, but is a first centroid only after all with ids; fewer vectors than k give as many
clusters; equal first centroids leave the later ones empty, and empty ones stay where they are; other columns, whatever their names, have no part; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, store
from .vectors import finite

LARGE = 1 << 26  # 64 squares of differences between such components stay below 2^62
MOST = 1 << 53
LONG = (1 << 63) - 1
ROWS = 4096  # vectors worked at a time


def whole(frame: DataFrame, vec_id: str, embedding: str, dim: int, scale: float) -> DataFrame:
    """(vec_id, v): the rows that take part, as whole numbers."""
    x = F.col(embedding).cast("array<double>")
    part = frame.select(F.col(vec_id).alias("vec_id"), x.alias("x")).where((F.size("x") == dim) & finite(F.col("x")))
    most = F.lit(float(MOST))
    return part.select("vec_id", F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, most), -most)).cast("long")).alias("v"))


def first_centroids(rows: DataFrame, k: int, salt: str) -> np.ndarray:
    own = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(own.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in found], np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each row's nearest centroid."""
    big = (np.abs(v).max(axis=1, initial=0) > LARGE) | (np.abs(centroids).max(initial=0) > LARGE)
    index, distance = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    plain = np.flatnonzero(~big)
    for at in range(0, len(plain), ROWS):
        some = plain[at : at + ROWS]
        squares = np.empty((len(some), len(centroids)), np.int64)
        for j, c in enumerate(centroids):
            d = v[some] - c
            squares[:, j] = np.einsum("ij,ij->i", d, d)
        index[some] = squares.argmin(axis=1)
        distance[some] = squares.min(axis=1)
    for i in np.flatnonzero(big).tolist():
        squares = [sum((a - b) ** 2 for a, b in zip(v[i].tolist(), c)) for c in centroids.tolist()]
        index[i] = min(range(len(squares)), key=squares.__getitem__)
        distance[i] = min(squares[index[i]], LONG)
    return index, distance


def matrix(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.int64) if len(pdf) else np.zeros((0, dim), np.int64)


def sums(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, s0, s1, ...: of every centroid that is some vector's nearest, the count of its vectors and their sums by component."""
    k, dim = centroids.shape
    held = rows.sparkSession.sparkContext.broadcast(centroids)
    low = (1 << 26) - 1

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, high, rest = np.zeros(k, np.int64), np.zeros((k, dim), np.int64), np.zeros((k, dim), np.int64)
        for pdf in batches:
            v = matrix(pdf, dim)
            index, _ = nearest(v, held.value)
            n += np.bincount(index, minlength=k)
            for j in np.unique(index).tolist():  # in two halves, so that sums of a task stay whole however large the components
                own = v[index == j]
                high[j] += (own >> 26).sum(axis=0)
                rest[j] += (own & low).sum(axis=0)
        met = np.flatnonzero(n).tolist()
        yield pd.DataFrame(
            [[j, int(n[j]), *(str((h << 26) + r) for h, r in zip(high[j].tolist(), rest[j].tolist()))] for j in met], columns=["cluster", "n", *(f"s{i}" for i in range(dim))]
        )

    part = rows.select("v").mapInPandas(run, "cluster long, n long, " + ", ".join(f"s{i} string" for i in range(dim)))
    return part.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col(f"s{i}").cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)))


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""
    kind, dim = rows.schema["vec_id"].dataType.simpleString(), centroids.shape[1]
    held = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, distance = nearest(b.column("v").flatten().to_numpy().reshape(-1, dim), held.value)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(index, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")


def cluster(frame: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", *, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of every vector that takes part, stored, and the final centroids."""
    lean(frame)
    rows = store(whole(frame, vec_id, embedding, dim, scale), "whole")
    centroids = first_centroids(rows, k, salt).reshape(-1, dim)
    for _ in range(rounds if len(centroids) else 0):
        now = centroids.copy()
        for r in sums(rows, centroids).collect():  # one row for each centroid
            now[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dim)]
        centroids = now
    if not len(centroids):
        return frame.sparkSession.createDataFrame([], f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), centroids
    return store(assigned(rows, centroids), "assigned"), centroids


def inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``found`` with cluster_inertia, inertia and centroid_sha256, from a table of one row for each centroid."""
    per = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    total = min(sum(per.values()), LONG)
    rows = [(j, min(s, LONG), total, digest[j]) for j, s in per.items()]
    known = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
