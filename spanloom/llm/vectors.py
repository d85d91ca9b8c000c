"""What both searches over vectors share: shards of candidates, each with an index of its own, and the queries that come to it in batches.

Candidates are dealt by a hash of their id to shards of about ``SHARD`` rows, and the stated queries go to every shard. What is sent is the number of queries
times that of shards, so a table that has more than ``SHARDS`` of them gets larger ones instead, until a shard's vectors take ``ROOM`` bytes as doubles. A task reads
its shards one after the other, in order: first a shard's candidates, from which its index is built once, then the queries,
``BLOCK`` at a time. So memory follows the shard and the block, never the table or the number of queries; a lost task builds its
shards' indexes again. Each shard gives its own best rows, and the best of a query over all shards are taken by rank, which Spark does
within a task before it shuffles. Vectors of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean

SHARD, BLOCK = 4096, 1024
SHARDS, ROOM = 4096, 32 << 20

#: Of one batch of queries: for each row found the query's place in the batch, the candidate's id, the score.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def finite(vector: Column) -> Column:
    """Not null, and without null, NaN or infinite components."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def valid(frame: DataFrame, vec_id: str, embedding: str, *, nonzero: bool) -> DataFrame:
    """(id, v): rows that take part. A null id can be neither returned nor asked for, and takes none. Floats stay floats until they are worked."""
    single = frame.schema[embedding].dataType.simpleString() == "array<float>"
    v = F.col("v")
    out = frame.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v")).where(F.col("id").isNotNull() & finite(v))
    return out.where(F.exists(v, lambda x: x != 0)) if nonzero else out


def matrix(rows: pa.Table | pa.RecordBatch, name: str = "v") -> np.ndarray:
    values = rows.column(name)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def copies(vectors: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct vectors, and the ids of each in ascending order."""
    if vectors.shape[1] == 0:
        return vectors[:1], [np.sort(own)]
    rows = np.ascontiguousarray(vectors + 0.0)  # -0.0 becomes 0.0
    _, first, inverse = np.unique(rows.view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel(), return_index=True, return_inverse=True)
    order = np.lexsort((own, inverse))
    cuts = np.flatnonzero(np.diff(inverse[order])) + 1
    return vectors[first], np.split(own[order], cuts)


def runs(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches with one value of the named columns each, and that value."""
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(n).cast(pa.int64()).to_numpy(zero_copy_only=False) for n in names])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
        for a, e in zip(cuts, cuts[1:]):
            yield tuple(keys[:, a].tolist()), b.slice(a, e - a)


def shards_of(rows: int, size: int, shard: int = SHARD, most: int = SHARDS, room: int = ROOM) -> int:
    """How many shards ``rows`` vectors of at most ``size`` components are dealt to. It follows from the table alone, not from the cluster."""
    wide = max(shard, min(-(-rows // most), room // (8 * max(1, size))))
    return max(1, -(-rows // wide))


def search(frame: DataFrame, every: int, k: int, build: Callable[[np.ndarray, np.ndarray], object], ask: Callable[[object, np.ndarray, np.ndarray], Found],
           score_type: str, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score. ``frame`` has (id, v); queries are its rows whose id ``every`` divides, one for each id and vector.
    ``build(ids, vectors)`` makes a shard's index, ``ask(index, query ids, queries)`` finds each query's best rows in it."""
    lean(frame)
    spark = frame.sparkSession
    shards = shards_of(*frame.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first(), shard)
    parts = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    dim = F.size("v").alias("dim")
    rows = frame.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), dim, F.lit(0).alias("asks"), "id", "v")
    asked = frame.where(F.col("id") % every == 0).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), dim, F.lit(1).alias("asks"), "id", "v")
    dealt = rows.unionByName(asked).repartitionById(parts, F.col("shard") % parts).sortWithinPartitions("shard", "dim", "asks")
    names = ["query_id", "vec_id", "score"]
    kind = {"long": pa.int64(), "double": pa.float64()}[score_type]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, [], None
        for (of, size, asks), part in runs(batches, ["shard", "dim", "asks"]):
            if now != (of, size):
                now, held, index = (of, size), [], None
            if not asks:
                held.append(part)
                continue
            if held:
                whole = pa.Table.from_batches(held)
                index, held = build(whole.column("id").to_numpy(), matrix(whole)), []
            for at in range(0, part.num_rows if index is not None else 0, block):
                some = part.slice(at, block)
                own = some.column("id").to_numpy()
                place, ids, scores = ask(index, own, matrix(some))
                yield pa.RecordBatch.from_arrays([pa.array(own[place], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, kind)], names)

    found = dealt.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    value = F.nanvl("score", F.lit(float("-inf"))) if score_type == "double" else F.col("score")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(value.desc(), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(query: int, k: int, scores: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids other than the query's own: highest score first, ties to the smaller id. scores: of distinct vectors, with their ids."""
    lengths = [len(g) for g in groups]
    every, value = np.concatenate([np.zeros(0, np.int64), *groups]), np.repeat(scores, lengths)
    order = np.lexsort((every, -value))
    order = order[every[order] != query][:k]
    return every[order], value[order]
