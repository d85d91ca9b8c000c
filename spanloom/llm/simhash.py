"""SimHash near-duplicates found by covering locality-sensitive hashing.

Texts become 64-bit fingerprints; fingerprints at ``radius`` or fewer differing bits are linked. The tables
are the masks of a covering code: bit ``i`` has a vector ``m(i)`` of ``radius + 1`` bits, table ``v`` keeps the
bits with ``<m(i), v>`` odd. For any ``radius`` bits some non-zero ``v`` is orthogonal to all their vectors, so its
table drops them all: two fingerprints within the radius agree in full on what that table keeps. No pair is missed, and
there are ``2 ** (radius + 1) - 1`` tables.

Only distinct fingerprints are searched, so copies cost nothing. A bucket of more than ``most`` fingerprints
is dealt again by a second covering of the bits that its mask dropped, and then by a third; what is left in
one bucket then agrees in so many bits that few distinct values can exist. A bucket gives the links of a
spanning forest of its own graph, never all pairs. Components follow from min-label contraction
(large-star and small-star rounds), each round written to the shared folder.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any other;
fewer words than a shingle make one shingle; repeated rows are kept, each with its component; a null id takes
part, and a component of null ids alone has a null id; columns other than id and text have no part, and ``one_of_each`` keeps them whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, fresh, lean, store

BITS = 64
CHUNK = 32_768  # shingles hashed at a time, whatever the length of a text


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Majority of the bits of the XXH64 of all word shingles, as an unsigned number."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and ASCII white space
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1]
    ends = ends[words - 1 :]
    ones, h = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        hashes = [h(joined[a:b], seed) for a, b in zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id, fp, key): fp is the fingerprint as a signed long, key a hash of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), b.column(2)], ["doc_id", "fp", "key"])

    lean(docs)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key")).mapInArrow(run, f"doc_id {kind}, fp long, key long")


def masks(radius: int, turn: int = 0) -> np.ndarray:
    """For each table the mask of the bits it keeps. ``turn`` deals the vectors to the bits anew."""
    n = 1 << (radius + 1)
    order = np.random.default_rng(turn).permutation(BITS) % (n - 1) + 1
    odd = np.array([[bin(int(m) & v).count("1") & 1 for m in order] for v in range(1, n)], bool)
    return np.array([sum(1 << i for i in range(BITS) if row[i]) for row in odd], np.uint64)


def signed(x: np.ndarray) -> list[int]:
    return x.view(np.int64).tolist()


def forest(values: np.ndarray, radius: int, block: int = 512) -> list[tuple[int, int]]:
    """Links of a spanning forest of the distinct values' graph, by breadth-first search: what is unreached is compared
    with the newly reached only, in blocks."""
    left = np.arange(len(values))
    links: list[tuple[int, int]] = []
    while len(left):
        queue, left = left[:1], left[1:]
        while len(queue) and len(left):
            now, queue = queue[:block], queue[block:]
            near = np.bitwise_count(values[left][:, None] ^ values[now][None, :]) <= radius
            hit = near.any(axis=1)
            links += zip(values[now[near[hit].argmax(axis=1)]].tolist(), values[left[hit]].tolist())
            queue, left = np.concatenate([queue, left[hit]]), left[~hit]
    return links


def links(distinct: DataFrame, radius: int = 4, most: int = 4096) -> DataFrame:
    """(a, b): links that join up exactly what pairs of fingerprints within the radius join up."""

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        found = forest(np.unique(pdf["fp"].to_numpy()).view(np.uint64), radius)
        return pd.DataFrame(np.array(found, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])

    def runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by bucket; a bucket may go over several batches."""
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["bucket"].to_numpy()
            cut = int(np.searchsorted(np.cumsum(np.concatenate(([True], last[1:] != last[:-1]))), np.count_nonzero(last[1:] != last[:-1]) + 1)) if len(pdf) else 0
            done, rest = pdf.iloc[:cut], pdf.iloc[cut:]
            yield from whole(done)
        if rest is not None:
            yield from whole(rest)

    def whole(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        bucket, fp = pdf["bucket"].to_numpy(), pdf["fp"].to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(pdf) else np.array([0])
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
        near = np.bitwise_count(a ^ b) <= radius
        yield pd.DataFrame({"a": a[near].view(np.int64), "b": b[near].view(np.int64)})
        for at, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            yield within(pdf.iloc[at : at + n])

    def dealt(frame: DataFrame, turn: int) -> DataFrame:
        """A row for each table: the mask is what is kept already and what table ``turn`` of the covering keeps of the rest."""
        kept = F.explode(F.array(*map(F.lit, signed(masks(radius, turn)))))
        wide = frame.withColumn("more", kept).withColumn("mask", F.col("mask").bitwiseOR(F.col("more"))).drop("more")
        return wide.withColumn("bucket", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))

    rows, parts = distinct.select("fp", F.lit(0).cast("long").alias("mask")), []
    for turn in range(3):
        rows = dealt(rows, turn)
        # Buckets of one fingerprint, nearly all of them, go before anything is gathered. The bucket's hash may join two buckets: more to compare, nothing lost.
        # Both sides are merged: Spark sizes a row and all its tables as that row, so that it would broadcast every table's rows.
        count = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
        rows = rows.hint("merge").join(count, "bucket")
        if turn < 2:
            rows = store(rows, f"buckets{turn}")
            large = rows.where(F.col("n") > most)
        small = rows if turn == 2 else rows.where(F.col("n") <= most)
        small = small.select("bucket", "fp").repartition(F.xxhash64("bucket")).sortWithinPartitions("bucket", "fp")
        parts.append(store(small.mapInPandas(runs, "a long, b long").distinct(), f"links{turn}"))
        if turn == 2 or large.isEmpty():
            break
        rows = large.select("fp", "mask")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge: root is the smallest node that is reached. Large-star and small-star rounds
    (Kiveris et al. 2014) until a round changes nothing; every step is an aggregation and a join."""
    now = store(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), "star")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))  # v's neighbours are u
        least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(joined.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        after = store(small, "star")
        sums = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        state = sums(after)
        drop_stored(now)
        now = after
        if state == before or state[0] == 0:
            return now.select(F.col("v").alias("node"), F.col("u").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 4, radius: int = 4, most: int = 4096) -> DataFrame:
    """(doc_id, fp, key, component_id): one row for each row of ``docs``."""
    slim = store(fingerprints(docs, doc_id, text, words), "fingerprints")
    distinct = store(slim.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct, radius, most))
    labelled = distinct.join(roots, F.col("fp") == F.col("node"), "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    named = labelled.select("fp", "root").join(least, "root").select("fp", "component_id")
    return slim.join(named, "fp").select("doc_id", "fp", "key", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, found: DataFrame | None = None, **how: int) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id, then text hash; of rows that agree in both, one.
    ``found``: components by another measure, as ``near_duplicates`` gives them."""
    found = near_duplicates(docs, doc_id, text, **how) if found is None else found
    own, own_key, rows = fresh(docs.columns, "id__", "key__", "rows__")
    root = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    by_row = found.groupBy(root.alias("root"), "doc_id", "key").agg(F.count("*").alias("rows"))
    first = by_row.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", "rows")).alias("kept")).select("kept.*").select(
        F.col("doc_id").alias(own), F.col("key").alias(own_key), F.col("rows").alias(rows)
    )
    kept = docs.join(first, F.col(doc_id).eqNullSafe(F.col(own)) & F.xxhash64(text).eqNullSafe(F.col(own_key)))
    repeated = kept.where(F.col(rows) > 1).dropDuplicates([own, own_key])
    return kept.where(F.col(rows) == 1).unionByName(repeated).drop(own, own_key, rows)
