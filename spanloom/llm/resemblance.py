"""Texts that share most of their word shingles: SimHash and MinHash candidates, verified by exact Jaccard similarity.

A text is the set of its five-word shingles, hashed. First the operator of ``simhash`` works: the sets' texts get its fingerprints, its covering tables give the
links within four bits, and those that hold on the whole sets, a Jaccard similarity of ``least`` or more, are contracted into components. Texts of that
similarity often differ in more bits, so MinHash follows for what is still apart: ``BANDS`` bands of ``ROWS`` minima each put it into as many buckets;
two texts of similarity s share one with probability ``1 - (1 - s ** ROWS) ** BANDS``: 0.9999 at 0.8. Pairs of different
components in a bucket are candidates only; those with a Jaccard similarity of ``least`` or more, counted on the whole sets, are linked. Components
follow as in ``simhash``: a text is linked to another of its component, not to each of them.

Only distinct sets are searched, so copies cost nothing. A bucket of at most ``MOST`` sets gives all its pairs. A larger one is mostly a family
of near copies around one text. Of its sets the one that is in the largest buckets is its hub, and every set is compared with the hubs of its buckets;
what is in one component then needs no more comparing. Where a hub still has several components around it, a pair of different ones is compared unless it cannot be alike, by two
exact rules: one minus the similarity is a metric, so that the similarities of two such sets to the hub differ by at most ``1 - least``; and sets of n and m shingles share at least
``least / (1 + least) * (n + m)``, so that each shares as many with the hub, or the two share some that the hub has not. They are joined by these, from rare to frequent, as long as what lies
behind in the order and what is shared with the hub can make up that number: a passage that many have does not join them all. No pair is left
out for the size of its bucket, and no bucket is held by one task.

Defined results: a null text is empty; texts without words are alike; fewer words than a shingle make one shingle;
repeated rows are kept, each with its component; a null id takes part; columns other than id and text have no part; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, store
from .simhash import components, fingerprint
from .simhash import links as covering_links

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 24, 5
MOST = 16
CHUNK = 2048  # shingles whose minima are taken at a time
_draw = np.random.default_rng(5).integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
FACTORS, SHIFTS = _draw[0] * np.uint64(2) + np.uint64(1), _draw[1]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct XXH64 of all word shingles, sorted."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z alone, and ASCII white space
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(joined)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1]
    return np.unique(np.fromiter((h(joined[a:b]) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(starts)))


def name(held: np.ndarray) -> int:
    """One number for a set."""
    return xxhash.xxh64_intdigest(held.tobytes())


def buckets(held: np.ndarray) -> list[int]:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), CHUNK):
        least = np.minimum(least, (held[at : at + CHUNK] * FACTORS + SHIFTS).min(axis=1))
    return [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least.reshape(BANDS, ROWS))]


def long(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def described(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, key, fp, buckets, sim): key is a hash of the text, fp names its set, sim is its SimHash fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, flat, sims = [], [], []
            for t in b.column(1):
                held = shingles(t.as_py())
                names.append(name(held))
                flat += buckets(held)
                sims.append(fingerprint(t.as_py()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * BANDS), long(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), long(names), lists, long(sims)], ["doc_id", "key", "fp", "buckets", "sim"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("key")).mapInArrow(run, f"doc_id {kind}, key long, fp long, buckets array<long>, sim long")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both, size (of b), j: the pairs (a, b) with the number of shingles that both have, and their similarity."""
    left, right = sets.select(F.col("fp").alias("a"), F.col("held").alias("x")), sets.select(F.col("fp").alias("b"), F.col("held").alias("y"))
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), F.size("x").alias("other"), F.size("y").alias("size"))
    return store(counted.select("a", "b", "both", "size", (F.col("both") / (F.col("other") + F.col("size") - F.col("both"))).alias("j")), "compared")


def alike(found: DataFrame, least: float) -> DataFrame:
    return found.where(F.col("j") >= least - 1e-12).select("a", "b")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def shared_buckets(distinct: DataFrame) -> DataFrame:
    """fp, bucket, n (sets of the bucket): for buckets of several sets."""
    rows = distinct.select("fp", F.explode("buckets").alias("bucket"))
    # Merged: Spark sizes the rows of all bands as one row of a set, and would broadcast them.
    return store(rows.hint("merge").join(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket"), "shared")


def with_hubs(shared: DataFrame, most: int) -> DataFrame:
    """fp, bucket, hub: rows of buckets of more than ``most`` sets with the bucket's hub, the set whose buckets have the most sets."""
    rows = shared.where(F.col("n") > most)
    rows = rows.join(rows.groupBy("fp").agg(F.sum("n").alias("weight")), "fp").select("fp", "bucket", "weight")
    hubs = rows.groupBy("bucket").agg(F.max(F.struct("weight", F.col("fp").alias("hub"))).alias("h"))
    return store(rows.drop("weight").join(hubs, "bucket").select("fp", "bucket", "h.hub"), "large")


def small_pairs(shared: DataFrame, most: int) -> DataFrame:
    """The pairs of different components of each bucket of at most ``most`` sets."""
    lists = shared.where(F.col("n") <= most).groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("fp", "root"))).alias("sets"))
    ends = lists.select("sets", F.posexplode("sets").alias("i", "a"))
    pairs = ends.select("a", F.explode(F.slice("sets", F.col("i") + 2, most)).alias("b")).where("a.root <> b.root")
    return pairs.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def simhash_pairs(distinct: DataFrame) -> DataFrame:
    """(a, b): links between sets whose texts' fingerprints are within the radius of ``simhash``, as its covering tables give them; sets of one fingerprint are
    paired with the first of them."""
    sims = distinct.select("fp", F.col("first.sim").alias("sim"))
    heads = store(sims.groupBy("sim").agg(F.min("fp").alias("head"), F.count("*").alias("n")), "heads")
    same = sims.join(heads.where("n > 1"), "sim").select(F.col("head").alias("a"), F.col("fp").alias("b"))
    found = covering_links(heads.select(F.col("sim").alias("fp")))
    one, two = (heads.select(F.col("sim").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab")
    across = found.join(one, "a").join(two, "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    return store(ordered(same.unionByName(across)), "within")


def still_apart(shared: DataFrame) -> DataFrame:
    """The rows of buckets with sets of different components."""
    mixed = shared.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket")
    return store(shared.join(mixed, "bucket"), "apart")


def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the ``root`` of each fp's component."""
    return rows.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def rest_pairs(rated: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs of different components around one hub that can be alike. ``rated``: fp, hub, both (shingles shared with the hub), size, j, root."""
    roots = rated.groupBy("hub", "root").agg(F.count("*").alias("n")).groupBy("hub").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("roots"))
    rest = store(rated.join(roots.where("roots > 1").select("hub", "main"), "hub"), "rest")
    near = (F.col("f.root") != F.col("e.root")) & (F.abs(F.col("f.j") - F.col("e.j")) <= 1 - least + 1e-9)
    ends = [F.col("f.fp").alias("a"), F.col("e.fp").alias("b")]
    # What both share with the hub may do; one end is outside of the hub's largest component.
    fit = rest.where(F.col("both") >= least * F.col("size") - 1e-9)
    once = (F.col("e.root") == F.col("e.main")) | (F.col("f.fp") < F.col("e.fp"))
    enough = F.least("f.both", "e.both") >= F.lit(least / (1 + least)) * (F.col("f.size") + F.col("e.size")) - F.lit(1e-9)
    through = fit.where("root <> main").alias("f").join(fit.alias("e"), (F.col("f.hub") == F.col("e.hub")) & near & once & enough).select(*ends)
    # Else they share a shingle that the hub has not.
    mine, its = sets, sets.select(F.col("fp").alias("hub"), F.col("held").alias("hub_held"))
    own = rest.join(mine, "fp").join(its, "hub").select("fp", "hub", "both", "size", "root", "j", F.explode(F.array_except("held", "hub_held")).alias("h"))
    own = own.repartition("hub", "h")  # a hub with many sets around it is split in the join above, not held together for what follows
    lists = own.groupBy("hub", "h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("sum")).where("low <> high")
    one = F.struct("n", "sum").alias("same")  # shingles that the same sets have count as one, with their number
    mixed = lists.groupBy("hub", one).agg(F.min("h").alias("h"), F.count("*").alias("of_same"))
    # Of what two sets share beside the hub, all lies behind the rarest of it in either's order from rare to frequent.
    behind = F.sum("of_same").over(W.partitionBy("hub", "fp").orderBy("same").rowsBetween(W.currentRow, W.unboundedFollowing))
    own = own.join(mixed, ["hub", "h"]).withColumn("behind", behind)
    own = store(own.where(F.col("behind") + F.col("both") >= least * F.col("size") - 1e-9), "own")
    reach = F.least("f.behind", "e.behind") + F.least("f.both", "e.both") >= F.lit(least / (1 + least)) * (F.col("f.size") + F.col("e.size")) - F.lit(1e-9)
    beside = own.alias("f").join(own.alias("e"), (F.col("f.hub") == F.col("e.hub")) & (F.col("f.h") == F.col("e.h")) & near & reach & (F.col("f.fp") < F.col("e.fp"))).select(*ends)
    return ordered(through.unionByName(beside))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least: float = LEAST, most: int = MOST) -> DataFrame:
    """(doc_id, fp, key, component_id): one row for each row of ``docs``."""
    lean(docs)
    slim = store(described(docs, doc_id, text), "described")
    distinct = store(
        slim.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "sim")).alias("first"), F.first("buckets").alias("buckets")), "distinct"
    )
    within = simhash_pairs(distinct)
    shared = shared_buckets(distinct)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp, t in zip(b.column(0), b.column(1)):
                yield pa.RecordBatch.from_arrays([pa.array([fp.as_py()], pa.int64()), pa.array([shingles(t.as_py()).view(np.int64)], pa.list_(pa.int64()))], ["fp", "held"])

    asked = shared.select("fp").unionByName(within.select(F.col("a").alias("fp"))).unionByName(within.select(F.col("b").alias("fp"))).distinct()
    first = distinct.join(asked, "fp").select("fp", F.col("first.doc_id").alias("__id"), F.col("first.key").alias("__key"))
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    texts = read.join(first, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key"))).select("fp", "text")
    sets = store(texts.mapInArrow(whole, "fp long, held array<long>").dropDuplicates(["fp"]), "sets")

    links = alike(compared(within, sets), least)
    apart = still_apart(labelled(shared, links))
    links = links.unionByName(alike(compared(ordered(small_pairs(apart, most)), sets), least))
    large = with_hubs(apart, most)
    if not large.isEmpty():
        hubs = compared(large.select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct(), sets)
        links = links.unionByName(alike(hubs, least))
        rated = store(labelled(hubs.select(F.col("a").alias("hub"), F.col("b").alias("fp"), "both", "size", "j"), links), "rated")
        links = links.unionByName(alike(compared(rest_pairs(rated, sets, least), sets), least))
    found = labelled(distinct, links).select("fp", "first.doc_id", "root")
    ids = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return slim.select("doc_id", "fp", "key").join(found.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "key", "component_id")
