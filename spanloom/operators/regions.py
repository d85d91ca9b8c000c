"""Regions: alignments that may be joined, and intervals that overlap, come together.

Alignments of one (target, query, strand) at most ``distance`` apart make one run; runs that overlap or touch make one region.
A run ends where the next start lies more than ``distance`` beyond the largest end so far: the same as letting every
alignment reach to the ends of all later ones within the distance of its own end, without that self-join.
The merge is done in bins of a target and across bins on the two islands at most that touch a bin's edges, so one long target is no single task's sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import totals_before

BIN = 1 << 20  # positions
NEAR = 128  # positions of a bin in which rows look for their region


def islands(frame: DataFrame, keys: list[str], start: str, end: str, gap: int = 0) -> DataFrame:
    """keys, start, end, n of the maximal runs of intervals whose starts are at most ``gap`` beyond the largest end before."""
    w = W.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    breaks = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    marked = frame.withColumn("__break", breaks)
    numbered = marked.withColumn("__island", F.sum("__break").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    n = F.sum("n") if "n" in frame.columns else F.count("*")
    return numbered.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), n.cast("long").alias("n")).drop("__island")


def merged(frame: DataFrame, keys: list[str], start: str, end: str, gap: int = 0, bin_width: int = BIN) -> DataFrame:
    """``islands``, found in bins and put together across them. An interval goes to each bin that it or its gap reaches, and counts in its own. What lies within a bin is then done;
    of a bin at most the first and the last island touch an edge, and only those are sorted by key again."""
    first, last = F.floor(F.col(start) / bin_width), F.floor((F.col(end) + gap) / bin_width)
    f = frame.select(*keys, start, end, F.col("n") if "n" in frame.columns else F.lit(1).cast("long").alias("n"), F.explode(F.sequence(first, last)).alias("__bin"))
    f = f.withColumn("n", F.when(F.col("__bin") == first, F.col("n")).otherwise(F.lit(0)).cast("long"))
    local = islands(f, [*keys, "__bin"], start, end, gap)
    touches = (first < F.col("__bin")) | (last > F.col("__bin"))
    return islands(local.withColumn("__bin", F.when(~touches, F.col("__bin"))), [*keys, "__bin"], start, end, gap).drop("__bin")


def regions(alignments: DataFrame, distance: int, extra: DataFrame | None = None, bin_width: int = BIN) -> DataFrame:
    """target_id, region (from 0 within the target), region_start, region_end, n. ``extra``: more intervals
    (target_id, target_start, target_end) that are merged but reach no further than themselves."""
    runs = merged(alignments.select("target_id", "query_id", "strand", "target_start", "target_end"), ["target_id", "query_id", "strand"], "target_start", "target_end", distance, bin_width)
    spans = runs.select("target_id", "target_start", "target_end", "n")
    if extra is not None:
        spans = spans.unionByName(extra.select("target_id", "target_start", "target_end", F.lit(1).cast("long").alias("n")))
    out = merged(spans, ["target_id"], "target_start", "target_end", 0, bin_width)
    number = F.row_number().over(W.partitionBy("target_id").orderBy("target_start")) - 1  # a target has no more regions than its length has join distances
    return out.select("target_id", number.cast("long").alias("region"), F.col("target_start").alias("region_start"), F.col("target_end").alias("region_end"), "n")


def assign(frame: DataFrame, found: DataFrame, start: str = "target_start", bin_width: int = NEAR, keys: tuple[str, ...] = ("target_id",), span: tuple[str, str] = ("region_start", "region_end")) -> DataFrame:
    """``frame`` with the columns of the region that holds each row's start: an equi-join on the keys and bins, as regions do not overlap. Bins are narrow, as a row meets all regions of its bin;
    the join is merged, as Spark sizes a region and its bins as one row and would broadcast them."""
    low, high = span
    spread = found.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(low) / bin_width), F.floor(F.col(high) / bin_width))))
    left = frame.withColumn("__bin", F.floor(F.col(start) / bin_width))
    return left.join(spread.hint("merge"), [*keys, "__bin"]).where(F.col(start).between(F.col(low), F.col(high))).drop("__bin")


def numbered(found: DataFrame) -> DataFrame:
    """Regions numbered over all targets, by target and start: a region's number within its target and the counts of the targets before, summed by ranges of target ids."""
    per = found.groupBy("target_id").agg(F.count("*").alias("k"))
    before = totals_before(per, "target_id", F.col("k"), name="base").select("target_id", "base")
    return found.join(before, "target_id").withColumn("region_id", (F.col("base") + F.col("region")).cast("long")).drop("base")


def range_pairs(left: DataFrame, right: DataFrame, keys: list[str], low: Column, high: Column, point: Column, width: int) -> DataFrame:
    """Pairs with equal keys and ``low <= point <= high``: a left row goes to every bucket that its range meets, a right
    row to one. Columns of the two sides are reached as ``a.`` and ``b.``."""
    a = left.withColumn("__bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))).alias("a")
    b = right.withColumn("__bucket", F.floor(point / width)).alias("b")
    on = F.col("a.__bucket") == F.col("b.__bucket")
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    return a.join(b, on)


def reaches(alignments: DataFrame, distance: int) -> DataFrame:
    """target_id, ord, partners, reach: how far each alignment goes if it takes in the later ones of its query and strand."""
    keys = ["target_id", "query_id", "strand"]
    pairs = range_pairs(alignments, alignments, keys, F.col("target_start"), F.col("target_end") + distance, F.col("target_start"), max(64, distance))
    pairs = pairs.where((F.col("b.ord") > F.col("a.ord")) & (F.col("b.target_start") <= F.col("a.target_end") + distance))
    found = pairs.groupBy("a.target_id", "a.ord").agg(F.count("*").alias("partners"), F.max("b.target_end").alias("far"))
    return alignments.join(found, ["target_id", "ord"], "left").select(
        "target_id", "ord", F.coalesce("partners", F.lit(0)).cast("long").alias("partners"), F.greatest("target_end", "far").alias("reach")
    )


def faults(alignments: DataFrame, found: DataFrame, distance: int, bin_width: int = BIN) -> DataFrame:
    """target_id, touching, parted: regions that begin no later than an earlier one of their target ends, and alignments whose start lies within the distance of the end so
    far of their query and strand, but in another region than the one before. Nothing where regions are right."""
    upto = W.partitionBy("target_id").orderBy("region_start", "region_end").rowsBetween(W.unboundedPreceding, -1)
    touching = found.withColumn("__end", F.max("region_end").over(upto)).groupBy("target_id").agg(F.sum((F.col("region_start") <= F.col("__end")).cast("long")).alias("touching"))
    own = W.partitionBy("target_id", "query_id", "strand").orderBy("target_start", "target_end")
    a = assign(alignments.select("target_id", "query_id", "strand", "target_start", "target_end"), found, bin_width=bin_width)
    a = a.withColumn("__end", F.max("target_end").over(own.rowsBetween(W.unboundedPreceding, -1))).withColumn("__before", F.lag("region").over(own))
    parted = a.groupBy("target_id").agg(F.sum(((F.col("target_start") - F.col("__end") <= distance) & (F.col("region") != F.col("__before"))).cast("long")).alias("parted"))
    out = touching.join(parted, "target_id", "full_outer")
    return out.select("target_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in ("touching", "parted")))
