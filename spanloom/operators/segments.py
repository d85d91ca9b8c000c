"""Runs along an ordered axis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def segments(trace: DataFrame, keys: list[str], col: str, label: str) -> DataFrame:
    """keys, label, col_start, col_end: maximal runs of one label over adjacent columns."""
    w = W.partitionBy(*keys).orderBy(col)
    new = F.when((F.lag(label).over(w) == F.col(label)) & (F.lag(col).over(w) + 1 == F.col(col)), 0).otherwise(1)
    runs = trace.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return runs.groupBy(*keys, "__run", label).agg(F.min(col).alias("col_start"), F.max(col).alias("col_end")).drop("__run")


def inactive_ranges(active: DataFrame, keys: list[str], col: str) -> DataFrame:
    """keys, col_start, col_end: what lies between active columns that are not adjacent."""
    after = F.lead(col).over(W.partitionBy(*keys).orderBy(col))
    return active.withColumn("__next", after).where(F.col("__next") - 1 != F.col(col)).select(*keys, (F.col(col) + 1).alias("col_start"), (F.col("__next") - 1).alias("col_end"))


def consensus(frame: DataFrame, keys: list[str], pos: str, gap: str, start: str, step: str) -> DataFrame:
    """``frame`` with ``consensus``: ``start`` moved by ``step`` for every earlier row of the key that is no gap."""
    before = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    moved = F.coalesce(F.sum(F.when(F.col(gap), 0).otherwise(F.col(step))).over(before), F.lit(0))
    return frame.withColumn("consensus", (F.col(start) + moved).cast("long"))


def carry_forward(frame: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """``frame`` with ``carried``: the last value that is not null, 0 before any."""
    upto = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow)
    return frame.withColumn("carried", F.coalesce(F.last(value, ignorenulls=True).over(upto), F.lit(0)))


def active(cells: DataFrame, keys: list[str], col: str) -> DataFrame:
    """keys, col, n_cells: the columns that any cell covers."""
    return cells.groupBy(*keys, col).agg(F.count("*").alias("n_cells"))


def means(cells: DataFrame, keys: list[str], col: str, value: str) -> DataFrame:
    """keys, col_start, col_end, confidence: the mean over a segment's columns, of which it has a cell each."""
    length = F.max(col) - F.min(col) + 1
    return cells.groupBy(*keys).agg(F.min(col).alias("col_start"), F.max(col).alias("col_end"), (F.sum(value) / length).alias("confidence"))


def extents(alignments: DataFrame, keys: list[str]) -> DataFrame:
    """keys (with strand), target_start, target_end, query_start, query_end, members: on the reverse strand query coordinates fall."""
    reverse = F.col("strand") == "-"
    return alignments.groupBy(*keys).agg(
        F.min("target_start").alias("target_start"), F.max("target_end").alias("target_end"),
        F.when(reverse, F.max("query_start")).otherwise(F.min("query_start")).alias("query_start"),
        F.when(reverse, F.min("query_end")).otherwise(F.max("query_end")).alias("query_end"), F.count("*").alias("members"),
    )
