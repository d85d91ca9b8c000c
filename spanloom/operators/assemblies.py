"""What the grouped kernel does with assemblies a column at a time, as joins and aggregations over many regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scores import softmax


def copy_fill(owned: DataFrame, cells: DataFrame, skip: DataFrame, keys: list[str], col: str, owner: list[str], value: str = "conf") -> DataFrame:
    """``owned`` (keys, col, row, owner) with ``value``: that of the owner's cell in the column, and of the skip row where there is no owner or it has no cell. Both are looked up, each row once."""
    found = cells.select(*keys, col, *owner, F.col(value).alias("__own"))
    rest = skip.select(*keys, col, F.col("skip").alias("__rest"))
    return owned.join(found, [*keys, col, *owner], "left").join(rest, [*keys, col], "left").withColumn(value, F.coalesce("__own", "__rest")).drop("__own", "__rest")


def dealt(frame: DataFrame, low: str, high: str, stretch: int) -> DataFrame:
    """``frame`` with what each row's range has in the stretch (``__stretch``) that it is given to, as ``__low`` and ``__high``."""
    f = frame.withColumn("__stretch", F.explode(F.sequence(F.floor(F.col(low) / stretch), F.floor(F.col(high) / stretch))))
    return f.withColumns({"__low": F.greatest(low, F.col("__stretch") * stretch).cast("long"), "__high": F.least(high, F.col("__stretch") * stretch + (stretch - 1)).cast("long")})


def copy_fill_ranges(extents: DataFrame, members: DataFrame, score: Column, key: str, row: str, owner: str, own: list[str], stretch: int = 64) -> DataFrame:
    """``copy_fill`` of ranges whose cells are made where they lie, with one shuffle of ranges and none of cells: key, row, the columns ``own`` of ``extents`` (key, row, low, high), col, owner and conf. ``members`` (key, row,
    owner, low, high and what ``score`` needs beside ``col``) cover columns; of those of one row the smallest owner has a column, which gives its share of the column's softmax; without an owner it is the skip row's,
    and nothing where no member covers the column."""
    names = [c for c in members.columns if c not in (key, row, "low", "high")]
    side = lambda f: dealt(f, "low", "high", stretch).drop("low", "high")
    both = side(members).withColumn("__member", F.lit(True)).unionByName(side(extents).withColumn("__member", F.lit(False)), allowMissingColumns=True)
    f = both.repartition(key, "__stretch").select(key, row, "__stretch", "__member", *names, *own, F.explode(F.sequence("__low", "__high")).alias("col"))
    f = softmax(f.withColumn("__score", F.when(F.col("__member"), score)), [key, "__stretch", "col"], "__score")
    column = W.partitionBy(key, "__stretch", "col")
    first = F.min(F.when(F.col("__member"), F.struct(F.col(owner).alias("o"), F.col("conf").alias("c")))).over(W.partitionBy(key, "__stretch", "col", row))
    f = f.withColumn("__rest", 1 - F.sum("conf").over(column)).withColumn("__first", first).where(~F.col("__member"))
    return f.select(key, row, *own, "col", F.col("__first.o").alias(owner), F.coalesce("__first.c", "__rest").alias("conf"))


def best(frame: DataFrame, keys: list[str], score: str, row: str, last: bool = True) -> DataFrame:
    """keys, row, score: the row with the highest score; of equals the last one, or the first."""
    tie = F.col(row) if last else -F.col(row)
    top = F.max(F.struct(F.col(score).alias("s"), tie.alias("t"))).alias("m")
    out = frame.groupBy(*keys).agg(top)
    return out.select(*keys, (F.col("m.t") if last else -F.col("m.t")).alias(row), F.col("m.s").alias(score))


def member_means(means: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, members, mean: the mean of the members' means, each of which counts once however long it is."""
    return means.groupBy(*keys).agg(F.count("*").cast("long").alias("members"), F.avg(value).alias("mean"))


def met(members: DataFrame, trace: DataFrame, keys: list[str]) -> DataFrame:
    """keys, members: assemblies of several members that the trace has; the trace is looked up, never multiplied."""
    several = members.groupBy(*keys).agg(F.count("*").cast("long").alias("members")).where("members > 1")
    return several.join(trace.select(*keys), keys, "left_semi")


def first_seen(frame: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, values, sorted: the distinct values as they are first met, and ascending. One row for each value of a key is gathered."""
    seen = frame.groupBy(*keys, value).agg(F.min(order).alias("__at"))
    listed = F.array_sort(F.collect_list(F.struct("__at", F.col(value).alias("v"))))
    out = seen.groupBy(*keys).agg(F.transform(listed, lambda x: x["v"]).alias("values"))
    return out.withColumn("sorted", F.array_sort("values"))
