"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source expects ``target / source size`` copies. The documents of a source are laid in
order of size; the prefix sums of their expected copies, moved by one random offset per source, cross some
integers, and each crossing is one copy. Neighbours in that order have nearly the same size, so the words
taken stay within about one document of the target.

The prefix sums need no ordered pass over a whole source: documents are counted per (source, size, salt),
the counts are summed before the place of each such bin, and only the rank inside a bin is taken from rows.
A source with a third of all rows so spreads over its sizes, and one size over ``SALTS`` bins.

Defined results: a null text has size 0; sources are ordered by code point with null last (null is a source
of its own); a repeated row is a document of its own; a source without words has target 0 and takes 0;
columns other than id, text and source have no part in ``mix``, and ``repeat_rows`` keeps them whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, store

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 256  # two hex digits


def hex_number(text: Column, digits: int) -> Column:
    """The first hex digits of the text's MD5 as a number, alike in every engine."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size) -> also ``target``: water is poured over the sources by weight, and what is above ``most``
    times a source's size flows to the others. In order of size by weight, the full sources come first, so
    prefix sums give the level that is left to the rest. One row per source is all that is sorted here."""
    ordered = sizes.withColumn("rn", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    full = F.col("source_size").cast("double") * most
    by_level = W.orderBy(F.col("full") / F.col("weight"), "rn")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = (
        ordered.withColumn("weight", weight.cast("double")).withColumn("full", full)
        .withColumn("water", F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
        .withColumn("share", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("place", F.row_number().over(by_level))
        .withColumn("open", F.col("full") * F.col("share") > F.col("weight") * F.col("water"))
    )
    first = F.min(F.when(F.col("open"), F.struct("place", "water", "share"))).over(every)
    return left.withColumn("first", first).select(
        "source", "source_size",
        F.when(F.col("open"), F.col("weight") * F.col("first.water") / F.col("first.share")).otherwise(F.col("full")).alias("target"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", *,
        weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row for each row of ``docs``."""
    slim = store(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
        .withColumn("salt", hex_number(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 2)),
        "mix",
    )
    bins = slim.groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    by_size = bins.groupBy("source", "size").agg(F.sum("n").alias("n"))
    aims = targets(by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, most)
    sized = by_size.withColumn(
        "before_size", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    salted = bins.withColumn(
        "before_salt", F.coalesce(F.sum("n").over(W.partitionBy("source", "size").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).drop("n")
    ranked = slim.withColumn("in_bin", F.row_number().over(W.partitionBy("source", "size", "salt").orderBy("doc_id")))
    a, b, c, d = ranked.alias("a"), salted.alias("b"), sized.alias("c"), aims.alias("d")

    def same(x: str, y: str, *names: str) -> Column:
        on = F.col(f"{x}.{names[0]}").eqNullSafe(F.col(f"{y}.{names[0]}"))
        for n in names[1:]:
            on &= F.col(f"{x}.{n}") == F.col(f"{y}.{n}")
        return on

    laid = (
        a.join(b, same("a", "b", "source", "size", "salt")).join(c, same("a", "c", "source", "size")).join(d, same("a", "d", "source"))
        .select("a.doc_id", "a.source", "a.size", "d.source_size", "d.target", (F.col("before_size") + F.col("before_salt") + F.col("in_bin")).alias("k"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = hex_number(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit(""))), 8) / F.lit(4294967296.0)
    crossed = F.floor(F.col("k") * rate + offset) - F.floor((F.col("k") - 1) * rate + offset)
    return laid.withColumn("copies", F.least(crossed, F.lit(most)).cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("k")


def repeat_rows(docs: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies. Rows are matched by id, source and size;
    where several rows agree in all three, their copies are shared out among them in one run, which keeps the sum."""
    key = [F.col("doc_id"), F.col("source"), F.col("size")]
    copies, rows, size, times, nth, copy = fresh(docs.columns, "copies__", "rows__", "size__", "times__", "nth__", "copy__")
    total = mixed.groupBy(*key).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0)
    left = docs.withColumn(size, word_count(F.col(text)))
    on = F.col(f"l__.{doc_id}").eqNullSafe(F.col("r__.doc_id")) & F.col(f"l__.{source}").eqNullSafe(F.col("r__.source")) & (F.col(f"l__.{size}") == F.col("r__.size"))
    joined = left.alias("l__").join(total.alias("r__"), on).select("l__.*", copies, rows)
    one = joined.where(F.col(rows) == 1).withColumn(times, F.col(copies))
    place = F.row_number().over(W.partitionBy(doc_id, source, size).orderBy(F.xxhash64(text)))
    many = joined.where(F.col(rows) > 1).withColumn(nth, place).withColumn(
        times, F.floor(F.col(nth) * F.col(copies) / F.col(rows)) - F.floor((F.col(nth) - 1) * F.col(copies) / F.col(rows))
    ).drop(nth)
    both = one.unionByName(many).where(F.col(times) > 0)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*docs.columns)
