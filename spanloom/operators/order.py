"""Running totals and numbers over a whole table without one task for all rows.

An order of whole numbers is cut in ranges of ``RANGE``. Totals are summed within a range, and those of the ranges before within a range of ranges, so no task sorts more than ``RANGE`` keys; orders reach to ``RANGE``
squared, and a larger one raises an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGE = 1 << 20


def totals_before(frame: DataFrame, order: str, value: Column | None = None, ties: tuple[str, ...] = (), name: str = "before", width: int = RANGE) -> DataFrame:
    """``frame`` with the sum of ``value`` (one, if none is given) of all rows before it in the order, a column of whole numbers from 0 that has one row or few for each value."""
    v = F.lit(1) if value is None else value
    own = F.floor(F.col(order) / width)
    f = frame.withColumns({"__v": v.cast("long"), "__range": F.when((own < 0) | (own >= width), F.raise_error(F.lit("an order beyond the ranges"))).otherwise(own).cast("long")})
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    per = f.groupBy("__range").agg(F.sum("__v").alias("__k"))
    base = per.select("__range", F.coalesce(F.sum("__k").over(upto(W.partitionBy(F.floor(F.col("__range") / width)).orderBy("__range"))), F.lit(0)).alias("__base"))
    within = F.coalesce(F.sum("__v").over(upto(W.partitionBy("__range").orderBy(order, *ties))), F.lit(0))
    return f.withColumn("__within", within).join(base, "__range").withColumn(name, (F.col("__base") + F.col("__within")).cast("long")).drop("__v", "__range", "__base", "__within")
