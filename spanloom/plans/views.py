"""Star-schema and event tables seen as interval data, in Spark and as the same SQL.

``lineitem`` has no key, so rows are made distinct and numbered within their target; no view needs an order of the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORDER = ("target_start", "query_id", "strand", "target_end", "query_start", "query_end", "score")

SQL = {
    "raw_aln": """raw_aln AS (
  SELECT DISTINCT l_suppkey AS target_id, l_partkey % 20 + 1 AS query_id, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand,
         CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS target_start,
         CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + 1 + floor(l_quantity / 10) AS BIGINT) AS target_end,
         CAST(l_partkey % 97 + 1 AS BIGINT) AS low, CAST(l_partkey % 97 + 2 + floor(l_quantity / 10) AS BIGINT) AS high, CAST(l_quantity AS BIGINT) AS score FROM lineitem
)""",
    "aln": """aln AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY target_start, query_id, strand, target_end, query_start, query_end, score) AS ord FROM (
    SELECT target_id, query_id, strand, target_start, target_end, CASE WHEN strand = '-' THEN high ELSE low END AS query_start,
           CASE WHEN strand = '-' THEN low ELSE high END AS query_end, score FROM raw_aln)
)""",
    "cells": """cells AS (
  SELECT target_id, ord, query_id, score, unnest(range(target_start, target_end + 1)) AS col FROM aln
)""",
    "scored": """scored AS (
  SELECT target_id, ord, query_id, col, CAST(score AS DOUBLE) / 10 + ((col * 7 + ord * 3) % 11) / 10.0::DOUBLE AS score FROM cells
)""",
    "confident": """confident AS (
  SELECT target_id, ord, query_id, col, power(2.0::DOUBLE, score) / (1024.0 + sum(power(2.0::DOUBLE, score)) OVER (PARTITION BY target_id, col)) AS conf FROM scored
)""",
    "positions": """positions AS (
  SELECT vec_id, CAST(i AS BIGINT) AS pos, CAST(floor(1000 * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS s,
         CASE WHEN (vec_id + i) % 5 = 0 THEN -((vec_id + i) % 3) - 1 ELSE 0 END AS g
  FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)
)""",
    "bases": """bases AS (
  SELECT doc_id, CAST(i AS BIGINT) AS pos, strpos('ACGT', letters[i + 1]) - 1 AS code FROM (
    SELECT doc_id, letters, unnest(range(len(letters))) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(translate(text, 'acgt', 'ACGT'), '[^ACGT]', '', 'g'), '') AS letters FROM documents) WHERE len(letters) > 0 AND letters[1] <> '')
)""",
    "trace": """trace AS (
  SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) // 5 AS step,
         CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_id FROM events
)""",
    "bed": """bed AS (
  SELECT o_orderkey, o_custkey % 50 AS chrom, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS chrom_start,
         CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) + 3 + floor(o_totalprice / 50000) AS BIGINT) AS chrom_end FROM orders
)""",
}
SQL["rep"] = """rep AS (
  SELECT event_id AS repeat_id, user_id % 100 + 1 AS target_id, CAST(date_diff('day', DATE '1992-01-01', CAST(ts AS DATE)) AS BIGINT) AS target_start,
         CAST(date_diff('day', DATE '1992-01-01', CAST(ts AS DATE)) AS BIGINT) + 3 AS target_end, length(event_type) AS period FROM events
)"""
SQL["spread"] = """spread AS (
  SELECT repeat_id, target_id, repeat_id * 37 % 2500 AS target_start, repeat_id * 37 % 2500 + 3 AS target_end, period FROM rep
)"""
SQL["noted"] = """noted AS (
  SELECT target_id AS region_id, query_id * 2 + CAST(strand = '-' AS BIGINT) AS join_id, CAST(target_id AS VARCHAR) AS target_name, 'q' || CAST(query_id AS VARCHAR) AS query_name,
         strand, target_start, target_end, query_start, query_end, score / 64.0::DOUBLE AS confidence FROM aln
)"""
NEEDS = {"spread": ("rep",), "noted": ("aln",), "aln": ("raw_aln",), "cells": ("aln",), "scored": ("cells",), "confident": ("scored",)}


def sql(*names: str) -> str:
    """A WITH clause of the views named and of those that they need."""
    out: list[str] = []

    def put(n: str) -> None:
        for x in NEEDS.get(n, ()):
            put(x)
        if n not in out:
            out.append(n)

    for n in names:
        put(n)
    return "WITH " + ", ".join(SQL[n] for n in out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def days(c: str):  # noqa: ANN201
    return F.datediff(F.to_date(c), F.lit("1992-01-01").cast("date")).cast("long")


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, ord, query_id, strand, target_start, target_end, query_start, query_end, score. Query coordinates fall on the reverse strand."""
    span = F.floor(F.col("l_quantity") / 10).cast("long")
    start, low = days("l_shipdate"), (F.col("l_partkey") % 97 + 1).cast("long")
    reverse = F.col("strand") == "-"
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("target_id"), (F.col("l_partkey") % 20 + 1).alias("query_id"),
        F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), start.alias("target_start"), (start + 1 + span).alias("target_end"),
        low.alias("low"), (low + 1 + span).alias("high"), F.col("l_quantity").cast("long").alias("score"),
    ).distinct()
    turned = raw.select(
        "target_id", "query_id", "strand", "target_start", "target_end", F.when(reverse, F.col("high")).otherwise(F.col("low")).alias("query_start"),
        F.when(reverse, F.col("low")).otherwise(F.col("high")).alias("query_end"), "score",
    )
    return turned.withColumn("ord", F.row_number().over(W.partitionBy("target_id").orderBy(*ORDER)).cast("long"))


def cells(alignments: DataFrame) -> DataFrame:
    """A row for each column that an alignment covers."""
    return alignments.select("target_id", "ord", "query_id", "score", F.explode(F.sequence("target_start", "target_end")).alias("col"))


def wave() -> Column:
    """A cell's score, which changes along the alignment."""
    return F.col("score").cast("double") / 10 + ((F.col("col") * 7 + F.col("ord") * 3) % 11) / F.lit(10.0)


def waved(frame: DataFrame) -> DataFrame:
    """Cells with a score that changes along the alignment."""
    return frame.select("target_id", "ord", "query_id", "col", wave().alias("score"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waved(cells(aln(spark, sf_dir)))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integer scores and gap scores along each vector."""
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    at = F.col("vec_id") + F.col("pos")
    return p.select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.floor(1000 * F.col("x").cast("double")).cast("long").alias("s"),
        F.when(at % 5 == 0, -(at % 3) - 1).otherwise(F.lit(0)).cast("long").alias("g"),
    )


def bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters A, C, G, T of each text as codes 0 to 3."""
    letters = F.regexp_replace(F.translate("text", "acgt", "ACGT"), "[^ACGT]", "")
    d = table(spark, sf_dir, "documents").select("doc_id", letters.alias("letters")).where(F.length("letters") > 0)
    p = d.select("doc_id", F.posexplode(F.split("letters", "")).alias("pos", "base"))
    return p.select("doc_id", F.col("pos").cast("long").alias("pos"), (F.instr(F.lit("ACGT"), F.col("base")) - 1).cast("long").alias("code"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user in order; the event type plays the row that owns a column, and every sixth column has none."""
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    step = (nth + F.floor(nth / 5)).cast("long")
    return table(spark, sf_dir, "events").select("user_id", "event_type", step.alias("step"), F.floor(F.unix_timestamp("ts") / 3600).cast("long").alias("hour"), "event_id")


def bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = days("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 50).alias("chrom"), start.alias("chrom_start"), (start + 3 + F.floor(F.col("o_totalprice") / 50000)).cast("long").alias("chrom_end"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repeat_id, target_id, target_start, target_end, period: events play tandem repeats of four positions."""
    start = days("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("repeat_id"), (F.col("user_id") % 100 + 1).alias("target_id"), start.alias("target_start"), (start + 3).alias("target_end"), F.length("event_type").cast("long").alias("period")
    )


def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same repeats over the days that alignments have."""
    start = F.col("repeat_id") * 37 % 2500
    return repeats(spark, sf_dir).withColumns({"target_start": start, "target_end": start + 3})


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments play annotations: a target is a region, and what it has of one query and strand is one join."""
    return aln(spark, sf_dir).select(
        F.col("target_id").alias("region_id"), (F.col("query_id") * 2 + (F.col("strand") == "-").cast("long")).alias("join_id"), F.col("target_id").cast("string").alias("target_name"),
        F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query_name"), "strand", "target_start", "target_end", "query_start", "query_end", (F.col("score") / 64.0).alias("confidence"),
    )
