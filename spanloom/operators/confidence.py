"""From aligned codes to smoothed confidences as one plan of joins and windows, equal to what the kernel gives for a region.

No key grows with a region: letters and composition go by stretches of positions, scores and windows by alignment, the softmax by column. So a region is scored by as many tasks as
its rows ask for. Cells are made of arrays as late as can be: an alignment is dealt once, and its gaps, columns and consensus are worked where it lies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.alphabet import GAP_EXTEND, GAP_OPEN
from ..sources.readers import Matrix
from . import scores

LETTERS = 15  # codes of a matrix


def matrix_table(spark: SparkSession, matrices: dict[str, Matrix]) -> DataFrame:
    """matrix, opening, extension, table (by target and query code, row after row), core (of the four bases): one row for each matrix, all of which the driver has read."""
    rows = [(k, m.opening, m.extension, [x for r in m.scores for x in r], [x for r in m.core for x in r]) for k, m in matrices.items()]
    return spark.createDataFrame(rows, "matrix string, opening double, extension double, table array<double>, core array<double>")


def is_gap(c: str) -> Column:
    return (F.col(c) == GAP_OPEN) | (F.col(c) == GAP_EXTEND)


def columns(located: DataFrame, matrices: dict[str, Matrix]) -> DataFrame:
    """region_id, id, col, t, q, core, fixed, share, g: a row for each target column of each alignment. ``fixed`` is the matrix's score, ``core`` the ratio of a pair of bases (else null), ``share`` the
    column's part of a gap of the query, ``g`` the score of a gap of the target right before it."""
    keys = ["region_id", "id"]
    rows = located.select("region_id", F.col("ali_id").alias("id"), "target_start", "matrix", F.arrays_zip(F.col("target_codes").alias("t"), F.col("query_codes").alias("q")).alias("c"))
    # Alignments are dealt, not their characters, and a matrix is left behind before anything is sorted.
    chars = rows.repartition(*keys).select(*keys, "target_start", "matrix", F.posexplode("c").alias("i", "c"))
    chars = chars.select(*keys, "target_start", "matrix", F.col("i").cast("long").alias("i"), F.col("c.t").alias("t"), F.col("c.q").alias("q"))
    t, q = F.col("t").cast("int"), F.col("q").cast("int")
    core = F.when((t < 4) & (q < 4), F.get("core", t * 4 + q))
    chars = chars.join(F.broadcast(matrix_table(located.sparkSession, matrices)), "matrix").select(
        *keys, "target_start", "i", "t", is_gap("t").alias("over"), is_gap("q").alias("gap"), core.alias("core"), F.get("table", t * LETTERS + q).alias("fixed"), "opening", "extension"
    )
    opening, extension = F.col("opening"), F.col("extension")
    with_runs = scores.gap_runs(chars, keys, "i", "gap", opening, extension)
    kept = scores.target_gaps(with_runs, keys, "i", "over", opening, extension)
    col = F.col("target_start") + F.row_number().over(W.partitionBy(*keys).orderBy("i")) - 1
    return kept.select(*keys, col.cast("long").alias("col"), "t", "core", "fixed", "share", "g")


def scored(located: DataFrame, spans: DataFrame, matrices: dict[str, Matrix], width: int) -> DataFrame:
    """region_id, id, col, s, g: scores of columns against the composition around them."""
    letters = F.filter("target_codes", lambda c: (c != GAP_OPEN) & (c != GAP_EXTEND))
    rows = located.select("region_id", "target_start", letters.alias("codes"), F.struct("target_start", "query_id", "ali_id").alias("order"))
    around = scores.region_background(rows, spans, ["region_id"], "order", low="start", high="end", width=width).withColumnRenamed("pos", "col")
    share = F.get(F.array(*(F.col(f"bg_{b}") for b in "acgt")), F.col("t").cast("int"))
    plain = F.when(F.col("core").isNotNull(), scores.against(F.col("core"), share)).otherwise(F.col("fixed"))
    return columns(located, matrices).join(around, ["region_id", "col"]).select("region_id", "id", "col", (plain + F.col("share")).alias("s"), "g")


def region_spans(located: DataFrame, repeats: DataFrame | None) -> DataFrame:
    """region_id, start, end over all its alignments and repeats."""
    both = located.select("region_id", "target_start", "target_end")
    if repeats is not None:
        both = both.unionByName(repeats.select("region_id", "target_start", "target_end"))
    return both.groupBy("region_id").agg(F.min("target_start").alias("start"), F.max("target_end").alias("end"))


def confidences(located: DataFrame, matrices: dict[str, Matrix], settings: Settings, repeats: DataFrame | None = None) -> DataFrame:
    """region_id, kind, id, col, conf, smooth: of every column of an alignment ('ali') or a repeat ('rep') its share of the column's softmax, and the mean of those around it."""
    half = (settings.score_window - 1) // 2
    keys = ["region_id", "id"]
    s = scored(located, region_spans(located, repeats), matrices, settings.background_window)
    if settings.exact_window:
        around = W.partitionBy(*keys).orderBy("col").rowsBetween(-half, half)
        windows = s.select(*keys, "col", F.sum(F.col("s") + F.col("g")).over(around).alias("window"))
    else:
        windows = scores.windowed_scores(s, keys, "col", "s", "g", half)
    cells = windows.select("region_id", F.lit("ali").alias("kind"), "id", "col", F.col("window").alias("score"))
    if repeats is not None:
        r = repeats.select("region_id", F.col("repeat_id").alias("id"), "target_start", F.posexplode("scores").alias("i", "s"))
        r = r.select(*keys, (F.col("target_start") + F.col("i")).alias("col"), "s")
        found = scores.repeat_scores(r, keys, "col", "s", settings.score_window)
        cells = cells.unionByName(found.select("region_id", F.lit("rep").alias("kind"), "id", "col", F.col("window").alias("score")))
    shared = scores.softmax(cells, ["region_id", "col"])
    return scores.centred_mean(shared, ["region_id", "kind", "id"], "col", half=settings.half_mean).select("region_id", "kind", "id", "col", "conf", "smooth")


def skip_confidences(found: DataFrame, spans: DataFrame, settings: Settings) -> DataFrame:
    """region_id, col, skip: what the softmax leaves to the skip row at every column of a region, scaled. ``found``: of ``confidences``."""
    taken = found.groupBy("region_id", "col").agg(F.sum("conf").alias("taken"))
    every = spans.select("region_id", F.explode(F.sequence("start", "end")).alias("col"))
    return every.join(taken, ["region_id", "col"], "left").select("region_id", "col", ((1 - F.coalesce("taken", F.lit(0.0))) * scores.skip_adjust(settings.query_jump, settings.skip_loop)).alias("skip"))
