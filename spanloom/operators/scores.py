"""Score windows, background composition, confidences and score parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.alphabet import PAD

SKIP_SCORE = 10.0
BACKGROUND, SCORE_WINDOW, HALF_MEAN = 61, 31, 15
STRETCH, BITS = 3000, 15  # positions of a running sum; bits that one base's count takes
DEALT = 256  # positions of a stretch to which alignments are dealt


def ln(x: Column) -> Column:
    """Natural logarithm with minus infinity at zero."""
    return F.when(x <= 0, F.lit(float("-inf"))).otherwise(F.log(x))


def core_ratio(scaled: Column, frequency: Column | float) -> Column:
    """What a base's score says of its share: exp(scaled score) times the target letter's frequency."""
    return F.exp(scaled) * frequency


def against(core: Column, share: Column | float) -> Column:
    """The score of a core ratio against a background share; infinite against none."""
    return F.when(F.lit(share) == 0, F.lit(float("inf"))).otherwise(ln(F.try_divide(core, F.lit(share))))


def background(frame: DataFrame, keys: list[str], pos: str, code: str, width: int = BACKGROUND, stretch: int = STRETCH) -> DataFrame:
    """keys, pos and the shares bg_a, bg_c, bg_g, bg_t of a centred window; codes of 4 and over, and what the window has beyond
    the ends, count a quarter to each base. Positions follow each other without holes, one row for each.

    Counts are differences of running sums, in quarters, of which the four bases' stand side by side in one number. Sums run over stretches of positions with half a window more
    at both ends, so that no task sorts a whole sequence."""
    half, one = (width - 1) // 2, 1 << BITS
    if 4 * (stretch + 2 * half) >= one:
        raise ValueError("a stretch's counts do not fit")
    spread = F.sequence(F.floor((F.col(pos) - half) / stretch), F.floor((F.col(pos) + half) / stretch))
    return _composition(frame.select(*keys, pos, code, F.explode(spread).alias("__stretch")), keys, pos, code, width, stretch)


def _composition(frame: DataFrame, keys: list[str], pos: str, code: str, width: int, stretch: int) -> DataFrame:
    """``background`` of rows that are dealt to stretches, each with half a window more at both ends."""
    half, one = (width - 1) // 2, 1 << BITS
    own = F.floor(F.col(pos) / stretch)
    quarters = F.lit(sum(one**i for i in range(4)))
    for i in range(4):
        quarters = F.when(F.col(code) == i, F.lit(4 * one**i)).otherwise(quarters)
    order = W.partitionBy(*keys, "__stretch").orderBy(pos)
    f = frame.withColumn("__sum", F.sum(quarters).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    total = F.max("__sum").over(W.partitionBy(*keys, "__stretch"))
    inside = F.coalesce(F.lead("__sum", half).over(order), total) - F.coalesce(F.lag("__sum", half + 1).over(order), F.lit(0))
    f = f.withColumn("__in", inside).where(F.col("__stretch") == own)
    counts = [F.shiftright("__in", i * BITS).bitwiseAND(F.lit(one - 1)) for i in range(4)]
    missing = F.lit(4 * width) - (counts[0] + counts[1] + counts[2] + counts[3])
    return f.select(*keys, pos, *(((4 * c + missing) / F.lit(16.0 * width)).alias(f"bg_{b}") for b, c in zip("acgt", counts)))


def region_background(alignments: DataFrame, spans: DataFrame, keys: list[str], order: str, start: str = "target_start", codes: str = "codes", low: str = "region_start", high: str = "region_end", width: int = BACKGROUND,
                      stretch: int = DEALT) -> DataFrame:
    """``background`` of ``region_bases``, with one shuffle of alignments and none of their cells: what an alignment and a span have in a stretch and half a window around it is dealt there as an array, and cells are made,
    settled and counted where they lie. A stretch is short, as a pile of alignments over one is one task's."""
    half = (width - 1) // 2
    if 4 * (stretch + 2 * half) >= 1 << BITS:
        raise ValueError("a stretch's counts do not fit")
    of = F.col("__stretch")
    least = F.greatest(F.col("__from"), of * stretch - half)
    n = F.least(F.col("__to"), of * stretch + (stretch - 1 + half)) - least + 1
    own = lambda x: F.floor(x / stretch)
    first, last = own(F.col("__from") - half), own(F.col("__to") + half)
    if {low, high} <= set(alignments.columns):  # no further than the span's own stretches
        first, last = F.greatest(first, own(F.col(low))), F.least(last, own(F.col(high)))
    a = alignments.where(F.size(codes) > 0).withColumns({"__from": F.col(start).cast("long"), "__codes": F.col(codes).cast("array<tinyint>")}).withColumn("__to", F.col("__from") + F.size("__codes") - 1)
    a = a.where(first <= last).withColumn("__stretch", F.explode(F.sequence(first, last)))
    a = a.select(*keys, order, "__stretch", least.alias("__at"), F.slice("__codes", (least - F.col("__from") + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")).alias("__codes"), F.lit(False).alias("__span"))
    s = spans.select(*keys, F.col(low).cast("long").alias("__from"), F.col(high).cast("long").alias("__to"), F.explode(F.sequence(own(F.col(low)), own(F.col(high)))).alias("__stretch"))
    s = s.select(*keys, F.lit(None).cast(a.schema[order].dataType).alias(order), "__stretch", least.alias("__at"), F.array_repeat(F.lit(None).cast("tinyint"), n.cast("int")).alias("__codes"), F.lit(True).alias("__span"))
    f = a.unionByName(s).repartition(*keys, "__stretch").select(*keys, order, "__stretch", "__at", "__span", F.posexplode("__codes").alias("__i", "__code"))
    cells = f.groupBy(*keys, "__stretch", (F.col("__at") + F.col("__i")).alias("pos")).agg(F.max_by("__code", order).alias("code"), F.max("__span").alias("__span"))
    cells = cells.where("__span").withColumn("code", F.coalesce("code", F.lit(PAD)).cast("long"))
    return _composition(cells, keys, "pos", "code", width, stretch)


def region_bases(alignments: DataFrame, spans: DataFrame, keys: list[str], order: str, start: str = "target_start", codes: str = "codes", low: str = "region_start", high: str = "region_end") -> DataFrame:
    """keys, pos, code: a base for each position of each span. The last alignment that covers a position (by ``order``) gives it, and where there is none it is a pad.
    ``codes``: an alignment's target letters without gaps."""
    f = alignments.select(*keys, order, start, F.posexplode(codes).alias("__i", "__code"))
    seen = f.groupBy(*keys, (F.col(start) + F.col("__i")).alias("pos")).agg(F.max_by("__code", order).alias("code"))
    every = spans.select(*keys, F.explode(F.sequence(low, high)).alias("pos"))
    return every.join(seen, [*keys, "pos"], "left").withColumn("code", F.coalesce("code", F.lit(PAD)).cast("long"))


def windowed_scores(frame: DataFrame, keys: list[str], pos: str, s: str, g: str, half: int = HALF_MEAN) -> DataFrame:
    """keys, pos, window: the sliding sum of an alignment's scores by its literal rule. The first window has ``half`` columns; each step adds
    the column ``half`` ahead (column ``half`` itself is never added, at the end the last column is taken again or nothing), and evicts the
    score of the column that leaves, its gap score one step later. All from running sums."""
    order = W.partitionBy(*keys).orderBy(pos)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy(*keys)
    both = F.col(s) + F.col(g)
    f = (
        frame.withColumn("__i", F.row_number().over(order) - 1).withColumn("__n", F.count("*").over(whole))
        .withColumn("__both", F.sum(both).over(upto)).withColumn("__s", F.sum(s).over(upto)).withColumn("__g", F.sum(g).over(upto))
    )
    at = lambda c, k: F.coalesce(F.lag(c, k).over(order), F.lit(0))
    last = F.last("__both").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ahead = F.coalesce(F.lead("__both", half).over(order), last)  # running sum at min(n - 1, i + half)
    first = F.max(F.when(F.col("__i") <= half - 1, F.struct("__i", "__both"))).over(whole)["__both"]  # of the first half columns, or all
    till_half = F.max(F.when(F.col("__i") <= half, F.struct("__i", "__both"))).over(whole)["__both"]
    final = F.max(F.struct(F.col("__i"), both.alias("x"))).over(whole)["x"]
    g0 = F.first(F.col(g)).over(order)
    added = F.when(F.col("__n") - 1 > half, ahead - till_half).when(F.col("__n") - 1 == half, F.lit(0)).otherwise(final)
    gone_s = at("__s", half + 1)  # scores of columns before i - half
    gone_g = F.when(F.col("__i") - half >= 1, at("__g", half) - g0).otherwise(F.lit(0))
    moving = first + added - gone_s - gone_g
    return f.select(*keys, pos, F.when(F.col("__i") == 0, first).otherwise(moving).alias("window"))


def repeat_scores(frame: DataFrame, keys: list[str], pos: str, s: str, width: int = SCORE_WINDOW) -> DataFrame:
    """keys, pos, window: the sliding sum of a repeat's scores by its literal rule, over scores padded by ``half`` zeros: the first cell is 0,
    later ones add from one column further than the window reaches and evict from the first."""
    half = (width - 1) // 2
    order = W.partitionBy(*keys).orderBy(pos)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    f = frame.withColumn("__i", F.row_number().over(order) - 1).withColumn("__c", F.sum(s).over(upto))
    whole = W.partitionBy(*keys)
    total = F.max(F.struct("__i", "__c")).over(whole)["__c"]
    upto_of = lambda k: F.coalesce(F.max(F.when(F.col("__i") <= k, F.struct("__i", "__c"))).over(whole)["__c"], F.lit(0))
    first = upto_of(width - 1 - half)  # padded columns 0 .. width - 1 end with score width - 1 - half
    skipped = upto_of(width - half)  # the padded column number width is never added
    ahead = F.coalesce(F.lead("__c", width - half).over(order), total)
    added = F.greatest(F.least(F.col("__i") + width - half, F.count("*").over(whole) - 1), F.lit(0))
    more = F.when(added > width - half, ahead - skipped).otherwise(F.lit(0))
    gone = F.coalesce(F.lag("__c", half + 1).over(order), F.lit(0))
    return f.select(*keys, pos, F.when(F.col("__i") == 0, F.lit(0)).otherwise(first + more - gone).alias("window"))


def softmax(cells: DataFrame, keys: list[str], score: str = "score", skip: float = SKIP_SCORE) -> DataFrame:
    """``cells`` with ``conf``: base-2 softmax over the rows of a column and the skip row, which has a fixed score."""
    total = F.lit(2.0**skip) + F.sum(F.pow(F.lit(2.0), F.col(score))).over(W.partitionBy(*keys))
    return cells.withColumn("conf", F.pow(F.lit(2.0), F.col(score)) / total)


def centred_mean(cells: DataFrame, keys: list[str], pos: str, value: str = "conf", half: int = HALF_MEAN) -> DataFrame:
    """``cells`` with ``smooth``: mean over the row's own columns at most ``half`` away. (Running sums were slower than these short frames.)"""
    return cells.withColumn("smooth", F.avg(value).over(W.partitionBy(*keys).orderBy(pos).rowsBetween(-half, half)))


def by_alignment(cells: DataFrame, keys: list[str], value: str = "conf", pos: str | None = None) -> DataFrame:
    """keys, mean_conf, columns; with ``pos`` also ``vector``, the values in order of position."""
    vector = [] if pos is None else [F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v")))), lambda x: x["v"]).alias("vector")]
    return cells.groupBy(*keys).agg(F.avg(value).alias("mean_conf"), F.count("*").cast("long").alias("columns"), *vector)


def skip_adjust(jump: float, loop: float) -> float:
    return jump ** (1.0 / loop)


def score_params(n: Column, jump: float, loop: float) -> dict[str, Column]:
    """Transition scores of a region with ``n`` alignments; a region of repeats alone counts as one."""
    j = F.log(F.lit(jump) / F.greatest(n, F.lit(1)))
    return {"query_jump": j, "query_to_skip": j / 2 + j / loop, "query_loop": F.lit(0.0), "skip_loop": j / loop}


def gap_score(length: Column, opening: Column | float, extension: Column | float) -> Column:
    return F.lit(opening) + F.greatest(length - 1, F.lit(0)) * F.lit(extension)


def gap_runs(frame: DataFrame, keys: list[str], pos: str, gap: str, opening: Column | float, extension: Column | float) -> DataFrame:
    """``frame`` (all rows) with ``run`` (length of the row's run of gaps, 0 outside) and ``share`` (the run's score spread over its columns;
    a run that nothing follows is never charged)."""
    order = W.partitionBy(*keys).orderBy(pos)
    edge = F.when(F.col(gap) & ~F.coalesce(F.lag(gap).over(order), F.lit(False)), 1).when(~F.col(gap) & F.coalesce(F.lag(gap).over(order), F.lit(True)), 1).otherwise(0)
    f = frame.withColumn("__edge", edge).withColumn("__run", F.sum("__edge").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    own = W.partitionBy(*keys, "__run")
    f = f.withColumn("run", F.when(F.col(gap), F.count("*").over(own)).otherwise(F.lit(0)).cast("long"))
    closed = F.max(pos).over(own) < F.max(pos).over(W.partitionBy(*keys))
    return f.withColumn("share", F.when(F.col(gap) & closed, gap_score(F.col("run"), opening, extension) / F.col("run")).otherwise(F.lit(0.0))).drop("__edge", "__run")


def target_gaps(frame: DataFrame, keys: list[str], pos: str, gap: str, opening: Column | float, extension: Column | float) -> DataFrame:
    """The rows that are no gap of the target, with g: the score of the run of gaps right before, or 0; a run that nothing follows is lost.
    ``pos`` counts an alignment's characters without holes."""
    before = W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    last = F.max(F.when(~F.col(gap), F.col(pos))).over(before)
    first = F.min(pos).over(W.partitionBy(*keys).orderBy(pos).rowsBetween(W.unboundedPreceding, W.currentRow))
    run = F.col(pos) - F.coalesce(last, first - 1) - 1
    f = frame.withColumn("__run", run).where(~F.col(gap))
    return f.withColumn("g", F.when(F.col("__run") > 0, gap_score(F.col("__run"), opening, extension)).otherwise(F.lit(0.0))).drop("__run")
