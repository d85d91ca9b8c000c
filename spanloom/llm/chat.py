"""Chat formatting by quotation linking. DataFrame functions only.

A line's quote level is the number of ``>`` marks that it begins with. A passage is a run of lines of one level
without an empty line between them; its text without marks, with white space squeezed and letters lower-cased, is hashed. Passages of
level 0 are a message's own; its single own lines count as passages as well. A quoted passage is linked to the first message of its conversation that has the
passage as its own, if that comes before the quoting message. An excerpt, a quoted passage of several lines that no earlier message has as a whole,
is linked through its lines: each has a first owner, and the latest of those before the quoting message is taken, as no earlier one can hold all of the lines.

A message replies to the latest of the messages that its outermost linked quotes come from; without a linked quote it
replies to the turn before. A message that replies to another than the turn before begins a thread, as does the first turn;
the others go on with the thread of the turn before. A conversation is laid out thread by thread, so that a reply never comes before what it quotes, and
``reply_to`` names the message that a thread hangs on. Bodies keep own lines only. A row of ``conversations`` is a part of a thread of at most ``PART`` turns.

A text's lines are worked in one pass. The join of passages is by conversation and hash, on the first owner alone, which is an aggregation: a line
that all messages have meets one row, not all. Turns are numbered in stretches of ``SPAN`` turn numbers, and the stretches' sums are summed, so that
no task sorts a whole conversation.

Defined results: a null text has an empty body and no quotes; a null role is a user's; rows with a null conversation or turn are kept, each a part of its own, never linked;
rows that agree in conversation, turn, role and body are one message, other rows of one turn are messages in order of role and body, and share the links of all; a turn
with more than ``PART`` rows is dealt to several parts (``share``) by a hash; turns are whole numbers; columns other than the four named have no part;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import store

MARKS = r"^[ \t]*(?:>[ \t]?)+"
QUOTES = r"(?m)^[ \t]*>"
BLANKS = r"[\x01\x02\x09-\x0D\x20]+"
SPAN, PART = 4096, 64


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), BLANKS, " "))


def lines(text: Column) -> Column:
    return F.split(text, "\r?\n")


def passages(text: Column) -> Column:
    """array<struct<level, body>> of a text's passages, in order; a body's lines are kept apart by line breaks. Each line is put
    behind a mark (it begins a passage) or a line break (it goes on), and the whole is split at the marks."""
    now = F.transform(lines(text), lambda x: F.struct(level(x).alias("level"), bare(x).alias("body")))
    before = F.concat(F.array(F.lit(None).cast("struct<level:int,body:string>")), now)

    def put(z: Column) -> Column:
        c, p = z["c"], z["p"]
        goes_on = (p["body"] != "") & (p["level"] == c["level"])
        return (
            F.when(F.coalesce(c["body"], F.lit("")) == "", "").when(goes_on, F.concat(F.lit("\n"), c["body"]))
            .otherwise(F.concat(F.lit("\x01"), c["level"].cast("string"), F.lit("\x02"), c["body"]))
        )

    marked = F.array_join(F.transform(F.arrays_zip(now.alias("c"), before.alias("p")), put), "")
    kept = F.filter(F.split(marked, "\x01"), lambda x: x != "")
    return F.transform(kept, lambda x: F.struct(F.substring_index(x, "\x02", 1).cast("int").alias("level"), F.substring_index(x, "\x02", -1).alias("body")))


def one_line(body: Column) -> Column:
    return F.translate(body, "\n", " ")


def own_lines(text: Column) -> Column:
    return F.filter(lines(text), lambda x: ~x.rlike(MARKS))


def own_body(text: Column) -> Column:
    """The lines that are not quoted, without empty lines at either end."""
    kept = F.when(text.rlike(QUOTES), F.array_join(own_lines(text), "\n")).otherwise(F.regexp_replace(text, "\r\n", "\n"))
    return F.rtrim(F.regexp_replace(F.coalesce(kept, F.lit("")), r"^[\x09-\x0D\x20]*\n", ""), F.lit("\t\n\x0b\f\r "))


def replies(rows: DataFrame) -> DataFrame:
    """conv_id, turn, n_quotes, n_linked, quoted (the turn that is replied to, if any quote is linked) of all turns with quotes."""
    quoting = rows.where(F.col("text").rlike(QUOTES)).select("conv_id", "turn", F.explode(passages(F.col("text"))).alias("p")).where("p.level > 0")
    # What is looked up: the passage, then each of its lines, if there are several.
    several = F.when(F.contains("p.body", F.lit("\n")), F.array_distinct(F.split("p.body", "\n"))).otherwise(F.array().cast("array<string>"))
    sought = F.transform(F.concat(F.array(one_line(F.col("p.body"))), several), lambda x, i: F.struct((i == 0).alias("whole"), F.xxhash64(x).alias("hash"), F.md5(x).alias("sum")))
    quoted = store(quoting.select("conv_id", "turn", F.col("p.level").alias("level"), F.monotonically_increasing_id().alias("quote"), sought.alias("sought")), "quoted")
    # Only conversations that quote at all can be linked.
    asked = quoted.select("conv_id").distinct()
    own = F.transform(F.filter(passages(F.col("text")), lambda p: p["level"] == 0), lambda p: one_line(p["body"]))
    single = F.filter(F.transform(own_lines(F.col("text")), bare), lambda x: x != "")
    owned = rows.join(asked, "conv_id", "left_semi").select("conv_id", "turn", F.explode(F.array_distinct(F.concat(own, single))).alias("body"))
    owners = owned.groupBy("conv_id", F.xxhash64("body").alias("hash"), F.md5("body").alias("sum")).agg(F.min("turn").alias("owner"))
    found = quoted.select("conv_id", "turn", "level", "quote", F.inline("sought")).join(owners, ["conv_id", "hash", "sum"], "left").withColumn("owner", F.when(F.col("owner") < F.col("turn"), F.col("owner")))
    linked = found.groupBy("conv_id", "turn", "level", "quote").agg(F.coalesce(F.max(F.when(F.col("whole"), F.col("owner"))), F.max("owner")).alias("owner"))
    known = F.col("owner").isNotNull()
    return linked.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n_quotes"), F.sum(known.cast("long")).alias("n_linked"),
        F.min(F.when(known, F.struct(F.col("level").alias("level"), (-F.col("owner")).alias("late")))).alias("reply"),
    ).select("conv_id", "turn", "n_quotes", "n_linked", (-F.col("reply.late")).alias("quoted"))


def places(turns: DataFrame, span: int = SPAN) -> DataFrame:
    """``turns`` (conv_id, turn, quoted, ...; one row for each) with reply_to, thread (its first turn) and place (from 0 within the thread)."""
    stretch = ["conv_id", "stretch"]
    within = W.partitionBy(*stretch).orderBy("turn")
    upto = within.rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("conv_id").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)
    t = turns.withColumn("stretch", F.floor(F.col("turn") / span))
    ends = t.groupBy(*stretch).agg(F.max("turn").alias("end"))
    ends = ends.select(*stretch, F.max("end").over(earlier).alias("end_before"))
    t = t.join(ends, stretch).withColumn("before", F.coalesce(F.lag("turn").over(within), F.col("end_before"))).drop("end_before")
    begins = F.col("before").isNull() | F.coalesce(F.col("quoted") != F.col("before"), F.lit(False))
    t = store(t.withColumn("own", F.row_number().over(within)).withColumn("begins", begins), "turns")
    first = F.when(F.col("begins"), F.struct(F.col("turn").alias("thread"), F.col("own").cast("long").alias("at")))
    sums = t.groupBy(*stretch).agg(F.count("*").alias("n"), F.max(first).alias("last")).withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    sums = sums.withColumn("last", F.when(F.col("last").isNotNull(), F.struct(F.col("last.thread").alias("thread"), (F.col("last.at") + F.col("base")).alias("at"))))
    sums = sums.select(*stretch, "base", F.max("last").over(earlier).alias("last_before"))
    t = t.join(sums, stretch).withColumn("at", F.col("own") + F.col("base")).withColumn("first", F.when(F.col("begins"), F.struct(F.col("turn").alias("thread"), "at")))
    t = t.withColumn("first", F.coalesce(F.max("first").over(upto), F.col("last_before")))
    out = t.withColumn("reply_to", F.coalesce("quoted", "before")).withColumn("thread", F.col("first.thread")).withColumn("place", (F.col("at") - F.col("first.at")).cast("long"))
    return out.select(*turns.columns, "reply_to", "thread", "place")


def conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", *, part: int = PART, span: int = SPAN) -> DataFrame:
    """conv_id, thread, part, share, reply_to, first_turn, last_turn, n_messages, n_quotes, n_linked, text: one row for each part of a thread."""
    base = messages.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = base.where(whole)
    counted = rows.groupBy("conv_id", "turn").agg(F.count("*").alias("rows"))
    known = counted.join(replies(rows.where("text is not null")), ["conv_id", "turn"], "left")
    known = known.withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("n_quotes", "n_linked")})
    own = W.partitionBy("conv_id", "thread", "part")  # at most ``part`` turns
    laid = places(known, span).withColumn("part", F.floor(F.col("place") / part)).select(
        "conv_id", "turn", "thread", "part", F.ceil(F.col("rows") / part).alias("shares"),
        F.struct(
            F.min(F.struct("turn", "reply_to")).over(own)["reply_to"].alias("reply_to"), F.min("turn").over(own).alias("first_turn"), F.max("turn").over(own).alias("last_turn"),
            F.sum("n_quotes").over(own).alias("n_quotes"), F.sum("n_linked").over(own).alias("n_linked"),
        ).alias("about"),
    )
    body, says = own_body(F.col("text")), F.coalesce("role", F.lit("user"))
    joined = rows.select("conv_id", "turn", says.alias("role"), body.alias("body")).join(laid, ["conv_id", "turn"])
    share = F.pmod(F.xxhash64("role", "body"), F.col("shares"))
    parts = joined.groupBy("conv_id", "thread", "part", share.alias("share")).agg(F.max("about").alias("about"), F.array_sort(F.collect_set(F.struct("turn", "role", "body"))).alias("said"))
    written = lambda role, body: F.concat(F.lit("<|"), role, F.lit("|>\n"), body, F.lit("\n<|end|>\n"))
    out = parts.select(
        "conv_id", "thread", "part", "share", *(f"about.{n}" for n in ("reply_to", "first_turn", "last_turn")), F.size("said").cast("long").alias("n_messages"), "about.n_quotes", "about.n_linked",
        F.array_join(F.transform("said", lambda x: written(x["role"], x["body"])), "").alias("text"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast(base.schema["turn"].dataType)
    alone = base.where(~whole).select(
        "conv_id", none.alias("thread"), zero.alias("part"), zero.alias("share"), none.alias("reply_to"), F.col("turn").alias("first_turn"), F.col("turn").alias("last_turn"), F.lit(1).cast("long").alias("n_messages"),
        zero.alias("n_quotes"), zero.alias("n_linked"), written(says, body).alias("text"),
    )
    return out.unionByName(alone)
