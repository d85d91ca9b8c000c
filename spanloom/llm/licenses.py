"""License scans: exact set-similarity join of text blocks with license templates. DataFrame functions only.

A block is a line of a text, its words are taken as a set. A block meets a template if it holds at least
``threshold`` of the template's distinct words. Words of templates are ordered by how often the corpus has
them, rarest first; a block that shares ``need = ceil(threshold * |template|)`` words with a template holds at
least one of the template's first ``|template| - need + 1`` words in that order (prefix filter). The blocks
with a prefix word are joined to the templates by that word; a pair goes on only from its first common prefix
word, if the block is long enough (length filter) and if that word's places in both ordered lists leave enough
words to come (positional filter); then the overlap is counted. Nothing is missed.

With ``windows`` a block is instead any run of ``len(template) / threshold`` consecutive words of a text, whatever its line breaks: wrapped
headers count as a whole, and words scattered over a long line do not. Texts are cut into pieces of twice the longest window, each beginning one
window behind the one before, so that every window lies in a piece; pieces without a prefix word go, and pieces go
through the same join before their windows are counted.

The base search is apart: places where a phrase's words stand consecutively.

A text is read twice: to count the template words, and to cut out base places and the few blocks that hold a
prefix word. Joins move only those blocks. A template list is fixed and small, so that its side is broadcast.

Defined results: a null text is empty: no words, null places, empty labels, score 0; repeated rows get the same
result each; a null id is kept and is its own key; ties have no part, as labels are sets; an empty table gives
an empty result; without ``windows`` a text without line breaks is one block, whatever its length; columns other than id and text have no part.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import store

LOWER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # words
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # what stands between them, before A-Z are lower-cased
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# What a block must hold to get a label.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "released under the mit license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "all rights reserved"),
)
THRESHOLD = 0.8


def lowered(text: Column) -> Column:
    """A-Z alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def one_of(words: list[str]) -> str:
    """A pattern for any of these as a whole word, in any case."""
    edge = r"0-9A-Za-z\x{80}-\x{10FFFF}"
    return f"(?<![{edge}])(?i:{'|'.join(sorted(map(re.escape, words), key=lambda w: (-len(w), w)))})(?![{edge}])"


def places(words: Column, phrase: str) -> Column:
    """Every index of ``words`` at which the phrase begins."""
    parts = phrase.split(" ")

    def begins(i: Column) -> Column:
        at = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            at &= F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return at

    return F.when(F.size(words) >= len(parts), F.filter(F.sequence(F.lit(0), F.size(words) - 1), begins)).otherwise(F.array().cast("array<int>"))


def word_order(docs: DataFrame, text: str, templates: tuple[tuple[str, str], ...]) -> list[str]:
    """All words of the templates, those that the corpus has least of first. Its length is the templates', not the corpus's."""
    vocabulary = sorted({w for _, t in templates for w in t.split(" ")})
    found = F.regexp_extract_all(F.col(text), F.lit(f"({one_of(vocabulary)})"), F.lit(1))
    counts = docs.select(F.explode(found).alias("w")).groupBy(lowered(F.col("w")).alias("w")).count()
    seen = {r["w"]: r["count"] for r in counts.where(F.col("w").isin(vocabulary)).collect()}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def width(template: str, threshold: float = THRESHOLD) -> int:
    """Words of a window: so many that a window with nothing but the template's words may have a fifth of others between them."""
    return int(len(template.split(" ")) / threshold + 1e-9)


def cut(words: Column, wide: int) -> Column:
    """Words in pieces of twice ``wide``, each as one string; every ``wide`` consecutive words lie in one of them. ``words`` is a column
    of a table: a longer expression would be worked again for each piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - wide, F.lit(1)), F.lit(wide))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, 2 * wide), " "))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, base: tuple[tuple[str, str], ...] = BASE,
         templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row for each row of ``docs``.
    score: the largest share of a template's words that a block meeting it holds."""
    spark = docs.sparkSession
    rank = {w: i for i, w in enumerate(word_order(docs, text, templates))}
    sets = [(label, sorted({*t.split(" ")}, key=rank.__getitem__)) for label, t in templates]
    need = [math.ceil(threshold * len(ws) - 1e-9) for _, ws in sets]
    prefixes = [ws[: len(ws) - n + 1] for (_, ws), n in zip(sets, need)]
    one = one_of(sorted({w for p in prefixes for w in p}))
    widths = [width(t, threshold) for _, t in templates]
    index = spark.createDataFrame(
        [(w, label, ws, i, len(ws), n, wide) for (label, ws), n, p, wide in zip(sets, need, prefixes, widths) for i, w in enumerate(p)],
        "word string, label string, template array<string>, place int, size int, need int, width int",
    )

    body = F.coalesce(F.col(text), F.lit(""))
    ends = sorted({p.rpartition(" ")[2] for p, _ in base})
    has = F.expr("false")
    for w in ends:
        has |= F.contains(F.lower(F.col("body")), F.lit(w))
    read = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body")).withColumn("hit", F.col("body").rlike(one))
    first = read.select(
        "doc_id", "hit",
        F.xxhash64("body").alias("key"),
        F.size(F.array_remove(F.split("body", BETWEEN), "")).cast("long").alias("n_words"),
        F.when(has | (F.col("hit") & windows), words_of(F.col("body"))).otherwise(F.array().cast("array<string>")).alias("words"),
        *([] if windows else [F.split("body", "\n").alias("lines")]),
    )
    pieces = cut(F.col("words"), max(widths)) if windows else F.col("lines")
    blocks = F.when(F.col("hit"), F.filter(pieces, lambda x: x.rlike(one))).alias("blocks")
    slim = store(
        first.select("doc_id", "key", "n_words", blocks, *(places(F.col("words"), p).alias(f"at{i}") for i, (p, _) in enumerate(base))),
        "licenses",
    )
    all_places = F.concat(*(F.col(f"at{i}") for i in range(len(base))))
    labels = F.array_compact(F.array(*(F.when(F.size(f"at{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(base))))
    found = slim.select(
        "doc_id", "key", "n_words", F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"), F.array_max(all_places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_list"),
    )

    order = F.create_map(*(F.lit(x) for w, i in rank.items() for x in (w, i)))
    distinct = slim.where(F.col("blocks").isNotNull()).select("doc_id", "key", F.explode("blocks").alias("block"))
    # A block that many texts share is judged once.
    judged = distinct.select(F.xxhash64("block").alias("bkey"), "block").groupBy("bkey", "block").agg(F.lit(1).alias("one")).drop("one")
    parted = judged.select("bkey", "block", F.array_distinct(words_of(F.col("block"))).alias("all")).select(
        "bkey", "block", F.size("all").alias("n"),
        F.array_sort(F.filter(F.transform("all", lambda w: F.struct(F.element_at(order, w).alias("r"), w.alias("w"))), lambda s: s["r"].isNotNull())).alias("own"),
    )
    candidates = parted.select("bkey", "block", "n", F.posexplode("own").alias("at", "x"), "own").join(
        F.broadcast(index), F.col("x.w") == F.col("word")
    ).where(
        (F.col("n") >= F.col("need"))
        & (F.least(F.size("own") - F.col("at"), F.col("size") - F.col("place")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect(F.transform("own", lambda s: s["w"]), F.col("template")))
    if windows:
        in_order = F.split("block", " ")
        starts = F.sequence(F.lit(1), F.greatest(F.size(in_order) - F.col("width") + 1, F.lit(1)))
        counts = F.transform(starts, lambda i: F.size(F.array_intersect(F.slice(in_order, i, F.col("width")), F.col("template"))))
        shared = F.when(shared >= F.col("need"), F.array_max(counts)).otherwise(0)
    met = candidates.withColumn("shared", shared).where("shared >= need").groupBy("bkey", "block").agg(
        F.collect_set("label").alias("method"), F.max(F.col("shared") / F.col("size")).alias("share")
    )
    by_text = (
        distinct.select("doc_id", "key", F.xxhash64("block").alias("bkey"), "block").join(met, ["bkey", "block"])
        .select("doc_id", "key", F.explode("method").alias("label"), "share")
        .groupBy("doc_id", "key").agg(F.collect_set("label").alias("method"), F.max("share").alias("share"))
    )
    f, m = found.alias("f"), by_text.alias("m")
    both = f.join(m, F.col("f.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("f.key") == F.col("m.key")), "left")
    every = F.array_sort(F.array_union("base_list", F.coalesce("method", F.array().cast("array<string>"))))
    return both.select(
        "f.doc_id", "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base_list").alias("base_labels"),
        F.concat_ws(",", every).alias("labels"), F.coalesce("share", F.lit(0.0)).alias("score"),
    )
