"""Quality scores by Bradley-Terry ranking of documents.

A document's strength is a linear function of features of its text; that one of a pair is preferred has the
logistic probability of the difference of their strengths. Pairs are (label 1, label 0) rows drawn at random
from the training rows; the weights minimise the logistic loss on the pairs' feature differences, with an L2
term, by Newton's method. The features are surface measures of the whole text, each cut at its quantiles
into steps, so that the additive model can bend; an identifier, source or language is never among them.

The threshold is a quantile of strength: as large a share of rows lies above it as the labels have of 1. The
score is the logistic of the strength less that quantile, moved so that the quantile itself scores ``cut``.

Every labelled row that training may see takes part. Rows are dealt by hash to blocks of some ``block`` rows of each label; a block draws ``PAIRS`` pairs among its
rows, and each step of Newton's method sums what all blocks give, so that the driver holds sums of fixed size only. A label too rare for that lends its rows to several blocks. The cuts
and the threshold are exact quantiles of all these rows, from values in ranges whose counts are summed. Every document is scored.

Defined results: a null or empty text has the features of the empty text and a score like any other; repeated rows
repeat; rows with a null id are never trained on and not held out; labels other than 0 and 1, or null, are not used;
without rows of both labels every score is one half; texts are measured whole; columns other than those named have no part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, store

BLOCK = 1000  # rows of each label in a block
RARE = 100  # rows of the rarer label that a block has about at least, if there are as many
PAIRS = 20_000  # of a block
STEPS = 8

UPPER = np.zeros(256, bool)
UPPER[65:91] = True
LOWER = np.zeros(256, bool)
LOWER[97:123] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
HIGH = np.zeros(256, bool)
HIGH[128:] = True
STOP = np.zeros(256, bool)
STOP[[44, 46]] = True
SYMBOL = ~(UPPER | LOWER | DIGIT | SPACE | HIGH | STOP)
LETTERS = re.compile(r"[^\W\d_]+")

NAMES = ("log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "exclaim", "pipes", "stops", "distinct_words", "distinct_lines", "top_word", "same_next",
         "all_caps_words", "words_with_symbols", "line_length", "symbol_kinds", "top_bigram", "capital_starts", "repeated_line_share")


def features(text: str | None) -> list[float]:
    """Measures of the whole text, in the order of NAMES."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    count = np.bincount(raw, minlength=256)
    words = text.split()
    m = max(1, len(words))
    kinds = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    line_kinds = Counter(lines)
    pairs = Counter(zip(words, words[1:])) if len(words) > 1 else Counter()
    caps = sum(c for w, c in kinds.items() if len(w) > 1 and w.isupper())
    odd = sum(c for w, c in kinds.items() if not w[-1].isalnum() and w[-1] not in ".,")
    capital = sum(c for w, c in kinds.items() if w[0].isupper())
    same = sum(c for (a, b), c in pairs.items() if a == b)
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), float(sum(len(w) * c for w, c in kinds.items())) / m,
        float(count[UPPER].sum()) / n, float(count[DIGIT].sum()) / n, float(count[SYMBOL].sum()) / n, float(count[33]) / n, float(count[124]) / n,
        float(count[STOP].sum()) / m, len(kinds) / m, len(line_kinds) / max(1, len(lines)), max(kinds.values(), default=0) / m, same / m,
        caps / m, odd / m, float(np.log1p(n / max(1, len(lines)))), float(np.count_nonzero(count[SYMBOL])), max(pairs.values(), default=0) / m, capital / m,
        sum(c for c in line_kinds.values() if c > 1) / max(1, len(lines)),
    ]


def steps(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """One column for each cut of each feature: whether the value lies above it."""
    return (values[:, :, None] > cuts[None, :, :]).reshape(len(values), -1).astype(float)


def drawn(good: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block's pairs: label 1, label 0."""
    rng = np.random.default_rng(seed)
    return rng.choice(np.flatnonzero(good), PAIRS), rng.choice(np.flatnonzero(~good), PAIRS)


def slope(x: np.ndarray, good: np.ndarray, w: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives (the latter negated) of the log likelihood of a block's pairs at ``w``."""
    up, down = drawn(good, seed)
    d = x[up] - x[down]
    p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
    return d.T @ (1 - p), (d * (p * (1 - p))[:, None]).T @ d


def climb(slopes: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], n: int, l2: float = 1.0) -> np.ndarray:
    """Newton's method from zero weights; ``slopes`` gives the derivatives summed over all pairs."""
    w = np.zeros(n)
    for _ in range(25):
        first, second = slopes(w)
        step = np.linalg.solve(second + l2 * np.eye(n), first - l2 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(values: np.ndarray, good: np.ndarray, share: float, seed: int = 7, l2: float = 1.0) -> tuple[np.ndarray, np.ndarray, float]:
    """cuts (features x STEPS), weights, and the strength above which the given share of rows lies: the model of one block."""
    cuts = np.quantile(values, np.linspace(0, 1, STEPS + 2)[1:-1], axis=0).T
    x = steps(values, cuts)
    w = climb(lambda now: slope(x, good, now, seed), x.shape[1], l2)
    strength = x @ w
    weight = np.where(good, share / max(1, good.sum()), (1 - share) / max(1, (~good).sum()))
    order = np.argsort(strength)
    above = np.cumsum(weight[order])
    at = int(np.searchsorted(above, 1 - share + 1e-9))
    low, high = strength[order[max(at - 1, 0)]], strength[order[min(at, len(order) - 1)]]
    return cuts, w, float((low + high) / 2)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def summed(values: DataFrame) -> DataFrame:
    """k, x, up, down: each value once with the rows of label 1 and 0 up to it and with it, in the order of k and x. ``values``: k, x, good. A range's rows are
    one task's; ranges are as many as tasks."""
    counts = values.groupBy("k", "x").agg(F.sum("good").alias("ups"), F.sum(1 - F.col("good")).alias("downs"))
    pieces = store(counts.repartitionByRange("k", "x").withColumn("piece", F.spark_partition_id()), "pieces")
    w = W.partitionBy("k").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)  # a row for each range and feature
    sums = pieces.groupBy("piece", "k").agg(F.sum("ups").alias("u"), F.sum("downs").alias("d"))
    before = sums.select("piece", "k", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0") for c in ("u", "d")])
    own = W.partitionBy("piece", "k").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = pieces.join(F.broadcast(before), ["piece", "k"])
    return both.select("k", "x", "ups", "downs", (F.col("u0") + F.sum("ups").over(own)).alias("up"), (F.col("d0") + F.sum("downs").over(own)).alias("down"))


def quantiles(values: DataFrame, n: int) -> np.ndarray:
    """The cuts of each feature: linear between neighbours in the order of its ``n`` values."""
    at = np.linspace(0, 1, STEPS + 2)[1:-1] * (n - 1)
    wanted = sorted({int(i) for i in (*np.floor(at), *np.minimum(np.floor(at) + 1, n - 1))})
    end = F.col("up") + F.col("down")
    ranks = F.filter(F.array(*map(F.lit, wanted)), lambda r: (r < end) & (r >= end - F.col("ups") - F.col("downs")))
    found = {(r.k, r.r): r.x for r in summed(values).select("k", "x", F.explode(ranks).alias("r")).collect()}  # two for each cut
    low, part = np.floor(at).astype(int), at - np.floor(at)
    a, b = (np.array([[found[k, int(min(i, n - 1))] for i in low + more] for k in range(len(NAMES))]) for more in (0, 1))
    return np.where(part < 0.5, a + (b - a) * part, b - (b - a) * (1 - part))


def threshold(strengths: DataFrame, ups: int, downs: int, share: float) -> float:
    """The strength above which the given share of rows lies, each label weighing its share: between the row that reaches it and the row before."""
    weight = lambda up, down: up * F.lit(share / ups) + down * F.lit((1 - share) / downs)
    target, rows = F.lit(1 - share + 1e-9), summed(strengths)
    up, down = F.col("up") - F.col("ups"), F.col("down") - F.col("downs")  # before the row
    first = (weight(up + (F.col("ups") > 0).cast("int") * (F.col("downs") == 0).cast("int"), down + (F.col("downs") > 0).cast("int")) >= target) | (up + down == 0)
    got = rows.agg(
        F.min(F.when(weight(F.col("up"), F.col("down")) >= target, F.struct("x", first.alias("first")))).alias("high"),
        F.max(F.when(weight(F.col("up"), F.col("down")) < target, F.col("x"))).alias("low"), F.max("x").alias("most"),
    ).first()
    if got.high is None:
        return float(got.most)
    return float(((got.low if got.high.first and got.low is not None else got.high.x) + got.high.x) / 2)


def sums_of(blocks: DataFrame, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The derivatives at ``w``, summed over all blocks; a task gives one row."""
    n = len(w)
    upper = np.triu_indices(n)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second, some = np.zeros(n), np.zeros((n, n)), False
        for b in batches:
            for block in b.column(0):
                rows = block.as_py()
                good = np.array([r["good"] for r in rows], bool)
                if good.any() and not good.all():
                    x = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(good), -1), axis=1)[:, :n].astype(float)
                    one, two = slope(x, good, w)
                    first, second, some = first + one, second + two, True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([first, second[upper]])], pa.list_(pa.float64()))], ["sums"])

    total = np.sum([r.sums for r in blocks.select("rows").mapInArrow(work, "sums array<double>").toLocalIterator()], axis=0)
    second = np.zeros((n, n))
    second[upper] = total[n:]
    return total[:n], second + np.triu(second, 1).T


def learn(rows: DataFrame, share: float, block: int) -> tuple[np.ndarray, np.ndarray, float] | None:
    """What ``fit`` gives, from all ``rows`` (id, good, f); nothing without rows of both labels."""
    ups, total = rows.agg(F.coalesce(F.sum("good"), F.lit(0)), F.count("*")).first()
    downs = total - ups
    if not ups or not downs:
        return None
    cuts = quantiles(rows.select("good", F.posexplode("f").alias("k", "x")), total)
    n = cuts.size

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = steps(np.array(b.column("f").to_pylist()).reshape(b.num_rows, len(NAMES)), cuts).astype(bool)
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("salt"), b.column("good"), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], ["h", "salt", "good", "bits"])

    # Repeated rows stay, each with a number of its own in the hash that deals them.
    once = rows.groupBy(F.xxhash64("id").alias("h"), "id", "good", "f").agg(F.count("*").alias("n"))
    each = once.select("h", "good", "f", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"), F.col("id"))
    ready = store(each.select("h", F.xxhash64("id", "f", "i").alias("salt"), "good", "f").mapInArrow(cut, "h long, salt long, good int, bits binary"), "cut")
    many, rare, rare_label = -(-max(ups, downs) // block), min(ups, downs), int(ups < downs)
    lent = min(many, max(1, -(-many * RARE // rare)))
    turns = F.when(F.col("good") == rare_label, F.lit(lent)).otherwise(F.lit(1))
    dealt = ready.select(F.explode(F.sequence(F.lit(0), turns - 1)).alias("turn"), "*").withColumn("block", F.pmod(F.xxhash64(F.lit(5), "salt"), F.lit(many)) + F.col("turn"))
    blocks = store(dealt.groupBy((F.col("block") % many).alias("block")).agg(F.array_sort(F.collect_list(F.struct("h", "salt", "bits", "good"))).alias("rows")), "blocks")
    w = climb(lambda now: sums_of(blocks, now), n)

    def strong(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.unpackbits(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1), axis=1)[:, :n]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.round((x * w).sum(axis=1), 12))], ["good", "x"])

    strengths = ready.select("good", "bits").mapInArrow(strong, "good int, x double").withColumn("k", F.lit(0))
    return cuts, w, threshold(strengths, ups, downs, share)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", *, block: int = BLOCK, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    lean(docs)
    kind = docs.schema[doc_id].dataType.simpleString()

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([features(t.as_py()) for t in b.column(1)], pa.list_(pa.float64()))], ["id", "f"])

    measured = store(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(measure, f"id {kind}, f array<double>"), "measured")
    seen = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("good")).where(F.col(label).isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    share = float(seen.agg(F.avg("good")).first()[0] or 0.0)
    model = learn(store(measured.join(seen.distinct(), "id").select("id", "good", "f"), "training"), share, block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if model is None:
                out = np.full(b.num_rows, 0.5)
            else:
                cuts, w, middle = model
                strength = (steps(np.array(b.column(1).to_pylist()).reshape(b.num_rows, len(NAMES)), cuts) * w).sum(axis=1)
                out = 1 / (1 + np.exp(-np.clip(strength - middle + np.log(cut / (1 - cut)), -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], ["doc_id", "score"])

    scored = measured.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
