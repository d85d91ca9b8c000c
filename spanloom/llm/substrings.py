"""Substring dedup: words that stand in a repeated passage of an earlier document are removed, found by suffix automata.

A window is ``length`` consecutive words. The reference is the whole table, so it is cut into shards by content, and every text meets the one shard that can hold
its windows instead of all shards: the anchor of a window is the smallest hash of its ``ANCHOR``-word sequences, and equal windows, wherever they stand, have equal anchors. A piece is a run of windows with one
anchor, and pieces are dealt by anchor. What the anchors and a second hash of the whole piece say is settled by aggregation: an anchor met in one document only has no repeats, and a
piece that stands in an earlier document word for word is removed whole. What is left, the first occurrences of different pieces around one anchor, goes to the anchor's shard, in the order
of ids. There a suffix automaton grows piece by piece; each piece is streamed through the automaton of those before, and where the matching statistic reaches ``length``, the
state's first document tells whether that passage is an earlier document's. Then the piece is added. An anchor with more than ``MOST`` different pieces has them cut into single windows, which are dealt by
their own hashes. Spans meet their documents in a join; nothing is gathered but by document.

So a shard's automaton holds at most ``STATES`` states and one anchor's pieces more, no key gathers copies, and work follows the words.

Defined results: words are set apart by ASCII white space, and unchanged; a null text has no words; a text shorter than a window keeps all of them; what repeats within one document stays; windows are judged on the
input; a null id counts as 2^63 - 1, and rows of one id are one document as far as "earlier" goes; repeated rows are kept, each with its result; very long texts are worked ``CHUNK`` windows at a time; columns other
than id and text are kept whatever their names; an empty table gives an empty result. Pieces are held equal if the hashes of their anchors and of their sequences are, 128 bits.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import drop_stored, fresh, lean, store

LENGTH, ANCHOR = 13, 5
MOST = 2048  # different pieces of an anchor
STATES = 100_000
CHUNK = 1 << 18
LAST = (1 << 63) - 1
MIX = np.array([pow(0x9E3779B97F4A7C15, j + 1, 1 << 64) | 1 for j in range(64)], np.uint64)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes: ASCII white space


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sequences(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all sequences of n codes."""
    out = np.zeros(max(len(codes) - n + 1, 0), np.uint64)
    for j in range(n if len(out) else 0):
        out += codes[j : j + len(out)] * MIX[j]
    return mixed(out)


def pieces(found: list[bytes], length: int, bodies: bool = True) -> tuple[np.ndarray, ...]:
    """(first word, windows, anchor, hash of all words) of a text's pieces."""
    codes = pd.util.hash_array(np.array(found, object), categorize=False)
    k = min(ANCHOR, length)
    small, wide, windows = sequences(codes, k), length - k + 1, len(codes) - length + 1
    at = np.empty(windows, np.int64)
    for i in range(0, windows, CHUNK):
        stop = min(i + CHUNK, windows)
        np.argmin(sliding_window_view(small[i : stop + wide - 1], wide), axis=1, out=at[i:stop])
        at[i:stop] += np.arange(i, stop)
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    n = np.diff(np.append(start, windows))
    anchor = small[at[start]]
    if not bodies:
        return start, n, anchor, anchor
    # A piece is shorter than two windows, so its first and its last window have all its words, and sequences that lie side by side have a window's.
    body = n.astype(np.uint64) * MIX[63]
    for i, o in enumerate([*range(0, length - k, k), length - k]):
        body += small[start + o] * MIX[i] + small[start + (n - 1 + o)] * MIX[i + 31]
    return start, n, anchor, mixed(body)


def occurrences(docs: DataFrame, length: int, bodies: bool = True) -> DataFrame:
    """own, key, at, n, anchor, body: a row for each piece of each text; body only where ``bodies`` are asked for. docs: (own, key, text)."""
    names = ["own", "key", "at", "n", "anchor", "body"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [[] for _ in names]
            for own, key, text in zip(b.column("own").to_pylist(), b.column("key").to_pylist(), b.column("text")):
                found = words(text.as_py())
                if len(found) < length:
                    continue
                at, n, anchor, body = pieces(found, length, bodies)
                for c, x in zip(columns, (np.full(len(at), own), np.full(len(at), key, np.int32), at.astype(np.int32), n.astype(np.int32), anchor.view(np.int64), body.view(np.int64))):
                    c.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names)

    return docs.mapInArrow(run, "own long, key int, at int, n int, anchor long, body long")


class Automaton:
    """A suffix automaton of word sequences; ``first`` is the smallest owner of a state's sequences, as sequences are added in the order of their owners."""

    def __init__(self) -> None:
        self.next, self.link, self.size, self.first = [{}], [-1], [0], [-1]

    def add(self, sequence: list[bytes], owner: int) -> None:
        step, link, size, first = self.next, self.link, self.size, self.first
        last = 0
        for w in sequence:
            known = step[last].get(w)
            if known is not None and size[known] == size[last] + 1:
                last = known
                continue
            if known is None:
                now = len(step)
                step.append({})
                link.append(0)
                size.append(size[last] + 1)
                first.append(owner)
                p = last
                while p >= 0 and w not in step[p]:
                    step[p][w] = now
                    p = link[p]
                if p >= 0:
                    q = step[p][w]
                    link[now] = q if size[q] == size[p] + 1 else self.split(p, w, q)
                last = now
            else:
                last = self.split(last, w, known)

    def split(self, p: int, w: bytes, q: int) -> int:
        """The state of the shorter sequences of q, those that end in p's and w."""
        step, link, size = self.next, self.link, self.size
        c = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        self.first.append(self.first[q])
        link[q] = c
        while p >= 0 and step[p].get(w) == q:
            step[p][w] = c
            p = link[p]
        return c

    def stream(self, sequence: list[bytes], length: int) -> list[int | None]:
        """For each word that ends a window the first owner of that window, or None."""
        step, link, size = self.next, self.link, self.size
        state = match = 0
        out = []
        for i, w in enumerate(sequence):
            while state and w not in step[state]:
                state = link[state]
                match = size[state]
            if w in step[state]:
                state, match = step[state][w], match + 1
            while size[link[state]] >= length if state else False:  # the window's own state
                state = link[state]
            match = min(match, size[state])
            if i >= length - 1:
                out.append(self.first[state] if match >= length else None)
        return out


def stretches(flags: list[bool]) -> list[tuple[int, int]]:
    """(first, length) of the runs of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return [(a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]


def matched(candidates: DataFrame, length: int, states: int) -> DataFrame:
    """own, key, at, n: runs of windows that an earlier document has. candidates: anchor, own, key, at, body, words."""
    names = ["own", "key", "at", "n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, anchor, known = Automaton(), None, (None, [])
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            columns = (b.column(n).to_pylist() for n in ("anchor", "own", "key", "at", "body", "words"))
            for a, own, key, at, body, text in zip(*columns):
                if a != anchor:
                    anchor, known = a, (None, [])
                    if len(machine.next) > states:
                        machine = Automaton()
                if known[0] != (own, body):  # else the same piece once more in its document
                    sequence = words(text)
                    found = machine.stream(sequence, length)
                    if None in found:
                        machine.add(sequence, own)
                    known = ((own, body), stretches([f is not None and f < own for f in found]))
                out += [(own, key, at + i, n) for i, n in known[1]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names)

    dealt = candidates.repartition("anchor").sortWithinPartitions("anchor", "own", "body")
    return dealt.mapInArrow(run, "own long, key int, at int, n int")


def free() -> None:
    """Shuffle files go when nothing refers to them any more and the driver's garbage is collected; a stage's are as large as its input."""
    from pyspark.sql import SparkSession

    gc.collect()
    SparkSession.active().sparkContext._jvm.System.gc()


def with_words(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """anchor, own, key, at, body, words of the wanted pieces: (own, key, at, n, anchor, body, single). ``single`` ones are cut into windows."""
    by_text = wanted.groupBy("own", "key").agg(F.collect_list(F.struct("at", "n", "anchor", "body", "single")).alias("wanted"))  # at most a text's own pieces
    names = ["anchor", "own", "key", "at", "body", "words"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for own, key, text, some in zip(*(b.column(n) for n in ("own", "key", "text", "wanted"))):
                found, own, key = words(text.as_py()), own.as_py(), key.as_py()
                for p in some.as_py():
                    for i in range(p["n"]) if p["single"] else (None,):
                        at, n = (p["at"], p["n"] + length - 1) if i is None else (p["at"] + i, length)
                        joined = b" ".join(found[at : at + n])
                        anchor, body = (p["anchor"], p["body"]) if i is None else (np.uint64(xxhash.xxh64_intdigest(joined)).astype(np.int64).item(), 0)
                        rows.append((anchor, own, key, at, body, joined.decode("utf-8", "surrogatepass")))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), TYPES)], names)

    return docs.join(by_text, ["own", "key"]).mapInArrow(run, "anchor long, own long, key int, at int, body long, words string")


TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())


def slim(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(own, key, text): key tells rows of one id apart."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("own"), F.hash(text).alias("key"), F.col(text).alias("text"))


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, length: int = LENGTH, most: int = MOST, states: int = STATES) -> DataFrame:
    """own, key, at, n, stored: n windows from word ``at`` on are an earlier document's. A window may be told of more than once."""
    lean(docs)
    own = slim(docs, doc_id, text)

    def shared() -> DataFrame:
        """The pieces around anchors of several documents. The anchors are stored first: a join that reads them beside the pieces can split the tasks of frequent ones."""
        ends = occurrences(own, length, bodies=False).groupBy("anchor").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("anchor")
        several = store(ends, "anchors")
        del ends
        free()
        out = store(occurrences(own, length).join(several, "anchor", "left_semi"), "pieces")
        drop_stored(several)
        return out

    def told(near: DataFrame) -> DataFrame:
        """Of each piece whether it is an earlier document's as a whole; else, how many different pieces its anchor has."""
        texts = near.groupBy("anchor", "body").agg(F.min("own").alias("low"))
        kinds = texts.groupBy("anchor").agg(F.count("*").alias("bodies"))
        both = store(texts.join(kinds, "anchor"), "texts")
        return store(near.join(both, ["anchor", "body"]).withColumn("whole", F.col("own") > F.col("low")).where("whole or bodies > 1").drop("low"), "told")

    near = shared()
    free()
    judged = told(near)
    drop_stored(near)
    free()
    wanted = judged.where("not whole").select("own", "key", "at", "n", "anchor", "body", (F.col("bodies") > most).alias("single"))
    candidates = store(with_words(own, wanted, length), "candidates")
    free()
    found = store(judged.where("whole").select("own", "key", "at", "n").unionByName(matched(candidates, length, states)), "spans")
    drop_stored(candidates)
    free()
    return found


def strip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, keep: list[str] | None = None, length: int = LENGTH, most: int = MOST, states: int = STATES) -> DataFrame:
    """``docs``, or its columns ``keep``, with n_words, n_removed and kept (the words that stay, set apart by single spaces); names that clash get an underscore."""
    own, key, where, *names = fresh(docs.columns, "own", "key", "spans", "n_words", "n_removed", "kept")
    found = spans(docs, doc_id, text, length=length, most=most, states=states)
    by_text = found.groupBy("own", "key").agg(F.collect_set(F.struct("at", "n")).alias(where)).withColumnsRenamed({"own": own, "key": key})  # at most a text's own windows
    keyed = docs.withColumns({own: F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), key: F.hash(text)})
    joined = keyed.join(by_text, [own, key], "left").drop(own, key)
    kept = list(docs.columns) if keep is None else keep

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, out = [], [], []
            for value, some in zip(b.column(text), b.column(where)):
                found = words(value.as_py())
                gone = np.zeros(len(found) + 1, np.int64)
                if some.is_valid and len(some):
                    at = some.values.field("at").to_numpy()
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + some.values.field("n").to_numpy() + length - 1, -1)
                stays = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
                n_words.append(len(found))
                n_removed.append(len(found) - len(stays))
                out.append(b" ".join(found if len(stays) == len(found) else [found[i] for i in stays.tolist()]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], [*kept, *names])

    schema = StructType([*(docs.schema[c] for c in kept), *(StructField(n, t()) for n, t in zip(names, (LongType, LongType, StringType)))])
    return joined.select(*dict.fromkeys([*kept, text, where])).mapInArrow(run, schema)
