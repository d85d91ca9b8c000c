"""A Merkle manifest of a table: a tree of hashes for each group, and one over the groups' roots.

Leaves are dealt by range of (group, order) to partitions; counts by partition give every leaf its place in its group. A partition is worked by a mountain range: a stack with
one run of nodes for each level. A run that fills up to ``FANOUT`` nodes carries its parent to the level above, and gives node records; what is left of a run, because it began in the
partition before or ends in the next one, is given as open. Open nodes, at most two runs for each level and partition, meet in one ``groupBy`` for each level, where short runs at a group's end are
hashed as they are, without padding. So no task holds more than a partition of leaves, and rounds are as many as levels.

A proof is the siblings on the way up. Each partition gets the few runs that it shares with others (two for each level), makes its own again, and folds
every leaf up to the root. The tree over groups is the same tree once more, with the groups' roots as leaves of one group.

Defined results: a null column is written as ``-`` and an empty text as ``0:``; leaves of a group go by id, nulls first, then by their hash; repeated rows are leaves each; the
group null is a group and the first; a group of one leaf has that as its root, and siblings that do not exist give the hash of nothing; a null id is never tampered with; columns other than the five have no part, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stored, lean, store

FANOUT = 8
PART = 1 << 16  # leaves of a partition
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts: list[bytes]) -> bytes:
    """The hash of digests in hex, as hex."""
    return hashlib.sha256(b"".join(parts)).hexdigest().encode()


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The hash of a row's columns, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(grp, id, leaf, seen): one for each document. ``seen`` is the leaf as it stands after tampering, null where nothing is done; grp is the group as text of which null is the least."""
    text = F.col("text")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    changed = leaf(*(F.translate(text, UPPER, LOWER) if n == "text" else F.col(n) for n in FIELDS))
    own = leaf(*map(F.col, FIELDS))
    return docs.select(grouped("lang").alias("grp"), F.col("doc_id").alias("id"), own.alias("leaf"), F.when(tampered, changed).alias("seen"))


def grouped(name: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def place(rows: DataFrame, part: int) -> tuple[DataFrame, int]:
    """Rows by range of (grp, id, leaf), with their partition and their place in it, stored; and the number of partitions. Equal rows are spread by the place they come from."""
    n = rows.count()
    parts = max(1, -(-n // part), min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 256)))
    by = [F.col("grp"), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("from")]
    dealt = rows.withColumn("from", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    return store(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).drop("from"), "placed"), parts


def counts(placed: DataFrame) -> DataFrame:
    """grp, part, first (the least place), low and high (places in the group), n (of the group): one row for each group of a partition."""
    own = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    w = W.partitionBy("grp")
    upto = F.sum("k").over(w.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    return own.withColumn("high", upto).withColumn("n", F.sum("k").over(w)).select("grp", "part", "first", (F.col("high") - F.col("k")).alias("low"), "high", "n")


def height(n: int) -> int:
    """Levels above the leaves."""
    out = 0
    while n > 1:
        n, out = -(-n // FANOUT), out + 1
    return out


def beside(placed: DataFrame, parts: int, others: list[DataFrame]) -> DataFrame:
    """The rows of a partition together, first those of ``others``, then its leaves in order."""
    both = placed.select("part", F.lit(9).alias("kind"), "grp", "at", *(c for c in placed.columns if c not in ("part", "grp", "at")))
    for kind, other in enumerate(others):
        both = both.unionByName(other.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    return both.repartitionById(parts, F.col("part") % parts).sortWithinPartitions("part", "kind", "grp", "at")


def by_group(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, dict[int, list[dict]], pa.Table]]:
    """For each group of a partition: its other rows by kind, and its leaves."""
    now, others, held = None, {}, []

    def given() -> Iterator[tuple[str, dict[int, list[dict]], pa.Table]]:
        whole = pa.Table.from_batches(held)
        names = whole.column("grp").combine_chunks().dictionary_encode()
        at = names.indices.to_numpy()
        start = 0
        while start < len(at):
            end = start + int((at[start:] == at[start]).sum())
            grp = names.dictionary[int(at[start])].as_py()
            yield grp, others.get(grp, {}), whole.slice(start, end - start)
            start = end

    for b in batches:
        part, kind = b.column("part").to_pylist(), b.column("kind").to_pylist()
        start = 0
        while start < b.num_rows:
            if part[start] != now:
                if held:
                    yield from given()
                now, others, held = part[start], {}, []
            end = start + 1
            while end < b.num_rows and part[end] == now and kind[end] == kind[start]:
                end += 1
            if kind[start] == 9:
                held.append(b.slice(start, end - start))
            else:
                for r in b.slice(start, end - start).to_pylist():
                    others.setdefault(r["grp"], {}).setdefault(r["kind"], []).append(r)
            start = end
    if held:
        yield from given()


def hexes(column: pa.ChunkedArray) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


class Mountains:
    """The stack of a stretch of leaves: at each level the run that is not full yet."""

    def __init__(self, low: int) -> None:
        self.low, self.runs, self.done, self.open = low, [], [], []

    def push(self, level: int, place: int, digest: bytes) -> None:
        while True:
            if level == len(self.runs):
                self.runs.append([])
            run = self.runs[level]
            run.append((place, digest))
            if place % FANOUT != FANOUT - 1:
                return
            self.runs[level] = []
            if len(run) < FANOUT:
                self.open += [(level, *x) for x in run]  # it began before this stretch
                return
            if level:
                self.done += [(level, *x) for x in run]  # leaves are a table of their own
            level, place, digest = level + 1, place // FANOUT, h([d for _, d in run])

    def peaks(self) -> list[tuple[int, int, bytes]]:
        """All nodes whose run is not whole here."""
        return [*self.open, *((level, *x) for level, run in enumerate(self.runs) for x in run)]


def records(placed: DataFrame, parts: int, known: DataFrame) -> DataFrame:
    """grp, n (nodes of the level), level, place, digest, open: the nodes that the partitions make by themselves."""
    names = ["grp", "n", "level", "place", "digest", "open"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grp, others, rows in by_group(batches):
            own = others[0][0]
            stack = Mountains(own["low"])
            for i, d in enumerate(hexes(rows.column("leaf")), own["low"]):
                stack.push(0, i, d)
            for nodes, is_open in ((stack.done, False), (stack.peaks(), True)):
                if nodes:
                    k = len(nodes)
                    level, at, digest = zip(*nodes)
                    yield pa.RecordBatch.from_arrays([pa.array([grp] * k), pa.array([-(-own["n"] // FANOUT**x) for x in level], pa.int64()), pa.array(level, pa.int32()), pa.array(at, pa.int64()),
                                                      pa.array([bytes.fromhex(d.decode()) for d in digest], pa.binary()), pa.array([is_open] * k)], names)

    return beside(placed.select("part", "grp", "at", "leaf"), parts, [known.select("part", "grp", "low", "n")]).mapInArrow(run, "grp string, n long, level int, place long, digest binary, open boolean")


def merge(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(grp, level, run, digests) of every run that no partition has whole, and (grp, root). One round for each level."""
    open_nodes = nodes.where("open").select("grp", "n", "level", "place", "digest")
    left = F.col("n")  # nodes of the level
    carried, runs, roots = None, [], []
    for level in range(levels + 1):
        now = open_nodes.where(F.col("level") == level).drop("level")
        now = now if carried is None else now.unionByName(carried)
        roots.append(now.where(left == 1).select("grp", F.col("digest").alias("root")))
        if level == levels:
            break
        met = now.where(left > 1).groupBy("grp", "n", F.floor(F.col("place") / FANOUT).alias("run")).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("x"))
        met = store(met.select("grp", "n", "run", F.col("x.digest").alias("digests")), f"runs{level}")
        parent = F.unhex(F.sha2(F.concat_ws("", F.transform("digests", lambda d: F.lower(F.hex(d)))), 256))
        carried = met.select("grp", F.ceil(left / FANOUT).alias("n"), F.col("run").alias("place"), parent.alias("digest"))
        runs.append(met.select("grp", F.lit(level).alias("level"), "run", "digests"))
    every = lambda parts, schema: _union(parts) if parts else nodes.sparkSession.createDataFrame([], schema)
    return every(runs, "grp string, level int, run long, digests array<binary>"), _union(roots)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Tree:
    """A tree over groups: their leaves in place, the counts, the runs that partitions share, and each group's root."""

    def __init__(self, rows: DataFrame, part: int = PART) -> None:
        lean(rows)
        self.placed, self.parts = place(rows, part)
        self.known = store(counts(self.placed), "counts")
        self.nodes = store(records(self.placed, self.parts, self.known), "nodes")
        self.levels = height(self.known.agg(F.max("n")).first()[0] or 0)
        self.runs, self.roots = merge(self.nodes, self.levels)

    def shared(self) -> DataFrame:
        """part, grp, level, run, digests: the runs that a partition needs and does not have whole."""
        spans = self.known.select("grp", "part", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(max(self.levels - 1, 0)))).alias("level"))
        width = F.pow(F.lit(float(FANOUT)), F.col("level") + 1)
        need = F.array_distinct(F.array(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width)))
        return spans.select("grp", "part", "level", F.explode(need).alias("run")).join(self.runs, ["grp", "level", "run"])

    def every_node(self) -> DataFrame:
        """grp, level, place, digest: all nodes above the leaves; a group's root stands at its highest level."""
        flat = self.runs.where("level > 0").select("grp", "level", F.posexplode("digests").alias("i", "digest"), "run")
        merged = flat.select("grp", "level", (F.col("run") * FANOUT + F.col("i")).alias("place"), "digest")
        top = self.known.groupBy("grp").agg(F.max("n").alias("n")).join(self.roots, "grp").where("n > 1")
        level = F.size(F.filter(F.sequence(F.lit(1), F.lit(max(self.levels, 1))), lambda i: F.pow(F.lit(float(FANOUT)), i - 1) < F.col("n")))
        tops = top.select("grp", level.alias("level"), F.lit(0).cast("long").alias("place"), F.col("root").alias("digest"))
        own = self.nodes.where("not open and level > 0").select("grp", "level", "place", "digest")
        return own.unionByName(merged).unionByName(tops)


def climb(own: list[bytes], low: int, n: int, runs: dict[tuple[int, int], list[bytes]]) -> tuple[list[tuple[int, list[bytes]]], bytes]:
    """For each level (place of the first node, nodes) of all runs that the stretch meets, and the group's root."""
    levels, a, b = [], low, low + len(own)
    while n > 1:
        first, last = a // FANOUT, (b - 1) // FANOUT
        start = first * FANOUT
        before, after = runs.get((len(levels), first), []), runs.get((len(levels), last), [])
        nodes = before[: a - start] + own + after[b - last * FANOUT :]
        levels.append((start, nodes))
        own = [h(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        a, b, n = first, last + 1, -(-n // FANOUT)
    return levels, own[0]


class Paths:
    """Siblings before and after each leaf's ancestors, level by level. What a run's leaves have in common is made once."""

    def __init__(self, levels: list[tuple[int, list[bytes]]], top: list[tuple[bytes, bytes]]) -> None:
        self.levels, self.top, self.last = levels, top, {}

    def of(self, place: int, level: int = 0) -> list[tuple[bytes, bytes]]:
        if level == len(self.levels):
            return self.top
        known = self.last.get(level)
        if known and known[0] == place:
            return known[1]
        start, nodes = self.levels[level]
        i = place - start
        a, b = i - i % FANOUT, i - i % FANOUT + FANOUT
        out = [(b"".join(nodes[a:i]), b"".join(nodes[i + 1 : b])), *self.of(place // FANOUT, level + 1)]
        if level:
            self.last[level] = (place, out)
        return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in path:
        digest = h([before, digest, after])
    return digest


def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table, list[bytes], int, Paths, bytes, bytes]]:
    """Of each group of a partition: its name, its rows, their leaves, the first place, the paths, the group's root, and the root of all."""
    for grp, others, rows in by_group(batches):
        own = others[0][0]
        shared = {(r["level"], r["run"]): [d.hex().encode() for d in r["digests"]] for r in others.get(1, [])}
        above = others.get(2, [{"before": [], "after": [], "whole": None}])[0]
        top = [(a.encode(), b.encode()) for a, b in zip(above["before"], above["after"])]
        digests = hexes(rows.column("leaf"))
        levels, root = climb(digests, own["low"], own["n"], shared)
        yield grp, rows, digests, own["low"], Paths(levels, top), root, above["whole"].encode() if above["whole"] else root


def over_groups(tree: Tree) -> DataFrame:
    """grp, before, after, whole: of each group's root its siblings level by level, as hex, and the root of all."""
    upper = Tree(tree.roots.select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("root").alias("leaf")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, _, low, paths, _, whole in stretches(batches):
            found = [paths.of(i) for i in range(low, low + rows.num_rows)]
            sides = [pa.array([[x[side].decode() for x in p] for p in found], pa.list_(pa.string())) for side in (0, 1)]
            yield pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), *sides, pa.array([whole.decode()] * rows.num_rows)], ["grp", "before", "after", "whole"])

    near = [upper.known.select("part", "grp", "low", "n"), upper.shared()]
    return beside(upper.placed, upper.parts, near).mapInArrow(run, "grp string, before array<string>, after array<string>, whole string")


def proofs(docs: DataFrame, part: int = PART) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row for each document, digests as hex."""
    own = store(leaves(docs), "leaves")
    tree = Tree(own, part)
    drop_stored(own)  # all that follows reads them in their places
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, digests, low, paths, subroot, whole in stretches(batches):
            for at in range(0, rows.num_rows, 4096):
                some = rows.slice(at, 4096)
                proof, folded = [], []
                for i, seen in enumerate(some.column("seen").to_pylist(), at):
                    path = paths.of(low + i)
                    proof.append(h([x for both in path for x in both]).decode())
                    folded.append(fold(seen.hex().encode() if seen else digests[i], path))
                k = some.num_rows
                text = lambda v: pa.array(v, pa.string())
                yield pa.RecordBatch.from_arrays([some.column("id").combine_chunks(), text([d.decode() for d in digests[at : at + k]]), text([subroot.decode()] * k), text([whole.decode()] * k), text(proof),
                                                  text([f.decode() for f in folded]), pa.array([f == whole for f in folded])], names)

    above = tree.known.select("grp", "part").join(store(over_groups(tree), "over"), "grp")
    near = [tree.known.select("part", "grp", "low", "n"), tree.shared(), above]
    out = ", ".join(f"{n} {kind if n == 'doc_id' else 'boolean' if n == 'verified' else 'string'}" for n in names)
    return beside(tree.placed, tree.parts, near).mapInArrow(run, out)


def manifest(docs: DataFrame, part: int = PART) -> DataFrame:
    """grp, level, place, digest (hex): all nodes above the leaves, of a tree that is kept to compare a table with later."""
    return Tree(store(leaves(docs), "leaves"), part).every_node().withColumn("digest", F.lower(F.hex("digest")))
