"""SentencePiece encoding by sampling without replacement, and decoding.

The pieces of a model that match a text make a lattice; a segmentation is a path through it. A piece weighs
``(rank + 2) ** -alpha`` with its rank in the model, a character that no piece covers is a run of byte pieces, and
a segmentation has the product of its pieces' weights, over the sum for all segmentations. Each text gets the ``k``
segmentations with the largest Gumbel-perturbed log-probabilities: ``k`` draws without replacement, most perturbed first.

They are found by A-star search from the start of the text. A node is the set of segmentations with a given
beginning; its log-probability is exact, by a backward pass over the lattice. The best of a node's children
inherits its perturbed value, which is the node's maximum and so an exact bound; its siblings, taken together as one node
("the rest"), get a Gumbel value truncated there. The best open node is always expanded, so that going on along one
beginning is an ancestral draw, and the next segmentation leaves an earlier one where the largest rest is. With kappa the
largest value left in the queue, a segmentation was included with probability ``1 - exp(-exp(log p - kappa))``.

No piece has a space after its first other character, so the lattice falls into units, each a run of spaces and a run of
other characters. Equal units that a task meets share one sublattice, and the draws of all units run in step as array
operations. Random numbers are hashes of (seed, row key, draw, unit, step): reruns and other partitionings agree.

Text is taken as it is: white space is kept, and U+2581 itself goes by its bytes, so decoding gives the text back exactly.
The model's bytes are read once on the driver and sent with the tasks (a fixed size, that of the file).

Defined results: a null text is empty; an empty text has one segmentation, without pieces, of probability one; a text with
fewer than k segmentations gives all of them; equal perturbed values keep the order of the search; repeated rows get the same
draws; a null key is the key ""; extra columns are left out; an empty table gives an empty result. Memory does not follow the partition: a batch ends at ``BATCH``
characters, and a text of more than ``LONG`` is worked in parts, of which some bytes a character are kept.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HELD = "\ud800"  # stands for U+2581 of the text itself: half a surrogate pair, which no text of a table can hold
UNIT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
BATCH = 400_000
FREQUENT = 64  # characters in the trie's table
LONG = 2_000_000  # characters beyond which a text is worked in parts
EDGES = 2_000_000  # kept for later batches; about 40 bytes each
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # fixed values of splitmix64


def uniform(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the parts alone."""
    with np.errstate(over="ignore"):
        x = np.asarray(parts[0]).astype(np.uint64)
        for p, m in zip(parts[1:], (MIX[0], MIX[1], MIX[2])):
            x = x + (np.asarray(p).astype(np.uint64) + np.uint64(1)) * m
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def truncated(place: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel values at ``place``, given that they are at most ``top``."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = place - np.log(np.exp(place - top) - np.log(u))
    return np.where(np.isneginf(place), -np.inf, np.minimum(out, top))


class Model:
    def __init__(self, proto: bytes, alpha: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.byte_id = np.zeros(256, np.int32)
        self.bytes = [p.replace(SPACE, " ").encode() for p in names]
        for i in range(n):
            if sp.is_byte(i):
                self.byte_id[int(names[i][3:-1], 16)] = i
                self.bytes[i] = bytes([int(names[i][3:-1], 16)])
            elif sp.is_control(i) or sp.is_unknown(i):
                self.bytes[i] = b""
        self.weight = np.zeros(n)
        self.weight[plain] = [-alpha * np.log(2.0 - sp.get_score(i)) for i in plain]
        self.byte_weight = -alpha * np.log(2.0 + n)
        # A trie as sorted keys (node, character) -> node; for the pieces' most frequent characters also as a table.
        seen = Counter(ord(c) for i in plain for c in names[i])
        chars = sorted(seen, key=lambda c: (-seen[c], c))
        self.codes = np.zeros(0x110000, np.int32)
        self.codes[chars] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        step: dict[int, int] = {}
        piece = [-1]
        for i in plain:
            node = 0
            for c in names[i]:
                key = node * self.width + int(self.codes[ord(c)])
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                node = step[key]
            piece[node] = i
        self.keys = np.array(sorted(step), np.int32 if len(piece) * self.width < 1 << 31 else np.int64)
        self.next = np.array([step[k] for k in self.keys.tolist()], self.keys.dtype)
        self.piece = np.array(piece, np.int32)
        self.table = np.zeros((len(piece), FREQUENT), self.keys.dtype)
        some = self.keys % self.width < FREQUENT
        self.table[self.keys[some] // self.width, self.keys[some] % self.width] = self.next[some]
        self.inner = np.zeros(len(piece), bool)  # nodes with children
        self.inner[self.keys // self.width] = True
        self.root = np.zeros(self.width, self.keys.dtype)  # the root's children, by character
        at_root = self.keys < self.width
        self.root[self.keys[at_root]] = self.next[at_root]
        self.longest = max(len(names[i]) for i in plain)


@lru_cache(maxsize=2)
def loaded(proto: bytes, alpha: float) -> Model:
    return Model(proto, alpha)


class Lattice:
    """All segmentations of some units. States are character positions, each unit with one more at its end; edges are sorted by their
    start. ``logq`` is an edge's log-probability given its start, ``upto`` its upper end in the start's cumulative share."""

    def __init__(self, model: Model, units: list[str]) -> None:
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        self.first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64) if units else np.zeros(0, np.int64)
        states = int((lengths + 1).sum())
        text = np.frombuffer("\0".join([*units, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = self.first + lengths
        end_of = np.repeat(ends, lengths + 1)
        inside = np.ones(states, bool)
        inside[ends] = False
        code = model.codes[text]
        at = np.flatnonzero(inside)
        node = np.zeros(len(at), np.int64)
        starts, nexts, pieces = [], [], []
        single = np.zeros(states, bool)
        for n in range(model.longest):
            ok = at + n < end_of[at]
            at, node = at[ok], node[ok]
            if not len(at):
                break
            if n == 0:
                node = model.root[code[at]]
                ok = node > 0
                at, node = at[ok], node[ok]
            else:
                c = code[at + n]
                rare = np.flatnonzero(c >= FREQUENT)
                after = model.table[node, np.where(c < FREQUENT, c, 0)]
                if len(rare):
                    key = node[rare] * model.width + c[rare]
                    found = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
                    after[rare] = np.where(model.keys[found] == key, model.next[found], 0)
                ok = after > 0
                at, node = at[ok], after[ok]
            piece = model.piece[node]
            has = piece >= 0
            starts.append(at[has])
            nexts.append(at[has] + n + 1)
            pieces.append(piece[has])
            if n == 0:
                single[at[has]] = True
            more = model.inner[node]
            at, node = at[more], node[more]
        lone = np.flatnonzero(inside & ~single)
        starts.append(lone)
        nexts.append(lone + 1)
        pieces.append(np.full(len(lone), -1))
        start, nxt, piece = (np.concatenate(x[::-1]) for x in (starts, nexts, pieces))  # a start's longest piece comes first, as most draws take it
        order = np.argsort(start, kind="stable")
        start, nxt, piece = start[order], nxt[order], piece[order].astype(np.int32)
        self.many: list[np.ndarray] = []  # ids of the bytes of characters without a piece; edge piece -1 is the first of them
        weight = np.where(piece >= 0, model.weight[piece], 0.0)
        for e in np.flatnonzero(piece < 0).tolist():
            raw = (SPACE if text[start[e]] == ord(HELD) else chr(text[start[e]])).encode("utf-8", "surrogatepass")
            weight[e] = model.byte_weight * len(raw)
            if len(raw) == 1:
                piece[e] = model.byte_id[raw[0]]
            else:
                self.many.append(model.byte_id[list(raw)])
                piece[e] = -len(self.many)
        self.high = np.cumsum(np.bincount(start, minlength=states))
        self.low = np.concatenate(([0], self.high[:-1])) if states else self.high.copy()
        # Backward pass, all units in step: first the states one character before an end, then two, ...
        beta = np.zeros(states)
        left = end_of[start] - start
        by_left = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")  # short numbers are sorted by radix
        cuts = np.searchsorted(left[by_left], np.arange(1, int(left.max(initial=0)) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            e = by_left[a:b]
            if not len(e):
                continue
            value = weight[e] + beta[nxt[e]]
            heads = np.flatnonzero(np.concatenate(([True], start[e][1:] != start[e][:-1])))
            top = np.maximum.reduceat(value, heads)
            counts = np.diff(np.append(heads, len(e)))
            beta[start[e][heads]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, counts)), heads))
        logq = np.minimum(weight + beta[nxt] - beta[start], 0.0)
        self.start, self.next, self.logq, self.piece = start, nxt, logq, piece
        self.alone = (self.high - self.low)[start] == 1
        self.logq[self.alone] = 0.0
        total = np.cumsum(np.exp(self.logq))
        before = np.where(self.low > 0, total[np.maximum(self.low - 1, 0)], 0.0)[start] if len(start) else total
        self.upto = total - before
        self.upto[self.high[inside] - 1] = np.inf

    def ids(self, edges: np.ndarray) -> np.ndarray:
        """Piece ids of a path."""
        out = self.piece[edges]
        several = np.flatnonzero(out < 0)
        if not len(several):
            return out
        parts = np.split(out, several)
        return np.concatenate([parts[0], *(x for p in parts[1:] for x in (self.many[-p[0] - 1], p[1:]))]).astype(np.int32)

    def descend(self, state: np.ndarray, key: np.ndarray, draw: int, step: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
        """From each state to its unit's end: the numbers of the states given and the edges drawn, in order."""
        who, edges = [], []
        now = np.arange(len(state))
        at, n = state.copy(), np.broadcast_to(np.asarray(step), state.shape).copy()
        while True:
            go = self.high[at] > self.low[at]
            now, at, n = now[go], at[go], n[go]
            if not len(now):
                break
            u = uniform(key[now], draw, n)
            e = self.low[at]
            beyond = np.flatnonzero(u >= self.upto[e])
            while len(beyond):
                e[beyond] += 1
                beyond = beyond[u[beyond] >= self.upto[e[beyond]]]
            who.append(now)
            edges.append(e)
            at, n = self.next[e], n + 1
        if not who:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        who_, edges_ = np.concatenate(who), np.concatenate(edges)
        order = np.argsort(who_, kind="stable")
        return who_[order], edges_[order]


class Units:
    """The lattice of the units that a task meets. Those of its first batches, up to ``EDGES`` edges, stay, as frequent ones are among them; later ones are built for
    their batch. Arrays grow in place."""

    PARTS = ("first", "start", "next", "low", "high", "logq", "upto", "piece", "alone")

    def __init__(self, model: Model) -> None:
        self.model, self.lattice = model, Lattice(model, [])
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.room = {name: getattr(self.lattice, name) for name in self.PARTS}
        self.kept = (0, 0, 0, 0)  # units, states, edges and byte runs that stay

    def places(self, texts: list[list[str]]) -> list[list[int]]:
        """For each text, given as units, the numbers of its units in ``lattice``."""
        lat, index = self.lattice, self.index
        if len(index) > self.kept[0]:
            for u in list(islice(index, self.kept[0], None)):
                del index[u]
            self.cut(*self.kept)
        numbers = [list(map(index.__getitem__, t)) for t in texts]
        if len(index) > self.kept[0]:
            states, edges = len(lat.low), len(lat.start)
            new = Lattice(self.model, list(islice(index, self.kept[0], None)))
            new.first, new.start, new.next = new.first + states, new.start + states, new.next + states
            new.low, new.high = new.low + edges, new.high + edges
            new.piece = np.where(new.piece < 0, new.piece - len(lat.many), new.piece)
            for name in self.PARTS:
                self.put(name, len(getattr(lat, name)), getattr(new, name))
            lat.many += new.many
            if len(lat.start) <= EDGES:
                self.kept = (len(index), len(lat.low), len(lat.start), len(lat.many))
        return numbers

    def put(self, name: str, n: int, more: np.ndarray) -> None:
        held = self.room[name]
        if n + len(more) > len(held):
            self.room[name] = np.empty(max(n + len(more), n * 3 // 2), more.dtype)
            self.room[name][:n] = held[:n]
        self.room[name][n : n + len(more)] = more
        setattr(self.lattice, name, self.room[name][: n + len(more)])

    def cut(self, units: int, states: int, edges: int, runs: int) -> None:
        for name in self.PARTS:
            n = units if name == "first" else states if name in ("low", "high") else edges
            setattr(self.lattice, name, self.room[name][:n])
        del self.lattice.many[runs:]


class Path:
    __slots__ = ("edges", "unit", "value", "before", "logp", "perturbed")

    def __init__(self, edges, unit, value, before, logp, perturbed) -> None:  # noqa: ANN001
        self.edges, self.unit, self.value, self.before, self.logp, self.perturbed = edges, unit, value, before, logp, perturbed


def logless(logq: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """log(1 - q); nothing is left where there is one edge."""
    with np.errstate(divide="ignore"):
        return np.where(alone, -np.inf, np.log(-np.expm1(np.minimum(logq, -1e-300))))


def sample(model: Model, texts: list[str], keys: np.ndarray, k: int, units: Units | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text, its draws: piece ids, log-probability, perturbed value, inclusion probability."""
    units = units or Units(model)
    per = units.places([UNIT.findall(SPACE + t.replace(SPACE, HELD).replace(" ", SPACE)) if t else [] for t in texts])
    counts = np.fromiter(map(len, per), np.int64, len(per))
    lat = units.lattice
    first_unit = np.concatenate(([0], np.cumsum(counts)))
    unit_of = np.fromiter(chain.from_iterable(per), np.int64, int(counts.sum()))
    doc_of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(unit_of)) - first_unit[doc_of]
    with np.errstate(over="ignore"):
        unit_key = keys[doc_of] ^ ((place.astype(np.uint64) + np.uint64(1)) * MIX[0])
    gumbel = -np.log(-np.log(uniform(keys, 1 << 40)))
    begin = lat.first[unit_of] if len(unit_of) else np.zeros(0, np.int64)

    who, edges = lat.descend(begin, unit_key, 0)
    logq = lat.logq[edges]
    cuts = np.searchsorted(doc_of[who], np.arange(len(texts) + 1)) if len(who) else np.zeros(len(texts) + 1, np.int64)
    run = np.concatenate(([0.0], np.cumsum(logq)))
    before = run[:-1] - run[cuts[doc_of[who]]] if len(who) else logq
    rest = before + logless(logq, lat.alone[edges])
    value = truncated(rest, gumbel[doc_of[who]], uniform(unit_key[who], 1 << 41, np.arange(len(who)) - cuts[doc_of[who]])) if len(who) else rest
    paths = [[Path(edges[a:b], who[a:b], value[a:b], before[a:b], float(run[b] - run[a]), float(gumbel[d]))] for d, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist()))]
    taken: dict[tuple[int, int, int], list[int]] = {}  # edges that have left a node
    for draw in range(1, k):
        moves = []
        for d, own in enumerate(paths):
            tops = [(float(p.value[i]), n, i) for n, p in enumerate(own) if len(p.value) and np.isfinite(p.value[i := int(p.value.argmax())])]
            if not tops or len(own) < draw:
                continue
            top, n, i = max(tops, key=lambda x: x[0])
            p = own[n]
            gone = taken.setdefault((d, n, i), [int(p.edges[i])])
            s = int(lat.start[p.edges[i]])
            rest_of = np.array([e for e in range(int(lat.low[s]), int(lat.high[s])) if e not in gone])
            share = np.exp(lat.logq[rest_of])
            u = float(uniform(int(keys[d]), draw, i, 1 << 42))
            chosen = int(rest_of[min(int(np.searchsorted(np.cumsum(share), u * share.sum(), side="right")), len(rest_of) - 1)])
            gone.append(chosen)
            others = float(share[rest_of != chosen].sum())
            place_of = p.before[i] + np.log(others) if others > 0 else -np.inf
            p.value[i] = float(truncated(np.array(place_of), np.array(top), uniform(int(keys[d]), draw, i, 1 << 43)))
            moves.append((d, n, i, chosen, top))
        if not moves:
            break
        spans, states, owner = [], [], []
        for m, (d, n, i, chosen, _) in enumerate(moves):
            u0 = int(paths[d][n].unit[i])
            span = np.arange(u0, first_unit[d + 1])
            spans.append(span)
            s = begin[span].copy()
            s[0] = lat.next[chosen]
            states.append(s)
            owner.append(np.full(len(span), m))
        run_of, states_, owner_ = np.concatenate(spans), np.concatenate(states), np.concatenate(owner)
        who, edges = lat.descend(states_, unit_key[run_of], draw)
        logq, of = lat.logq[edges], owner_[who]
        cuts = np.searchsorted(of, np.arange(len(moves) + 1))
        run = np.concatenate(([0.0], np.cumsum(logq)))
        heads = np.array([paths[d][n].before[i] + lat.logq[chosen] for d, n, i, chosen, _ in moves])
        tops_ = np.array([m[4] for m in moves])
        before = run[:-1] - run[cuts[of]] + heads[of] if len(who) else logq
        rest = before + logless(logq, lat.alone[edges])
        value = truncated(rest, tops_[of], uniform(unit_key[run_of[who]], 1 << 41, draw, np.arange(len(who)) - cuts[of])) if len(who) else rest
        for m, (d, n, i, chosen, top) in enumerate(moves):
            a, b = int(cuts[m]), int(cuts[m + 1])
            p = paths[d][n]
            paths[d].append(Path(
                np.concatenate([p.edges[:i], [chosen], edges[a:b]]), np.concatenate([p.unit[: i + 1], run_of[who[a:b]]]),
                np.concatenate([np.full(i + 1, -np.inf), value[a:b]]), np.concatenate([p.before[: i + 1], before[a:b]]),
                float(heads[m] + run[b] - run[a]), top,
            ))
    out = []
    for own in paths:
        kappa = max((float(p.value.max()) for p in own if len(p.value)), default=-np.inf)
        got = []
        for p in own:
            included = 1.0 if np.isneginf(kappa) else float(-np.expm1(-np.exp(min(p.logp - kappa, 50.0))))
            got.append((lat.ids(p.edges), p.logp, p.perturbed, included))
        out.append(got)
    return out


class LongPath:
    """A draw of a long text: its ids, and of the places where a later draw may leave it those with the largest values, as (value, edge number,
    log-probability before, unit number, characters into the unit, the edge's rank at its state, ids before)."""

    def __init__(self, perturbed: float, logp: float, ids: list[np.ndarray], edges: int) -> None:
        self.perturbed, self.logp, self.parts, self.edges = perturbed, logp, ids, edges
        self.n_ids = sum(map(len, ids))
        self.places: list[tuple] = []

    def grow(self, lat: Lattice, numbers: np.ndarray, states: np.ndarray, keys: np.ndarray, first: int, draw: int, top: float, keep: int, begun: int) -> None:
        """Goes on through some units, from the given states; ``begun`` edges came before this draw began."""
        who, edges = lat.descend(states, keys, draw)
        if not len(edges):
            return
        logq, alone = lat.logq[edges], lat.alone[edges]
        run = np.concatenate(([0.0], np.cumsum(logq)))
        before = self.logp + run[:-1]
        at = np.arange(self.edges, self.edges + len(edges))
        u = uniform(keys[who], 1 << 41, at) if not draw else uniform(keys[who], 1 << 41, draw, at - begun)
        value = truncated(before + logless(logq, alone), np.full(len(edges), top), u)
        sizes = np.ones(len(edges), np.int64)
        for e in np.flatnonzero(lat.piece[edges] < 0).tolist():
            sizes[e] = len(lat.many[-lat.piece[edges[e]] - 1])
        ids_before = self.n_ids + np.cumsum(sizes) - sizes
        for i in np.argsort(-value, kind="stable")[:keep].tolist():
            e, unit = int(edges[i]), int(who[i])
            s = int(lat.start[e])
            self.places.append((float(value[i]), int(at[i]), float(before[i]), first + unit, s - int(lat.first[numbers[unit]]), e - int(lat.low[s]), int(ids_before[i])))
        self.places = sorted(self.places, key=lambda x: (-x[0], x[1]))[:keep]
        self.parts.append(lat.ids(edges))
        self.n_ids += len(self.parts[-1])
        self.logp += float(run[-1])
        self.edges += len(edges)


def chunks(text: str, first: int, chars: int) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, units) of a text from unit ``first`` on, about ``chars`` characters at a time."""
    held, size, start = [], 0, first
    for n, m in enumerate(UNIT.finditer(text)):
        if n < first:
            continue
        held.append(m[0])
        size += len(m[0])
        if size >= chars:
            yield start, held
            held, size, start = [], 0, n + 1
    if held:
        yield start, held


def sample_long(model: Model, text: str, key: int, k: int, units: Units, chars: int = BATCH) -> list[tuple[np.ndarray, float, float, float]]:
    """The draws of ``sample`` for one text, worked a few units at a time. Ids and the best places to leave a path are all that is kept of a draw, so that memory is
    some bytes a character; a run without a space is worked whole."""
    whole = SPACE + text.replace(SPACE, HELD).replace(" ", SPACE)
    own = np.uint64(key)

    def unit_keys(first: int, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return own ^ ((np.arange(first, first + n, dtype=np.uint64) + np.uint64(1)) * MIX[0])

    top = float(-np.log(-np.log(uniform(np.array([own]), 1 << 40)))[0])
    paths = [LongPath(top, 0.0, [], 0)]
    for first, some in chunks(whole, 0, chars):
        numbers = np.array(units.places([some])[0])
        paths[0].grow(units.lattice, numbers, units.lattice.first[numbers], unit_keys(first, len(some)), first, 0, top, k, 0)
    taken: dict[tuple[int, int], list[int]] = {}
    for draw in range(1, k):
        options = [(p.places[0][0], n) for n, p in enumerate(paths) if p.places and np.isfinite(p.places[0][0])]
        if not options or len(paths) < draw:
            break
        top, n = max(options, key=lambda x: (x[0], -x[1]))
        p = paths[n]
        _, i, before, unit, into, rank, ids_before = p.places.pop(0)
        gone = taken.setdefault((n, i), [rank])
        new = None
        for first, some in chunks(whole, unit, chars):
            numbers = np.array(units.places([some])[0])
            lat, keys = units.lattice, unit_keys(first, len(some))
            states = lat.first[numbers].copy()
            if new is None:
                s = int(states[0]) + into
                low = int(lat.low[s])
                rest_of = np.array([r for r in range(int(lat.high[s]) - low) if r not in gone])
                share = np.exp(lat.logq[low + rest_of])
                u = float(uniform(int(own), draw, i, 1 << 42))
                chosen = int(rest_of[min(int(np.searchsorted(np.cumsum(share), u * share.sum(), side="right")), len(rest_of) - 1)])
                gone.append(chosen)
                others = float(share[rest_of != chosen].sum())
                left = before + np.log(others) if others > 0 else -np.inf
                p.places.append((float(truncated(np.array(left), np.array(top), uniform(int(own), draw, i, 1 << 43))), i, before, unit, into, rank, ids_before))
                p.places.sort(key=lambda x: (-x[0], x[1]))
                e = low + chosen
                kept = np.concatenate([*p.parts, np.zeros(0, np.int32)])[:ids_before]
                new = LongPath(top, before + float(lat.logq[e]), [kept, lat.ids(np.array([e]))], i + 1)
                states[0] = lat.next[e]
            new.grow(lat, numbers, states, keys, first, draw, top, k, i + 1)
        paths.append(new)
    kappa = max((p.places[0][0] for p in paths if p.places), default=-np.inf)
    out = []
    for p in paths:
        included = 1.0 if np.isneginf(kappa) else float(-np.expm1(-np.exp(min(p.logp - kappa, 50.0))))
        out.append((np.concatenate([*p.parts, np.zeros(0, np.int32)]).astype(np.int32), p.logp, p.perturbed, included))
    return out


def decode(model: Model, ids: np.ndarray) -> str:
    raw = b"".join(itemgetter(0, *ids.tolist())(model.bytes)[1:])
    return raw[1:].decode("utf-8", "surrogatepass")  # without the space put before the text


def row_key(key: object, seed: str) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{'' if key is None else key}")


def batches_of(b: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about BATCH characters each; a text of more than LONG has one of its own."""
    start, size = 0, 0
    for i, t in enumerate(b.column(1)):
        n = len(t.as_py() or "")
        if n > LONG and start < i:
            yield start, i
            start, size = i, 0
        size += n
        if size >= BATCH:
            yield start, i + 1
            start, size = i + 1, 0
    if start < b.num_rows:
        yield start, b.num_rows


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, k: int = 2, draw: Column | None = None, alpha: float = 1.0, seed: str = "pieces", model: str = MODEL, digest: bool = False) -> DataFrame:
    """doc_id, draw (from 1), n_pieces, log_prob, perturbed, inclusion, ``ids`` array<int> and ``round_trip``, whether they decode to the text; with ``digest`` instead of the ids
    ``ids_hash``, the XXH64 of them as little-endian 32-bit numbers. A row for each of ``k`` draws, or, with ``draw`` (from 1), each row's
    draw of that number alone: copies of a document so get segmentations of their own. Where there are fewer segmentations the last is taken."""
    lean(docs)
    with open(model, "rb") as f:
        proto = f.read()
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "draw", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_hash" if digest else "ids", "round_trip"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = loaded(proto, alpha)
        units = Units(m)
        for b in batches:
            for start, end in batches_of(b):
                part = b.slice(start, end - start)
                texts, own, asked = [t or "" for t in part.column(1).to_pylist()], part.column(0).to_pylist(), part.column(2).to_numpy(zero_copy_only=False)
                flat = []
                for n in np.unique(asked).tolist():
                    at = np.flatnonzero(asked == n)
                    keys = [row_key(own[i], seed) for i in at]
                    if len(at) == 1 and len(texts[at[0]]) > LONG:
                        got = [sample_long(m, texts[at[0]], keys[0], n or k, units)]
                    else:
                        got = sample(m, [texts[i] for i in at], np.array(keys, np.uint64), n or k, units)
                    flat += [(i, d + 1, *x) for i, draws in zip(at.tolist(), got) for d, x in enumerate(draws) if not n or d + 1 == min(n, len(draws))]
                flat.sort(key=lambda x: x[:2])
                cols = [part.column(0).take(pa.array([x[0] for x in flat], pa.int64())), pa.array([x[1] for x in flat], pa.int32()), pa.array([len(x[2]) for x in flat], pa.int64())]
                cols += [pa.array([x[j] for x in flat], pa.float64()) for j in (3, 4, 5)]
                if digest:
                    cols.append(pa.array([xxhash.xxh64_hexdigest(np.ascontiguousarray(x[2], "<i4").tobytes()) for x in flat], pa.string()))
                else:
                    offsets = np.concatenate(([0], np.cumsum([len(x[2]) for x in flat]))).astype(np.int32)
                    values = np.concatenate([x[2] for x in flat]).astype(np.int32) if flat else np.zeros(0, np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)))
                cols.append(pa.array([decode(m, x[2]) == texts[x[0]] for x in flat], pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, names)

    number = F.lit(0) if draw is None else F.greatest(F.coalesce(draw, F.lit(1)), F.lit(1))
    schema = f"doc_id {kind}, draw int, n_pieces long, log_prob double, perturbed double, inclusion double, {'ids_hash string' if digest else 'ids array<int>'}, round_trip boolean"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), number.cast("int").alias("draw")).mapInArrow(run, schema)


def decoded(encoded: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``encoded`` with a column ``text`` of what its ids stand for; null ids give null."""
    lean(encoded)
    with open(model, "rb") as f:
        proto = f.read()

    @F.pandas_udf("string")
    def run(rows):  # noqa: ANN001, ANN202
        m = loaded(proto, 1.0)
        return rows.map(lambda x: None if x is None else decode(m, np.asarray(x, np.int64)))

    return encoded.withColumn("text", run(F.col(ids)))
