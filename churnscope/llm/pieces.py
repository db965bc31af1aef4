"""SentencePiece encoding and decoding with sampling without replacement.

A text's segmentations into vocabulary pieces are the paths of a lattice; a
path weighs exp(sum of its pieces' scores / TEMPERATURE), normalised over all
paths.  ``sampled`` emits the k paths of the highest Gumbel-perturbed
log-probabilities: k distinct segmentations, drawn without replacement.  They
are found by A-star search over subspaces of paths, top down: the space's best
path is a plain sample, drawn forward with backward sums; it splits what is
left into the subspaces "same beginning, another piece at step t", each with a
Gumbel maximum truncated at its parent's; the subspace of the highest maximum
is popped next.  The highest maximum left after k pops is the threshold
``kappa``; a path's inclusion score is log P(perturbed value > kappa), so
exp(log_prob - inclusion) weighs it in estimates.

All random numbers are hashes of (seed, row key, place), so reruns agree.  No
piece holds a space mark after another character, so the lattice is a chain of
units (space marks and the characters up to the next one); a unit's lattice is
built once per slice of texts, for all its occurrences, and those of the units
that a task saw first and more than once stay until its end (``HELD`` nodes at most).
Characters without a piece are spelled in byte pieces, as one edge.  Draws
resolve chances to 2^-36; the subspaces of A-star are kept in logarithms, and
only empty ones are dropped, so k samples come wherever k segmentations exist.

The model's settings must be those that the lattice assumes (a dummy prefix,
white space kept, marks for spaces, characters as they are, byte fallback);
another vocabulary raises.

Defined cases: null and empty texts have one segmentation, of no pieces; a
text with fewer than k segmentations gives all of them (inclusion 0); a null
key is a key of its own; equal keys and texts give equal samples, one set per
row; the library's ``encode`` and ``decode`` are there for the best path and
for reading ids back.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnscope.llm import text as T

TEMPERATURE = 4_000.0
SLICE = 768 << 10
#: slices of that size after which freed memory goes back to the system; each time costs page faults
TRIMMED = 8
#: nodes of lattices that a task keeps, and the longest unit among them
HELD, LONG = 1_000_000, 64
#: nodes that are built at a time: arrays of so many stay in a processor's cache
BUILT = 50_000
#: bits of a chance in a draw
BITS = 36
#: a text on which a model's normalizer shows what it does
PROBE = "a  b\tc ﬁÅ １"
#: fixed value: scores below this mark pieces that the user set
UNSCORED = -1e8
_MARK = "▁"
_U = np.uint64


class Vocabulary:
    """Pieces of a SentencePiece model as hash tables over their bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        text = [lib.id_to_piece(i) for i in plain]
        if any(_MARK in t.lstrip(_MARK) for t in text):
            raise ValueError("a piece holds a space mark inside; units can't be cut there")
        if lib.normalize(PROBE) != _MARK + PROBE.replace(" ", _MARK):
            raise ValueError("the model changes white space or characters, or adds no dummy prefix")
        spelled = [t.encode() for t in text]
        flat = np.frombuffer(b"".join(spelled), np.uint8)
        ends = np.cumsum([len(s) for s in spelled])
        starts = ends - [len(s) for s in spelled]
        total, down = _sums(flat)
        hashes = (total[ends] - total[starts]) * down[starts]
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain, dtype=np.int32)[order]
        if len(np.unique(self.hashes)) < len(self.hashes):
            raise ValueError("two pieces share a hash")
        score = np.array([lib.get_score(i) for i in plain])
        lowest = score[score > UNSCORED].min(initial=0.0) - 1  # also for pieces that the model sets without a score
        self.weights = np.maximum(score, lowest)[order] / TEMPERATURE
        self.unknown = lowest / TEMPERATURE
        # bit 0: may begin a piece, bit 1: may be a piece
        self.maybe = np.zeros(1 << 21, dtype=np.uint8)
        for length in range(1, int((ends - starts).max(initial=0)) + 1):
            a = starts[ends - starts >= length]
            self.maybe[self._slot((total[a + length] - total[a]) * down[a])] = 1
        self.maybe[self._slot(self.hashes)] |= 2
        # the piece of each slot; the few pieces that share a slot are searched for
        self.piece = np.full(1 << 21, -1, dtype=np.int32)
        slot = self._slot(self.hashes)
        self.piece[slot] = np.arange(len(slot))
        lost = slot[self.piece[slot] != np.arange(len(slot))]
        self.maybe[lost] |= 4
        self.longest = max((len(s) for s in spelled), default=0)
        self.bytes = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.spelling = [b""] * n
        for i, s in zip(plain, spelled, strict=True):
            self.spelling[i] = s
        for b, i in enumerate(self.bytes):
            self.spelling[i] = bytes([b])
        # the same as one array, to spell many ids at once
        self.spelt = np.frombuffer(b"".join(self.spelling), np.uint8)
        self.size = np.array([len(s) for s in self.spelling], dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.forget()

    def forget(self) -> None:
        """Drops what a task holds: its lattice, the room behind that, and marks of the units it saw."""
        self.held: Lattice | None = None
        self.room: dict[str, np.ndarray] = {}
        self.seen = np.zeros(1 << 21, dtype=bool)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _U(0x9FB21C651E98DF25)) >> _U(43)).astype(np.int64)

    def find(self, h: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Places of the hashes, whose slots are given, among the pieces; -1 for none."""
        at = self.piece[slot]
        at = np.where(self.hashes[at] == h, at, -1)
        again = np.flatnonzero((at < 0) & (self.maybe[slot] & 4 != 0))
        if len(again):
            own = np.minimum(np.searchsorted(self.hashes, h[again]), len(self.hashes) - 1)
            at[again] = np.where(self.hashes[own] == h[again], own, -1)
        return at

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that a sequence of ids spells, space marks included."""
        size = self.size[ids]
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, dtype=np.uint8)
        return self.spelt[np.repeat(self.begin[ids] - ends + size, size) + np.arange(ends[-1])]

    def decode(self, ids: list[int]) -> str:
        """The text of a sequence of ids, as the library decodes it."""
        text = b"".join([self.spelling[i] for i in ids]).decode("utf-8", "replace").replace(_MARK, " ")
        return text[1:] if text.startswith(" ") else text


def _times(a: int, b: int) -> np.uint64:
    return _U(a * b & 0xFFFFFFFFFFFFFFFF)


def _sums(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(flat)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(_SPELL[flat] * T.power("up", n), out=total[1:])
    return total, T.power("down", n + 1)


_SPELL = T.mix(np.arange(1, 257, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))  # unlike the word hashes, keeps case

_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker and file."""
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


_WIDTH = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16)  # bytes of a character, by its first one


def _first_of(runs: np.ndarray) -> np.ndarray:
    """Places where a new value begins in an array of runs."""
    return np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]])) if len(runs) else np.zeros(0, dtype=np.int64)


class Lattice:
    """The lattices of a set of units; nodes are byte positions, edges are pieces.

    ``start[u]`` and ``end[u]`` are a unit's first and last node.  ``first[v]``
    counts the edges before node v.  Per edge: ``to``, ``place`` (piece, or -1
    for a spelled character), ``log_p`` (given its node), ``log_rest`` (of the
    node's other edges) and ``cut``, the sum of chances up to it in BITS bits
    below the node's number.  Per node: its likeliest edge, that one's chance
    and what lies before it, so that most draws need no search.  ``hashes``
    name the units.  Nothing of a unit depends on the others in the set but its
    places, so joined lattices give the same draws.
    """

    #: the hashes' order and the hashes in it, once they are looked up
    order: np.ndarray | None = None
    sorted: np.ndarray | None = None

    def __init__(self, vocab: Vocabulary, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray,
                 sums: tuple[np.ndarray, np.ndarray]):
        """``sums`` are those of ``flat``."""
        self.vocab, size, self.hashes = vocab, ends - starts, hashes
        # nodes: the bytes of each unit and one more for its end
        self.start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        self.end = self.start + size
        nodes = int(self.end[-1]) + 1
        unit = np.repeat(np.arange(len(size)), size)
        inside = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
        at = starts[unit] + inside  # byte in flat
        node = self.start[unit] + inside
        self.byte = np.zeros(nodes, dtype=np.uint8)
        self.byte[node] = flat[at]
        total, down = sums
        heads = np.flatnonzero((flat[at] & 0xC0) != 0x80)  # first bytes of characters
        left, at, node = (size[unit] - inside)[heads], at[heads], node[heads]
        width = _WIDTH[flat[at]]
        low, to, place = [], [], []
        known = np.zeros(nodes, dtype=bool)
        ok = left, at, node, total[at], down[at], width  # of the places where a piece may still go on
        for length in range(1, vocab.longest + 1):
            if not len(ok[0]):
                break
            h = (total[ok[1] + length] - ok[3]) * ok[4]
            slot = vocab._slot(h)
            kind = vocab.maybe[slot]
            hit = np.flatnonzero(kind & 2)
            found = vocab.find(h[hit], slot[hit])
            hit, found = hit[found >= 0], found[found >= 0]
            begins = ok[2][hit]
            low.append(begins)
            to.append(begins + length)
            place.append(found)
            if length <= 4:
                known[begins[ok[5][hit] == length]] = True
            on = np.flatnonzero((kind & 1 != 0) & (ok[0] > length))
            ok = tuple(x[on] for x in ok)
        # a character without a piece is one edge over its bytes
        lone = np.flatnonzero(~known[node])
        low.append(node[lone])
        to.append(node[lone] + np.minimum(width[lone], left[lone]))
        place.append(np.full(len(lone), -1))
        low, to, place = (np.concatenate(x) for x in (low, to, place))
        order = np.argsort(low, kind="stable")
        low, self.to, self.place = low[order], to[order].astype(np.int32), place[order].astype(np.int32)
        weight = np.where(self.place >= 0, vocab.weights[self.place], vocab.unknown)
        own = _first_of(low)  # first edge of each node that has some
        degree = np.diff(np.append(own, len(low)))
        with_edges = np.zeros(nodes + 1, dtype=np.int64)
        with_edges[low[own] + 1] = 1
        self.first = np.append(own, len(low))[np.cumsum(with_edges)].astype(np.int32)
        # backward sums, by distance of a node to its unit's end
        beta = np.zeros(nodes)
        gap = (np.repeat(self.end, size + 1) - np.arange(nodes))[low[own]]
        by_gap = np.argsort(gap.astype(np.uint16) if gap.max() < 1 << 16 else gap, kind="stable")  # short ones sort faster
        cuts = np.append(_first_of(gap[by_gap]), len(by_gap))
        degrees, nodes_of = degree[by_gap], low[own[by_gap]]
        begins = np.concatenate([[0], np.cumsum(degrees)])
        e = np.repeat(own[by_gap] - begins[:-1], degrees) + np.arange(len(low))  # all edges, the nodes in that order
        weights, tos = weight[e], self.to[e]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # nodes of one distance
            at_edge, to_edge = int(begins[a]), int(begins[b])
            s = weights[at_edge:to_edge] + beta[tos[at_edge:to_edge]]
            begin = begins[a:b] - at_edge
            top = np.maximum.reduceat(s, begin)
            beta[nodes_of[a:b]] = top + np.log(np.add.reduceat(np.exp(s - np.repeat(top, degrees[a:b])), begin))
        self.log_p = weight + beta[self.to] - beta[low]
        alone = np.repeat(degree == 1, degree)
        self.log_p[alone] = 0.0
        p = np.exp(self.log_p)
        run = np.cumsum(p)
        before = np.maximum(run - p - np.repeat((run - p)[own], degree), 0)
        self.cut = (low << BITS) + (np.minimum(before + p, 1.0) * (1 << BITS)).astype(np.int64)
        last = np.append(own[1:], len(low)) - 1
        self.cut[last] = (low[last] + 1) << BITS
        best = np.maximum.reduceat(p, own)
        is_best = np.flatnonzero(p == np.repeat(best, degree))
        chosen = is_best[_first_of(low[is_best])]
        # the rest of the likeliest edge is summed, as 1 - p would lose small ones
        others = p.copy()
        others[chosen] = 0
        rest = 1 - p
        rest[chosen] = np.add.reduceat(others, own)
        with np.errstate(divide="ignore"):
            self.log_rest = np.where(alone, -np.inf, np.log(np.maximum(rest, 0)))
        self.best, self.chance, self.ahead = np.zeros(nodes, dtype=np.int32), np.zeros(nodes), np.zeros(nodes)
        self.best[low[chosen]], self.chance[low[chosen]], self.ahead[low[chosen]] = chosen, p[chosen], before[chosen]

    def joined(self, others: list[Lattice]) -> Lattice:
        """All sets of units as one, this one's first.

        The vocabulary has room behind the arrays of the lattice that the task
        holds: the others' are written there, over those of the slice before,
        and this one's stay where they are.
        """
        both, room = object.__new__(Lattice), self.vocab.room
        both.vocab = self.vocab
        nodes = len(self.byte) + np.cumsum([0, *(len(x.byte) for x in others)])
        edges = len(self.to) + np.cumsum([0, *(len(x.to) for x in others)])
        none = np.zeros(len(nodes), dtype=np.int64)
        for name, by in (("hashes", none), ("byte", none), ("place", none), ("log_p", none), ("log_rest", none), ("chance", none),
                         ("ahead", none), ("start", nodes), ("end", nodes), ("to", nodes), ("best", edges), ("cut", nodes << BITS),
                         ("first", edges)):
            mine, last = getattr(self, name), int(name == "first")  # its last entry is the next one's first
            size = len(mine) + sum(len(getattr(x, name)) - last for x in others)
            if size > len(room.get(name, ())) or mine.base is not room[name]:
                room[name] = np.empty(2 * size, dtype=mine.dtype)
                room[name][:len(mine)] = mine
                setattr(self, name, room[name][:len(mine)])
            at = len(mine) - last
            for other, more in zip(others, by, strict=False):
                own = getattr(other, name)
                np.add(own, own.dtype.type(more), out=room[name][at:at + len(own)], casting="unsafe")
                at += len(own) - last
            setattr(both, name, room[name][:size])
        return both

    def draw(self, node: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Completes each walker from its node to its unit's end: (walker, edge) in walker and step order."""
        who, edges = [], []
        active = np.flatnonzero(node < end)
        node, key, end = node[active], key[active], end[active]
        step = 0
        while len(active):
            u = T.uniform(key + _times(0x9E3779B97F4A7C15, step + 1))
            edge, chance = self.best[node], self.chance[node]
            other = np.flatnonzero(u >= chance)
            if len(other):  # the likeliest edge's interval is taken out of the node's
                v = node[other]
                x = u[other] - chance[other]
                x = np.where(x < self.ahead[v], x, x + chance[other])
                x = (v.astype(np.int64) << BITS) + (x * (1 << BITS)).astype(np.int64)
                e, last = self.first[v], self.first[v + 1] - 1
                on = np.flatnonzero(e < last)
                while len(on):  # a node has few edges: step by step is less than a search among all
                    on = on[x[on] >= self.cut[e[on]]]
                    e[on] += 1
                    on = on[e[on] < last[on]]
                edge[other] = e
            who.append(active)
            edges.append(edge)
            node = self.to[edge]
            go = np.flatnonzero(node < end)
            active, node, key, end = active[go], node[go], key[go], end[go]
            step += 1
        if not who:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        # walkers leave as they end: place each step behind its walker's earlier ones
        steps = np.zeros(int(who[0][-1]) + 1, dtype=np.int64)
        for w in who:
            steps[w] += 1
        begin = np.cumsum(steps) - steps
        out_who, out = np.repeat(np.arange(len(steps)), steps), np.empty(int(steps.sum()), dtype=np.int64)
        for i, (w, e) in enumerate(zip(who, edges, strict=True)):
            out[begin[w] + i] = e
        return out_who, out

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, ids before each edge and at the end) of paths."""
        place = self.place[edges]
        found = self.vocab.ids[place]
        odd = np.flatnonzero(place < 0)
        if not len(odd):
            return found, np.arange(len(edges) + 1)
        begins = np.searchsorted(self.first, edges[odd].astype(self.first.dtype), "right") - 1  # the edges' nodes
        many = np.ones(len(edges), dtype=np.int64)
        many[odd] = self.to[edges[odd]] - begins
        found = np.repeat(found, many)
        ends = np.concatenate([[0], np.cumsum(many)])
        spelt = many[odd]
        inside = np.arange(spelt.sum()) - np.repeat(np.cumsum(spelt) - spelt, spelt)
        found[np.repeat(ends[odd], spelt) + inside] = self.vocab.bytes[self.byte[np.repeat(begins, spelt) + inside]]
        return found, ends


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


def _truncated(location: np.ndarray, most, u: np.ndarray) -> np.ndarray:
    """Gumbel maxima at ``location`` given that they lie below ``most``."""
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        g = location - np.log(np.exp(np.minimum(location - most, 700)) - np.log(u))
    return np.where(np.isneginf(location), -np.inf, np.minimum(g, most))


class _Layer:
    """One path of each of some texts, end to end, and the subspaces that branch off them."""

    def __init__(self, lattice: Lattice, edges: np.ndarray, unit: np.ndarray, text: np.ndarray, cuts: np.ndarray,
                 value: np.ndarray, branch: np.ndarray, key: np.ndarray):
        """Path j, of text[j], has steps cuts[j]:cuts[j + 1]; it branched off another before its step branch[j]."""
        self.edges, self.unit, self.text, self.cuts, self.value = edges, unit, text, cuts, value
        many = np.diff(cuts)
        chances = lattice.log_p[edges]
        run = np.concatenate([[0.0], np.cumsum(chances)])
        step = np.arange(len(edges)) - np.repeat(cuts[:-1], many)
        self.before = run[:-1] - np.repeat(run[cuts[:-1]], many)  # log chance of the steps before
        self.log_p = run[cuts[1:]] - run[cuts[:-1]]
        u = T.uniform(np.repeat(key, many) + _U(0xD1B54A32D192ED03) * (step + 1).astype(_U))
        self.bound = _truncated(self.before + lattice.log_rest[edges], np.repeat(value, many), u)
        self.bound[step < np.repeat(branch, many)] = -np.inf  # those belong to the path it branched off

    def best(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text (of n): the highest bound of its path here, and that one's place."""
        value, place = np.full(n, -np.inf), np.full(n, -1)
        full = np.flatnonzero(np.diff(self.cuts))
        if len(full):
            many = np.diff(self.cuts)[full]
            top = np.maximum.reduceat(self.bound, self.cuts[:-1][full])
            at = np.flatnonzero(self.bound == np.repeat(top, many))
            at = at[_first_of(np.searchsorted(self.cuts, at, "right"))]
            value[self.text[full]], place[self.text[full]] = top, at
        return value, place


def _lattice(vocab: Vocabulary, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray,
             many: np.ndarray, sums: tuple[np.ndarray, np.ndarray]) -> tuple[Lattice, np.ndarray]:
    """A lattice of the distinct units, and each one's place there.

    While the lattice that the task holds has room, the units that the slice holds
    more than once, or that slices before had too, go into it; the others' is
    joined for this slice alone.  ``BUILT`` nodes are built at a time.
    """
    def known(lattice: Lattice) -> np.ndarray:
        if lattice.order is None:  # the one that the task holds is asked for each slice
            lattice.order = np.argsort(lattice.hashes)
            lattice.sorted = lattice.hashes[lattice.order]
        at = np.minimum(np.searchsorted(lattice.sorted, hashes), len(lattice.order) - 1)
        return np.where(lattice.sorted[at] == hashes, lattice.order[at], -1)

    def with_units(lattice: Lattice | None, of: np.ndarray) -> Lattice:
        part = np.cumsum(ends[of] - starts[of] + 1) // BUILT
        parts = [Lattice(vocab, flat, starts[x], ends[x], hashes[x], sums) for x in np.split(of, _first_of(part)[1:])]
        return parts[0].joined(parts[1:]) if lattice is None else lattice.joined(parts)

    if vocab.held is None or len(vocab.held.byte) < HELD:
        place = known(vocab.held) if vocab.held is not None else np.full(len(hashes), -1)
        room = HELD - (len(vocab.held.byte) if vocab.held is not None else 0)
        slot = vocab._slot(hashes)
        new = np.flatnonzero((place < 0) & ((many > 1) | vocab.seen[slot]) & (ends - starts <= LONG))
        new = new[np.cumsum(ends[new] - starts[new] + 1) <= room]
        vocab.seen[slot] = True
        if len(new):
            vocab.held = with_units(vocab.held, new)
    if vocab.held is None:
        return with_units(None, np.arange(len(hashes))), np.arange(len(hashes))
    place = known(vocab.held)
    rest = np.flatnonzero(place < 0)
    if not len(rest):
        return vocab.held, place
    place[rest] = len(vocab.held.hashes) + np.arange(len(rest))
    return with_units(vocab.held, rest), place


def sample_texts(vocab: Vocabulary, texts: list[str | None], keys: np.ndarray, k: int, seed: int = 0,
                 ) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to k samples (ids, log_prob, perturbed value, inclusion), best first; keys are 64-bit."""
    spelled = [(_MARK + t.replace(" ", _MARK)).encode("utf-8", "replace") if t else b"" for t in texts]
    flat = np.frombuffer(b"".join(spelled), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
    n, n_texts = len(flat), len(texts)
    if not n:
        return [[(np.zeros(0, dtype=np.int64), 0.0, 0.0, 0.0)] for _ in texts]
    mark = np.zeros(n + 3, dtype=bool)
    mark[3:n + 1] = (flat[:-2] == 0xE2) & (flat[1:-1] == 0x96) & (flat[2:] == 0x81)  # shifted by 3
    begin = mark[3:] & ~mark[:-3]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], n)
    total, down = _sums(flat)
    hashes, example, unit, many = np.unique((total[ends] - total[starts]) * down[starts], return_index=True, return_inverse=True,
                                            return_counts=True)
    del mark, begin, spelled
    lattice, place = _lattice(vocab, flat, starts[example], ends[example], hashes, many, (total, down))
    unit = place[unit]
    bounds = np.searchsorted(starts, offsets)  # units of each text
    del flat, starts, ends, example, total, down
    rows = np.repeat(np.arange(n_texts), np.diff(bounds))
    base = T.mix(keys ^ T.mix(np.array([seed + 1], dtype=_U))[0])
    place = (np.arange(len(unit)) - bounds[rows]).astype(_U) * _U(0xA24BAED4963EE407)

    def draw(node: np.ndarray, at: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        key = T.mix(T.mix(base + _times(0x8CB92BA72F3D8DD7, turn))[rows[at]] + place[at])
        return lattice.draw(node, lattice.end[unit[at]], key)

    who, edge = draw(lattice.start[unit], np.arange(len(unit)), 0)
    cuts = np.searchsorted(rows[who], np.arange(n_texts + 1))
    layers = [_Layer(lattice, edge, who, np.arange(n_texts), cuts, _gumbel(T.uniform(base + _U(1))),
                     np.zeros(n_texts, dtype=np.int64), T.mix(base + _U(2)))]
    taken: dict[tuple[int, int], list[int]] = {}  # (layer, place) -> edges that paths went there
    for turn in range(1, k + 1):
        found = [layer.best(n_texts) for layer in layers]
        value = np.max([f[0] for f in found], axis=0)
        of = np.argmax([f[0] for f in found], axis=0)
        if turn == k:
            kappa = value
            break
        todo, edges, units, nodes, ats, branch = np.flatnonzero(~np.isneginf(value)), [], [], [], [], []
        if not len(todo):
            kappa = value
            break
        u = T.uniform(base + _times(0x632BE59BD9B4E019, turn))
        again = T.uniform(base + _times(0xE7037ED1A0B428DB, turn))
        for i in todo.tolist():
            layer = layers[of[i]]
            t = int(found[of[i]][1][i])
            e = int(layer.edges[t])
            here = int(np.searchsorted(lattice.first, np.int32(e), "right")) - 1  # the edge's node
            gone = taken.setdefault((int(of[i]), t), [e])
            choice = [x for x in range(lattice.first[here], lattice.first[here + 1]) if x not in gone]
            run = np.cumsum(np.exp(lattice.log_p[choice] - lattice.log_p[choice].max()))
            j = min(len(choice) - 1, int(np.searchsorted(run, u[i] * run[-1])))
            gone.append(choice[j])
            left = np.delete(lattice.log_p[choice], j)
            layer.bound[t] = -np.inf
            if len(left):
                rest = left.max() + np.log(np.exp(left - left.max()).sum())
                layer.bound[t] = _truncated(layer.before[t:t + 1] + rest, value[i], again[i:i + 1])[0]
            low = layer.cuts[np.searchsorted(layer.text, i)]
            at, last = int(layer.unit[t]), bounds[i + 1]
            edges.append((layer.edges[low:t], choice[j]))
            units.append(layer.unit[low:t + 1])
            branch.append(t - low + 1)
            nodes += [lattice.to[choice[j]:choice[j] + 1], lattice.start[unit[at + 1:last]]]
            ats.append(np.arange(at, last))
        at = np.concatenate(ats)
        who, edge = draw(np.concatenate(nodes), at, turn)
        cut = np.searchsorted(who, np.concatenate([[0], np.cumsum([len(a) for a in ats])]))
        parts = [x for j, (old, pick) in enumerate(edges) for x in (old, [pick], edge[cut[j]:cut[j + 1]])]
        own = [x for j, old in enumerate(units) for x in (old, at[who[cut[j]:cut[j + 1]]])]
        many = np.array(branch) + np.diff(cut)
        layers.append(_Layer(lattice, np.concatenate(parts).astype(np.int64), np.concatenate(own), todo,
                             np.concatenate([[0], np.cumsum(many)]), value[todo], np.array(branch),
                             T.mix(base[todo] + _times(0xD6E8FEB86659FD93, turn + 2))))
    out: list[list] = [[] for _ in texts]
    for layer in layers:
        ids, before = lattice.ids(layer.edges)
        cut = before[layer.cuts]
        with np.errstate(divide="ignore", over="ignore"):
            score = np.log(-np.expm1(-np.exp(np.minimum(layer.log_p - kappa[layer.text], 700))))
        # for chances far below the threshold 1 - exp(-x) is x
        gap = layer.log_p - kappa[layer.text]
        score = np.where(gap < -30, gap, score)
        for j, i in enumerate(layer.text.tolist()):
            out[i].append((ids[cut[j]:cut[j + 1]], float(layer.log_p[j]), float(layer.value[j]), float(score[j])))
    return out


SAMPLES = "key long, rank int, ids array<int>, log_prob double, perturbed double, inclusion double"


def sampled(docs: DataFrame, key: str, text: str, path: str, k: int = 2, seed: int = 0, keep=None, also=(), draw: Column | None = None,
            at_once: int = SLICE) -> DataFrame:
    """Per row up to k sampled segmentations (``SAMPLES``), ranked from 1.

    ``keep(vocab, text, ids)`` may turn the ids into a struct of what is
    needed of them, declared by its attribute ``schema``; then no ids leave
    the task.  Columns named in ``also`` follow as they are.  Rows of one key
    draw the same random numbers unless ``draw`` (a long) tells them apart.
    ``at_once`` bytes of text are worked on together; a worker's memory grows
    with it, and the samples do not depend on it (their values only in the
    last digits).
    """
    shape = SAMPLES if keep is None else SAMPLES.replace("ids array<int>", keep.schema)
    names = [c.split()[0] for c in shape.split(", ")]
    given = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"),
                        (F.col(key) if draw is None else draw).cast("long").alias("draw"), *also)

    def packed(values: tuple) -> pa.Array:
        if not isinstance(values[0], np.ndarray):
            return pa.array(values)
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, done = vocabulary(path), 0
        for b in batches:
            column = T.as_strings(b.column(1))
            for at, part in T.slices(column, at_once):
                own, drawn = (b.column(c).slice(at, len(part)) for c in (0, 2))
                texts = part.to_pylist()
                hashed = np.where(drawn.is_null().to_numpy(zero_copy_only=False), _U(0x51ED270B), T.mix(
                    drawn.fill_null(0).to_numpy().astype(np.int64).view(_U)))
                rows, of = [], []
                for i, (key_, t, found) in enumerate(zip(own.to_pylist(), texts, sample_texts(vocab, texts, hashed, k, seed), strict=True)):
                    for rank, (ids, log_p, value, inclusion) in enumerate(found, 1):
                        held = (ids,) if keep is None else keep(vocab, t, ids, rank)
                        rows.append((key_, rank, *held, log_p, value, inclusion))
                        of.append(at + i)
                for i in range(0, len(rows), 2_000):
                    rest = [c.take(pa.array(of[i:i + 2_000])) for c in b.columns[3:]]
                    yield pa.RecordBatch.from_arrays([packed(c) for c in zip(*rows[i:i + 2_000], strict=True)] + rest, [*names, *also])
                rows = found = ids = held = texts = None
                done += 1
                if done % max(1, TRIMMED * SLICE // at_once) == 0:
                    trim()
        vocab.forget()  # the worker lives on, for tasks of other stages too
        T.release()

    from pyspark.sql.types import StructType

    def trim() -> None:
        """Gives the freed arrays of slices back to the system, where the C library can."""
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)

    arrow_types = {"key": pa.int64(), "rank": pa.int32(), "ids": pa.list_(pa.int32())}
    schema = StructType(StructType.fromDDL(shape).fields + given.schema.fields[3:])

    def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
        types = [arrow_types.get(f) or wanted[c.split()[1]] for f, c in zip(names, shape.split(", "), strict=True)]
        for b in run(batches):
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.columns, types)] + b.columns[len(types):], [*names, *also])

    return given.mapInArrow(typed, schema).withColumnRenamed("key", key)


def digest(vocab: Vocabulary, text: str, ids: np.ndarray, rank: int) -> tuple:
    """Number of pieces, a digest of the ids, and whether decoding them gives the text back."""
    import hashlib

    # the ids must spell the text's bytes, with marks for its spaces; a mark of the text's own reads as a space
    want = (_MARK + text.replace(" ", _MARK)).encode("utf-8", "replace") if text else b""
    back = vocab.spell(ids).tobytes() == want and _MARK not in (text or "")
    return len(ids), hashlib.blake2b(ids.astype("<i4").tobytes(), digest_size=16).hexdigest(), back


digest.schema = "n_pieces int, ids_digest string, round_trip boolean"


def checked(vocab: Vocabulary, text: str, ids: np.ndarray, rank: int) -> tuple:
    """The ids themselves, and their digest beside them."""
    return ids, *digest(vocab, text, ids, rank)


checked.schema = f"ids array<int>, {digest.schema}"


def encode(text: Column, path: str) -> Column:
    """The library's own segmentation of a text column, as ids (empty for null)."""
    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(vocabulary(path).library.encode(texts.fillna("").tolist(), num_threads=1))
    return run(text.cast("string"))


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids (empty for null)."""
    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        vocab = vocabulary(path)
        return pd.Series([vocab.decode([] if r is None else list(r)) for r in rows], dtype=object)
    return run(ids)
