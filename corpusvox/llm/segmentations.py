"""Sampled SentencePiece segmentations: Gumbel top-k without replacement, and exact decoding.

The pieces of a SentencePiece model span a lattice over a text.  A segmentation's probability
is the product of its pieces' weights, normalised over the lattice; a BPE model orders its
pieces by rank, so a piece of rank r weighs 1 / (r + 2), to the power ``alpha``.  The k
segmentations with the largest Gumbel-perturbed log probabilities are a sample without
replacement.  They are found by A-star from the front of the lattice: the heuristic of a node
is the exact log mass behind it, a subtree carries the largest perturbed value of its
members, the children of the best subtree get theirs conditioned on that maximum, and what is
not followed waits on an agenda.  With kappa the (k+1)-th value, the inclusion score of a
segmentation of log probability l is 1 - exp(-exp(l - kappa)).

Random numbers are hashes of (row key, sample, place), so a row's sample depends neither on
its neighbours nor on the task that draws it.

No piece goes on over a space after something else, so the lattice is a chain of lattices of
space-led units; a batch's distinct units are looked up in a table that is built once per batch
sequence and bounded in size; when it is full, the units met again since the last time stay.  Nodes whose children can no longer be among the k best (perturbations of
doubles are bounded) are drawn straight from their probabilities.

Defined results: a null text has no samples, an empty text one empty sample of probability 1;
a text with fewer than k segmentations gets all of them, with inclusion score 1; characters
that no piece covers are written as bytes, and so is a literal U+2581, so decoding gives back
every text exactly; equal keys draw equal numbers; repeated rows each get a row; columns of the
input that carry a result's name are replaced, other extra columns pass through.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from corpusvox.llm.common import prepare, quoted, rows_udf, with_fields

SAMPLE = StructType([StructField("ids", ArrayType(IntegerType())), StructField("log_prob", DoubleType()),
                     StructField("perturbed", DoubleType()), StructField("inclusion", DoubleType())])
RESULT = StructType([StructField("samples", ArrayType(SAMPLE))])

#: No Gumbel number drawn here is larger (uniforms have 52 bits).
MOST_GUMBEL = 37.0
#: Path nodes down to this log probability are opened first; they nearly always hold the k best.
NEAR = -8.0
#: Nodes of the unit table after which only units met again stay, and characters of text handled together.
TABLE_NODES = 800_000
BATCH_CHARS = 1_500_000
LONG_UNIT = 64
CODE_BITS = 21


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with spaces for the SentencePiece mark, their ids and log weights; ids of the bytes."""
    ids: dict[str, int]
    weights: dict[str, float]
    bytes_: list[int]
    unknown: float


def load_vocabulary(path: str, alpha: float = 1.0) -> Vocabulary:
    """Read a SentencePiece model file (on the driver; executors get the pieces by broadcast)."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, weights, bytes_ = {}, {}, [-1] * 256
    for i in range(sp.vocab_size()):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            plain = piece.replace("▁", " ")
            if not re.search("[^ ] ", plain):
                ids[plain] = i
                weights[plain] = -alpha * math.log(max(0.0, -sp.get_score(i)) % 1e9 + 2.0)
    if -1 in bytes_:
        raise ValueError("the model has no byte pieces, so not every text could be written")
    return Vocabulary(ids, weights, bytes_, min(weights.values()) - 10.0 * alpha)


class Trie:
    """The pieces as a trie whose steps are looked up for whole arrays, in an open-addressing table."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        number: dict[str, int] = {"": 0}
        steps: list[int] = []
        for piece in vocabulary.ids:
            for n in range(1, len(piece) + 1):
                if piece[:n] not in number:
                    number[piece[:n]] = len(number)
                    steps.append(number[piece[:n - 1]] << CODE_BITS | ord(piece[n - 1]))
        self.piece = np.full(len(number), -1, np.int32)
        self.weight = np.zeros(len(number))
        for piece, i in vocabulary.ids.items():
            self.piece[number[piece]] = i
            self.weight[number[piece]] = vocabulary.weights[piece]
        #: Each node's step, and one that no node has in the place that -1 reads.
        self.key = np.array([-1, *steps, -1], np.int64)
        bits = max(4, int(len(steps) * 6).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.child = np.full(1 << bits, -1, np.int32)
        todo = np.arange(1, len(number))
        slot = self.slot(self.key)
        while len(todo):
            free = todo[self.child[slot[todo]] < 0]
            self.child[slot[free]] = free
            todo = todo[self.child[slot[todo]] != todo]
            slot[todo] = (slot[todo] + 1) & self.mask
        #: The root's child by each code point.
        self.root = np.full(0x110000, -1, np.int32)
        heads = np.flatnonzero(self.key[1:-1] >> CODE_BITS == 0) + 1
        self.root[self.key[heads] & (1 << CODE_BITS) - 1] = heads

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, nodes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The child of each node by each code point; -1 where there is none."""
        keys = nodes.astype(np.int64) << CODE_BITS | codes
        slot = self.slot(keys)
        out = self.child.take(slot)
        more = np.flatnonzero((out >= 0) & (self.key.take(out) != keys))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            out[more] = self.child[slot[more]]
            more = more[(out[more] >= 0) & (self.key[out[more]] != keys[more])]
        return out


class Units(defaultdict):
    """Unit text -> its number, with the lattices of all units seen as flat arrays.

    Nodes are numbered through from each unit's first (``base``); a unit's nodes are its character
    positions and its end.  The edges of a node stand together, longest first.  ``upto`` is the share of
    a node's probability up to an edge, as the first number of 52 bits beyond it; ``final`` tells of an edge
    that it leads to its unit's end, ``again`` of a unit that it was met after the batch that brought it."""

    def __init__(self, trie: Trie, unknown: float, numbered: int = 0) -> None:
        super().__init__(itertools.count(numbered).__next__)
        self.trie, self.unknown = trie, unknown
        self.n_nodes = 0
        self.held: dict[str, np.ndarray] = {}
        self.base, self.again = np.zeros(0, np.int64), np.zeros(0, bool)
        self.first = self.degree = self.to = self.source = self.piece = np.zeros(0, np.int32)
        self.log_p, self.upto, self.final = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    def append(self, name: str, values: np.ndarray) -> None:
        """Lengthen an array; its space doubles when it is full (pages not written yet take no memory)."""
        now = getattr(self, name)
        n = len(now) + len(values)
        space = self.held.get(name)
        if space is None or n > len(space):
            space = self.held[name] = np.empty(2 * n, values.dtype)
            space[:len(now)] = now
        space[len(now):n] = values
        setattr(self, name, space[:n])

    def reduced(self) -> Units:
        """A new table with the units met again, or without any if these would fill half of it."""
        kept = np.flatnonzero(self.again)
        base = self.base[kept]
        size = np.append(self.base[1:], self.n_nodes)[kept] - base
        if not 0 < int(size.sum()) <= TABLE_NODES // 2:
            return Units(self.trie, self.unknown)
        out = Units(self.trie, self.unknown, len(kept))
        nodes, begin = edges_of(base, size)
        edges, edge = edges_of(self.first[nodes], self.degree[nodes])
        move = np.repeat(np.repeat((begin - base).astype(np.int32), size), self.degree[nodes])
        out.update(zip(itertools.compress(self, self.again.tolist()), range(len(kept)), strict=True))
        out.n_nodes = len(nodes)
        out.held = self.held  # what stays has been copied out by now, so the space is used again
        for name, values in (("base", begin), ("again", np.zeros(len(kept), bool)), ("first", edge.astype(np.int32)),
                             ("degree", self.degree[nodes]), ("to", self.to[edges] + move),
                             ("source", self.source[edges] + move), ("piece", self.piece[edges]),
                             ("log_p", self.log_p[edges]), ("upto", self.upto[edges]), ("final", self.final[edges])):
            out.append(name, values)
        return out

    def finish(self, new: list[str]) -> None:
        """Append the units numbered last: their edges, the log mass behind each node, and each edge's probability."""
        if not new:
            return
        old_nodes, old_edges = self.n_nodes, len(self.to)
        codes = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(codes))  # characters from each position to its unit's end
        node = np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes)  # a unit's end is a node too
        n_nodes = len(codes) + len(sizes)
        self.n_nodes += n_nodes

        levels = []  # for each length, the positions where a piece of it begins
        at, where, n = np.arange(len(codes)), self.trie.root.take(codes), 1
        while True:
            on = np.flatnonzero(where >= 0)
            at, where = at.take(on), where.take(on)
            piece = self.trie.piece.take(where)
            full = np.flatnonzero(piece >= 0)
            levels.append((n, at.take(full), piece.take(full), self.trie.weight.take(where.take(full))))
            on = np.flatnonzero(left.take(at) > n)
            if not len(on):
                break
            at, where = at.take(on), where.take(on)
            where, n = self.trie.step(where, codes.take(at + n)), n + 1
        covered = np.zeros(len(codes), bool)
        covered[levels[0][1]] = True
        bare = np.flatnonzero(~covered)
        levels.append((1, bare, -1 - codes[bare], np.full(len(bare), self.unknown)))

        # Edges stand by the characters left from their node, so that each step of the sums below is one slice.
        order = np.argsort(np.minimum(left, LONG_UNIT + 1).astype(np.uint8), kind="stable")
        bounds = np.searchsorted(left.take(order).clip(max=LONG_UNIT + 1), np.arange(1, LONG_UNIT + 2))
        edges_at = np.zeros(len(codes), np.int64)
        for _, at, _, _ in levels:
            edges_at[at] += 1
        nodes, degree = node.take(order), edges_at.take(order)
        begin = np.cumsum(degree) - degree
        n_edges = int(degree.sum())
        to, piece, weight = np.zeros(n_edges, np.int32), np.zeros(n_edges, np.int32), np.zeros(n_edges)
        source = np.repeat(nodes.astype(np.int32), degree)
        free = np.empty(len(codes), np.int64)
        free[order] = begin
        for n, at, p, w in reversed(levels):
            slot = free.take(at)
            to[slot], piece[slot], weight[slot] = node.take(at) + n, p, w
            free[at] = slot + 1

        mass = np.zeros(n_nodes)
        for t in range(LONG_UNIT):
            some = slice(bounds[t], bounds[t + 1])
            if some.start < some.stop:
                first, count = begin[some], degree[some]
                a, b = first[0], first[-1] + count[-1]
                x = weight[a:b] + mass.take(to[a:b])
                shift = x.take(first - a)
                mass[nodes[some]] = shift + np.log(np.add.reduceat(np.exp(x - np.repeat(shift, count)), first - a))
        for i in range(len(order) - 1, bounds[-1] - 1, -1):  # inside long units, one node after the other from the end
            a = int(begin[i])
            x = [weight[e] + mass[to[e]] for e in range(a, a + int(degree[i]))]
            top = max(x)
            mass[nodes[i]] = top + math.log(sum(math.exp(y - top) for y in x))
        log_p = weight + mass.take(to) - np.repeat(mass.take(nodes), degree)
        total = np.cumsum(np.exp(log_p))
        upto = total - np.repeat(np.concatenate(([0.0], total)).take(begin), degree)
        upto[begin + degree - 1] = 2.0
        upto = np.ceil(upto * 2.0**52 - 0.5).astype(np.int64)  # scaled exactly, so (m + 0.5) / 2^52 >= upto is m >= this

        final = np.zeros(n_nodes, bool)
        final[ends + np.arange(len(sizes))] = True
        first, out = np.zeros(n_nodes, np.int32), np.zeros(n_nodes, np.int32)
        first[nodes], out[nodes] = begin + old_edges, degree
        for name, values in (("base", ends - sizes + np.arange(len(sizes)) + old_nodes), ("again", np.zeros(len(new), bool)),
                             ("first", first), ("degree", out), ("to", to + np.int32(old_nodes)),
                             ("source", source + np.int32(old_nodes)), ("piece", piece), ("log_p", log_p),
                             ("upto", upto), ("final", final.take(to))):
            self.append(name, values)


def edges_of(first: np.ndarray, degree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All edges of some nodes (of one edge at least), node after node, and where each node's begin."""
    at = np.cumsum(degree) - degree
    return np.arange(int(degree.sum())) + np.repeat(first - at, degree), at


def hashed(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of the parts."""
    return hashed_on(np.uint64(0x243F6A8885A308D3), *parts)


def hashed_on(h: np.ndarray | np.uint64, *parts: np.ndarray | int) -> np.ndarray:
    """The hash of more parts after those of which ``h`` is the hash."""
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(32))
        return h


def numbers(h: np.ndarray) -> np.ndarray:
    """Numbers of 52 bits from hashes."""
    with np.errstate(over="ignore"):
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(12)).view(np.int64)


def uniforms(*parts: np.ndarray | int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of the parts."""
    return (numbers(hashed(*parts)) + 0.5) * 2.0**-52


@dataclass
class Agenda:
    """Subtrees not followed yet, one entry each; ``path`` and ``step`` say where they branched off."""
    doc: np.ndarray
    value: np.ndarray
    edge: np.ndarray
    unit: np.ndarray
    loc: np.ndarray
    path: np.ndarray
    step: np.ndarray

    def joined(self, other: Agenda) -> Agenda:
        return Agenda(*[np.concatenate((a, b)) for a, b in zip(vars(self).values(), vars(other).values(), strict=True)])

    def taken(self, at: np.ndarray) -> Agenda:
        return Agenda(*[a[at] for a in vars(self).values()])

    @staticmethod
    def empty() -> Agenda:
        return Agenda(*[np.zeros(0, t) for t in (int, float, int, int, float, int, int)])

    def best(self, n_docs: int, k: int) -> tuple[Agenda, np.ndarray]:
        """The k best entries of each doc, best first, and each doc's k-th value (-inf with fewer)."""
        order = np.argsort(-self.value)
        order = order[np.argsort(self.doc[order].astype(np.uint16 if n_docs < 1 << 16 else np.int64), kind="stable")]
        doc = self.doc[order]
        size = np.bincount(doc, minlength=n_docs)
        rank = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
        out = self.taken(order[rank < k])
        last = np.full(n_docs, -np.inf)
        kth = order[rank == k - 1]
        last[self.doc[kth]] = self.value[kth]
        return out, last


#: The worker's trie, and the vocabulary that it is of.
KEPT: list[tuple[Vocabulary, Trie]] = []


def kept_trie(vocabulary: Vocabulary) -> Trie:
    """This worker's trie of a vocabulary; one of another vocabulary makes room for it."""
    if not KEPT or KEPT[0][0] != vocabulary:
        KEPT[:] = [(vocabulary, Trie(vocabulary))]
    return KEPT[0][1]


class Sampler:
    """Draws the k best perturbed segmentations of many texts together."""

    def __init__(self, vocabulary: Vocabulary, k: int) -> None:
        self.vocabulary, self.k = vocabulary, k
        self.trie = kept_trie(vocabulary)
        self.units = Units(self.trie, vocabulary.unknown)

    def nodes(self, texts: list[str]) -> list[np.ndarray]:
        """The first nodes of each text's units; a unit is looked up once however often the texts hold it.

        A space before each text leads its first unit; then a unit begins at each space after something else."""
        data = [(" " + t).encode() for t in texts]
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        begin = np.cumsum(sizes) - sizes
        joined = b"".join(data)
        space = np.frombuffer(joined, np.uint8) == 0x20
        leads = space.copy()
        leads[1:] &= ~space[:-1]
        leads[begin] = True
        at = np.flatnonzero(leads)
        bounds = pa.py_buffer(np.append(at, len(joined)))
        found = pa.LargeStringArray.from_buffers(len(at), bounds, pa.py_buffer(joined)).dictionary_encode()
        seen, u = found.dictionary.to_numpy(zero_copy_only=False).tolist(), self.units
        known = len(u)
        number = np.fromiter(map(u.__getitem__, seen), np.int64, len(seen))
        met = number < known
        u.again[number[met]] = True
        u.finish(list(itertools.compress(seen, (~met).tolist())))
        nodes = u.base.take(number).take(found.indices.to_numpy())
        return np.split(nodes, np.searchsorted(at, begin[1:]))

    def __call__(self, seeds: list[int], texts: list[str | None]) -> list[list[dict] | None]:
        out: list[list[dict] | None] = [None] * len(texts)
        some: list[int] = []
        chars = 0
        for i, t in enumerate(texts):
            if t == "":
                out[i] = [{"ids": [], "log_prob": 0.0, "perturbed": 0.0, "inclusion": 1.0}]
            elif t is not None:
                some.append(i)
                chars += len(t)
            if some and (chars > BATCH_CHARS or i == len(texts) - 1):
                for j, x in zip(some, self.draw([seeds[j] for j in some], [texts[j] for j in some]), strict=True):
                    out[j] = x
                some, chars = [], 0
        return out

    def draw(self, seeds: list[int], texts: list[str]) -> list[list[dict]]:
        if self.units.n_nodes > TABLE_NODES:
            self.units = self.units.reduced()
        u, k, n = self.units, self.k, len(texts)
        starts = self.nodes(texts)
        seed = np.array(seeds, np.int64).view(np.uint64)
        samples: list[list[dict]] = [[] for _ in range(n)]
        paths: list[dict[int, np.ndarray]] = []
        agenda = Agenda.empty()
        docs = np.arange(n)
        value = -np.log(-np.log(uniforms(seed, 1)))
        unit, loc = np.zeros(n, np.int64), np.zeros(n)
        heads, ahead = [np.zeros(0, np.int32)] * n, starts
        for r in range(k):
            tails, places = self.follow(r, docs, unit, ahead, seed)
            own = [np.concatenate(x) for x in zip(heads, tails, strict=True)]
            paths.append(dict(zip(docs.tolist(), own, strict=True)))
            ends, agenda = self.branch(r, docs, value, loc, heads, tails, places, agenda, seed)
            for d, ids, m, at in zip(docs.tolist(), self.ids(own), value.tolist(), ends.tolist(), strict=True):
                samples[d].append({"ids": ids, "log_prob": at, "perturbed": m})
            if r == k - 1 or not len(agenda.doc):
                break
            first = np.flatnonzero(np.concatenate(([True], agenda.doc[1:] != agenda.doc[:-1])))
            top = agenda.taken(first)
            agenda = agenda.taken(np.setdiff1d(np.arange(len(agenda.doc)), first))
            docs, value, unit, loc = top.doc, top.value, top.unit, top.loc
            heads = [np.append(paths[p][d][:s], e) for d, p, s, e in zip(
                docs.tolist(), top.path.tolist(), top.step.tolist(), top.edge.tolist(), strict=True)]
            ahead = [np.concatenate(([v], starts[d][j + 1:])) for d, j, v in zip(
                docs.tolist(), unit.tolist(), u.to[top.edge].tolist(), strict=True)]
        kappa = np.full(n, -np.inf)
        np.maximum.at(kappa, agenda.doc, agenda.value)
        for d, found in enumerate(samples):
            for s in found:
                s["inclusion"] = 1.0 if kappa[d] == -np.inf else -math.expm1(
                    -math.exp(min(700.0, s["log_prob"] - kappa[d])))
        return samples

    def follow(self, r: int, docs: np.ndarray, unit: np.ndarray, ahead: list[np.ndarray],
               seed: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The best leaf below each doc's place: the child that holds a node's maximum is child i with
        probability p_i, whatever the maximum is.  Returns edges and the unit number of each edge."""
        tails, places, group, size = [], [], [], 0
        for i, nodes in enumerate(ahead):
            group.append(i)
            size += len(nodes)
            if size > 1 << 18 or i == len(ahead) - 1:
                sizes = np.array([len(ahead[j]) for j in group])
                begin = np.cumsum(sizes) - sizes
                place = np.arange(size) + np.repeat(unit[group] - begin, sizes)
                edges, count = self.walk(np.concatenate([ahead[j] for j in group]), hashed(
                    np.repeat(seed[docs[group]], sizes), 1000 + r, place))
                cuts = (np.cumsum(count) - count)[begin[1:]]
                tails += np.split(edges, cuts)
                places += np.split(np.repeat(place, count), cuts)
                group, size = [], 0
        return tails, places

    def walk(self, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw a path from each node to its unit's end; edges in order, and each path's length."""
        u = self.units
        count = np.zeros(len(node), np.int64)
        at = np.flatnonzero(u.degree.take(node) > 0)
        node, key = node[at], hashed(key[at])
        steps = []
        while len(at):
            x = numbers(hashed_on(key, len(steps)))
            e = u.first.take(node).astype(np.int64)
            more = np.flatnonzero(x >= u.upto.take(e))
            left, of = x.take(more), e.take(more)
            while len(more):
                of += 1
                e[more] = of
                on = np.flatnonzero(left >= u.upto.take(of))
                more, left, of = more.take(on), left.take(on), of.take(on)
            steps.append((at, e))
            count[at] += 1
            on = np.flatnonzero(~u.final.take(e))
            at, node, key = at.take(on), u.to.take(e.take(on)), key.take(on)
        begin = np.cumsum(count) - count
        edges = np.zeros(int(count.sum()), np.int32)
        for i, (at, e) in enumerate(steps):
            edges[begin[at] + i] = e
        return edges, count

    def branch(self, r: int, docs: np.ndarray, value: np.ndarray, loc: np.ndarray, heads: list, tails: list,
               places: list, agenda: Agenda, seed: np.ndarray) -> tuple[np.ndarray, Agenda]:
        """Put the siblings along the paths on the agenda and keep the best of it.

        Given a node's maximum m and where it lies, another child's maximum is a Gumbel number at
        that child's log probability, cut off at m.  A node too deep to reach a doc's k best values
        even with the largest number that can be drawn is left closed.  Returns the paths' log
        probabilities too."""
        u, k, n = self.units, self.k, len(seed)
        sizes = np.array([len(t) for t in tails])
        edge = np.concatenate(tails)
        who = np.repeat(np.arange(len(docs)), sizes)
        begin = np.cumsum(sizes) - sizes
        gain = u.log_p[edge]
        total = np.concatenate(([0.0], np.cumsum(gain)))
        before = total[:-1] - np.repeat(total[begin] - loc, sizes)
        ends = loc + np.add.reduceat(np.append(gain, 0.0), begin) * (sizes > 0)
        step = np.arange(len(edge)) + np.repeat(np.array([len(h) for h in heads]) - begin, sizes)
        place = np.concatenate(places)

        def opened(at: np.ndarray, least: np.ndarray) -> Agenda:
            """The siblings along the path at these places, but for those under their doc's least value."""
            src = u.source[edge[at]]
            begin, degree = u.first[src], u.degree[src]
            e, _ = edges_of(begin, degree)
            w = np.repeat(np.arange(len(at)), degree)
            mean = before[at].take(w) + u.log_p.take(e)
            floor = least[docs[who[at]]]
            on = np.flatnonzero((e != edge[at].take(w)) & (mean + MOST_GUMBEL >= floor.take(w)))
            e, w, mean = e.take(on), w.take(on), mean.take(on)
            key = hashed(seed[docs[who[at]]], 2 + r, step[at]).take(w)
            cut = np.minimum(mean - value[who[at]].take(w), 700.0)
            v = mean - np.log(np.exp(cut) - np.log((numbers(hashed_on(key, e - begin.take(w))) + 0.5) * 2.0**-52))
            on = np.flatnonzero(v >= floor.take(w))
            e, w, mean, v = e.take(on), at.take(w.take(on)), mean.take(on), v.take(on)
            return Agenda(docs[who[w]], v, e, place[w], mean, np.full(len(w), r), step[w])

        near = before >= NEAR
        agenda, least = agenda.joined(opened(np.flatnonzero(near), np.full(n, -np.inf))).best(n, k - r)
        far = np.flatnonzero(~near & (before + MOST_GUMBEL >= least[docs][who]))
        return ends, agenda.joined(opened(far, least)).best(n, k - r)[0]

    def ids(self, paths: list[np.ndarray]) -> list[np.ndarray]:
        """Each path's piece ids, with the bytes of a character that no piece covers in its place."""
        sizes = np.array([len(p) for p in paths])
        pieces = self.units.piece[np.concatenate(paths)]
        odd = pieces < 0
        if odd.any():
            codes = -1 - pieces[odd]
            width = np.ones(len(pieces), np.int64)
            width[odd] += (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            sizes = np.add.reduceat(width, np.cumsum(sizes) - sizes)
            pieces = np.repeat(pieces, width)
            data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
            pieces[np.repeat(odd, width)] = np.array(self.vocabulary.bytes_, np.int32)[np.frombuffer(data, np.uint8)]
        return np.split(pieces, np.cumsum(sizes)[:-1])


def sample_segmentations(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text",
                         k: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with samples: up to k distinct segmentations, best perturbed value first."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(vocabulary)

    def make(shared=shared, k=k):
        return lambda seeds, texts, draw=Sampler(shared.value, k): [(x,) for x in draw(seeds, texts)]
    draw = rows_udf(make, RESULT, n_args=2)
    return with_fields(docs, draw(F.xxhash64(F.lit(seed), F.col(quoted(key))), F.col(quoted(text))), ["samples"])


def decode(ids: Column, vocabulary: Vocabulary, spark) -> Column:
    """The text of an id array; null of a null."""
    shared = prepare(spark).sparkContext.broadcast(vocabulary)
    schema = StructType([StructField("text", StringType())])

    def make(shared=shared):
        one = decoder(shared.value)
        return lambda rows: [(None if x is None else one(x),) for x in rows]
    return rows_udf(make, schema)(ids)["text"]


def decoder(vocabulary: Vocabulary):
    pieces = {i: p.encode() for p, i in vocabulary.ids.items()}
    pieces |= {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_)}
    return lambda ids: b"".join(map(pieces.__getitem__, ids)).decode()[1:]
