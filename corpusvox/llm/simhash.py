"""SimHash near-duplicates: a binary-trie self-join on 64-bit fingerprints, then components.

Fingerprint: a text is lower-cased (A-Z), cut into words and word shingles (repeats
included), each shingle hashed with XXH64 (seed 42); a bit is set if it is set in over half
of the hashes.  Fingerprints link when they differ in ``max_bits`` bits or fewer, and a
component is everything reachable over links.

The join walks a binary trie of the distinct fingerprints against itself: a pair of nodes is
kept while the bits in which their paths differ stay within the error budget.  To deal it
out, the 64 bits are cut into ``max_bits + 1`` blocks; two linked fingerprints agree on one
whole block, so the trie is grown once per block with that block's bits on top, and the walk
starts at the equal node pairs below it.  Subtrees are dealt by their block value; a subtree
with more fingerprints than a task should hold is opened further by its next bits into
node pairs (the same walk, with the same budget) until every piece fits.  A task reports
the components it finds, as edges to its least member, never all its pairs.

Defined results: a null or wordless text has fingerprint zero, linked like any other; a text
of fewer words than a shingle is one shingle; null ids share the table like other rows and
are ignored in the least id of a component (null if all its ids are null); repeated rows
each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from corpusvox.llm.common import free_name, quoted, rows_per_part, shuffle_partitions
from corpusvox.session import cut_lineage

SEED = 42
#: Hashes of one text that are counted at a time.
CHUNK = 1 << 16


def fingerprint_of(data: bytes | None, size: int = 4) -> int:
    """The fingerprint of a text as a signed 64-bit number."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        some = words[at:min(at + CHUNK, n) + size - 1]
        line = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        k = max(1, len(some) - size + 1)
        cuts = map(slice, starts[:k].tolist(), ends[min(size, len(some)) - 1:].tolist())
        h = np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(SEED)), np.uint64, k)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)
    return int(bits.astype(np.int64)[0])


def fingerprint(text: Column, size: int = 4) -> Column:
    """The fingerprint of each text, as a long."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf(LongType())
    def of_batch(a: pa.Array) -> pa.Array:
        return pa.array((fingerprint_of(x.as_py(), size) for x in a), type=pa.int64())
    return of_batch.asNondeterministic()(text.cast("binary"))


def hex_digits(value: Column) -> Column:
    """16 lowercase hex digits of a long taken as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def block_sizes(max_bits: int) -> list[int]:
    """How many bits each of the ``max_bits + 1`` blocks has, highest bits first."""
    k = max_bits + 1
    return [64 // k + (i < 64 % k) for i in range(k)]


def rotated(value: Column, left: int) -> Column:
    """A long with its bits rotated to the left."""
    if not left:
        return value
    return F.shiftleft(value, left).bitwiseOR(F.shiftrightunsigned(value, 64 - left))


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Labels:
    """Components over 0..n-1, joined by arrays of pairs; a label is the least member."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if np.array_equal(up, self.of):
                    break
                self.of = up


def trie_components(values: np.ndarray, groups: np.ndarray, sides: np.ndarray, max_bits: int,
                    depth: int, width: int = 1 << 16) -> np.ndarray:
    """Labels of the fingerprints of one task after the trie walk inside each group.

    values: distinct within (group, side), sorted by (group, side, value); depth: bits that a
    group's members share or that were walked already.  A group with sides 0 and 1 joins one
    side with the other, a group with side 0 alone joins with itself.  The walk keeps pairs of
    value ranges (trie nodes) and opens both by their next bit; pieces of ``width`` pairs are
    walked depth first, so memory is bounded by width and the 64 levels.  Pairs whose members
    all have one label already are dropped: they can't change a component."""
    n = len(values)
    labels = Labels(n)
    if n < 2:
        return labels.of
    key = groups.astype(np.int64) * 2 + sides
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.append(starts[1:], n)
    g, s = groups[starts], sides[starts]
    two = np.flatnonzero((g[1:] == g[:-1]) & (s[:-1] == 0) & (s[1:] == 1))
    other = np.isin(np.arange(len(starts)), np.concatenate((two, two + 1)))
    alone = np.flatnonzero(~other & (s == 0) & (ends - starts > 1))
    first = np.concatenate((alone, two))
    second = np.concatenate((alone, two + 1))
    for budget in sorted({min(1, max_bits), max_bits}):  # near links first, so that dense groups close early
        stack = [(depth, starts[first][i:i + width], ends[first][i:i + width], starts[second][i:i + width],
                  ends[second][i:i + width]) for i in range(0, len(first), width)]
        while stack:
            level, a0, a1, b0, b1 = stack.pop()
            small = ((a1 - a0) * (b1 - b0) <= 16) | (level >= 64)
            if small.any():
                link_pairs(values, labels, a0[small], a1[small], b0[small], b1[small], budget)
            big = ~small
            if not big.any():
                continue
            a0, a1, b0, b1 = a0[big], a1[big], b0[big], b1[big]
            turns = np.cumsum(np.concatenate(([0], labels.of[1:] != labels.of[:-1])))
            live = ~((turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1])
                     & (labels.of[a0] == labels.of[b0]))
            a0, a1, b0, b1 = a0[live], a1[live], b0[live], b1[live]
            am, bm = split_at(values, a0, a1, level), split_at(values, b0, b1, level)
            same = (a0 == b0) & (a1 == b1)
            parts = [(a0, am, b0, bm), (am, a1, bm, b1), (a0, am, bm, b1)]
            keep = [np.ones(len(a0), bool)] * 3 + [~same]
            parts.append((am, a1, b0, bm))
            c = [np.concatenate([p[i][k] for p, k in zip(parts, keep, strict=True)]) for i in range(4)]
            ok = (c[1] > c[0]) & (c[3] > c[2])
            ok &= ~((c[0] == c[2]) & (c[1] - c[0] == 1) & (c[1] == c[3]))
            c = [x[ok] for x in c]
            if len(c[0]):
                # bits above this level in which the two paths differ
                seen = np.uint64(level + 1)
                top = ~np.uint64(0) << (np.uint64(64) - seen) if level < 63 else ~np.uint64(0)
                ok = popcount((values[c[0]] ^ values[c[2]]) & top) <= budget
                c = [x[ok] for x in c]
            for i in range(0, len(c[0]), width):
                stack.append((level + 1, *(x[i:i + width] for x in c)))
    return labels.of


def split_at(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where in each sorted range the bit ``level`` (0: highest) turns from 0 to 1."""
    bit = np.uint64(1) << np.uint64(63 - level)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        one = (values[mid] & bit) != 0
        hi[open_[one]] = mid[one]
        lo[open_[~one]] = mid[~one] + 1


def link_pairs(values: np.ndarray, labels: Labels, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray,
               b1: np.ndarray, budget: int) -> None:
    """Compare the members of small range pairs one by one and join those within the budget."""
    na, nb = a1 - a0, b1 - b0
    sizes = na * nb
    which = np.repeat(np.arange(len(a0)), sizes)
    at = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    a, b = a0[which] + at // nb[which], b0[which] + at % nb[which]
    ok = popcount(values[a] ^ values[b]) <= budget
    labels.join(a[ok], b[ok])


def pieces(blocks: DataFrame, sizes: list[int], max_bits: int, per_task: int) -> DataFrame:
    """(block, key, value, piece, side): every fingerprint with each piece of work it takes part in.

    A piece is one trie node (side 0 only) or a pair of nodes.  Nodes over ``per_task`` members
    are opened ``STEP`` bits at a time, level by level; what is counted and joined are nodes, not
    fingerprints, so a hot subtree is split without being gathered."""
    step = 4
    done: list[DataFrame] = []
    todo = blocks.withColumn("piece", F.xxhash64("block", "key")).withColumn("side", F.lit(0))
    depth = max(sizes)
    while True:
        counts = todo.groupBy("piece", "side").agg(F.count("*").alias("n"))
        weight = counts.groupBy("piece").agg(F.sum("n").alias("n"))
        hot = weight.where(F.col("n") > per_task).select("piece")
        hot = cut_lineage(hot)
        if depth + step > 64 or hot.isEmpty():
            done.append(todo)
            break
        done.append(todo.join(hot, "piece", "left_anti"))
        open_ = todo.join(hot, "piece", "left_semi")
        bits = F.shiftrightunsigned("value", 64 - depth - step)
        nodes = open_.withColumn("node", bits)
        pairs = node_pairs(nodes.select("piece", "side", "node").distinct(), max_bits)
        todo = cut_lineage(nodes.join(pairs, ["piece", "side", "node"]).select(
            "block", "key", "value", F.col("new_piece").alias("piece"), F.col("new_side").alias("side")))
        depth += step
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def node_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """The children of opened pieces paired within the budget: (piece, side, node, new_piece, new_side)."""
    a = nodes.select("piece", F.col("side").alias("sa"), F.col("node").alias("na"))
    b = nodes.select("piece", F.col("side").alias("sb"), F.col("node").alias("nb"))
    two_sided = nodes.groupBy("piece").agg(F.max("side").alias("sides"))
    p = a.join(b, "piece").join(two_sided, "piece").where(
        ((F.col("sides") == 0) & (F.col("na") <= F.col("nb"))
         | (F.col("sides") == 1) & (F.col("sa") == 0) & (F.col("sb") == 1))
        & (F.bit_count(F.col("na").bitwiseXOR(F.col("nb"))) <= max_bits))
    p = p.withColumn("new_piece", F.xxhash64("piece", "na", "nb", "sa", "sb"))
    left = p.select("piece", F.col("sa").alias("side"), F.col("na").alias("node"), "new_piece",
                    F.lit(0).alias("new_side"))
    right = p.where((F.col("sa") != F.col("sb")) | (F.col("na") != F.col("nb"))).select(
        "piece", F.col("sb").alias("side"), F.col("nb").alias("node"), "new_piece", F.lit(1).alias("new_side"))
    return left.unionByName(right)


def trie_links(prints: DataFrame, max_bits: int, per_task: int = 50_000, n_prints: int | None = None) -> DataFrame:
    """Edges (a, b), b < a, that connect exactly the distinct fingerprints that reach each other.

    ``prints`` has one column ``value`` of distinct longs."""
    spark = prints.sparkSession
    sizes = block_sizes(max_bits)
    lefts = [sum(sizes[:i]) for i in range(len(sizes))]
    each = F.array(*[F.struct(
        F.lit(i).alias("block"),
        F.shiftrightunsigned(rotated(F.col("value"), left), 64 - size).alias("key"),
        rotated(F.col("value"), left).alias("value")) for i, (size, left) in enumerate(zip(sizes, lefts, strict=True))])
    blocks = prints.select(F.explode(each).alias("x")).select("x.block", "x.key", "x.value")
    work = pieces(blocks, sizes, max_bits, per_task)
    n = prints.count() if n_prints is None else n_prints
    parts = rows_per_part(n * len(sizes), 4 * per_task, shuffle_partitions(spark))
    least = min(sizes)

    def walk(batches):
        frames = [b.to_pandas() for b in batches]
        rows = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame(
            {"block": [], "value": [], "piece": [], "side": []})
        empty = pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(rows):
            yield empty
            return
        value = rows["value"].to_numpy(np.int64).view(np.uint64)
        piece, side = rows["piece"].to_numpy(np.int64), rows["side"].to_numpy(np.int64)
        block = rows["block"].to_numpy(np.int64)
        order = np.lexsort((value, side, piece))
        value, piece, side, block = value[order], piece[order], side[order], block[order]
        group = np.cumsum(np.concatenate(([0], piece[1:] != piece[:-1])))
        label = trie_components(value, group, side, max_bits, least)
        moved = np.flatnonzero(label != np.arange(len(label)))
        back = np.array(lefts, dtype=np.uint64)

        def original(at):
            v, left = value[at], back[block[at]]
            return np.where(left > 0, (v >> left) | (v << ((np.uint64(64) - left) % np.uint64(64))), v).view(np.int64)

        a, b = original(moved), original(label[moved])
        for i in range(0, len(a), 1 << 16):
            yield pa.RecordBatch.from_pydict({"a": pa.array(a[i:i + (1 << 16)]), "b": pa.array(b[i:i + (1 << 16)])})
        yield empty

    found = work.select("block", "value", "piece", "side").repartition(parts, "piece").mapInArrow(walk, "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the least node of each component, for every node with an edge.

    Alternates the large-star and small-star steps; each is an aggregation of the least
    neighbour (combined before its shuffle) and a join back.  A round's edges are checkpointed,
    and only their number and sum come to the driver."""
    now = cut_lineage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            pairs = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = pairs.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        met = pairs.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        return out.where("u != v").distinct()

    before = None
    while True:
        now = cut_lineage(star(star(now, True), False))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            break
        before = state
    return (now.groupBy("u").agg(F.min("v").alias("label")).select(F.col("u").alias("node"), "label")
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()))


def with_components(light: DataFrame, max_bits: int, per_task: int) -> DataFrame:
    """``light`` (doc_id, value, more) with label, the least fingerprint of its component, and
    component_id, the component's least doc_id."""
    prints = cut_lineage(light.groupBy("value").agg(F.min("doc_id").alias("least_id")))
    edges = trie_links(prints.select("value"), max_bits, per_task)
    labels = component_labels(edges)
    known = prints.join(labels.withColumnRenamed("node", "value"), "value", "left").withColumn(
        "label", F.coalesce("label", "value"))
    least = known.groupBy("label").agg(F.min("least_id").alias("component_id"))
    return light.join(known.join(least, "label").select("value", "label", "component_id"), "value")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                    max_bits: int = 4, per_task: int = 50_000) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs``."""
    light = cut_lineage(docs.select(F.col(quoted(doc_id)).alias("doc_id"),
                                    fingerprint(F.col(quoted(text)), shingle).alias("value")))
    return with_components(light, max_bits, per_task).select(
        "doc_id", hex_digits(F.col("value")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
             max_bits: int = 4, per_task: int = 50_000) -> DataFrame:
    """``docs`` with one row of each component: the one with the least id (a null id last).

    Rows are found again by id and text hash; where several equal rows are the least, one stays."""
    d, t = F.col(quoted(doc_id)), F.col(quoted(text))
    light = cut_lineage(docs.select(d.alias("doc_id"), fingerprint(t, shingle).alias("value"),
                                    F.xxhash64(t).alias("hash")))
    counted = (with_components(light, max_bits, per_task).groupBy("label", "doc_id", "hash")
               .agg(F.count("*").alias("n")))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "n")).alias("x")
    reps = cut_lineage(counted.groupBy("label").agg(least).select("x.doc_id", "x.hash", "x.n"))
    names = {c: free_name(docs, f"_rep_{c}") for c in reps.columns}
    reps = reps.select(*[F.col(c).alias(n) for c, n in names.items()])
    key = free_name(docs, "_text_hash")
    found = docs.withColumn(key, F.xxhash64(t)).join(
        reps, d.eqNullSafe(F.col(names["doc_id"])) & (F.col(key) == F.col(names["hash"])))
    if not reps.where(F.col(names["n"]) > 1).isEmpty():
        again = F.col(names["n"]) > 1
        found = found.where(~again).unionByName(found.where(again).dropDuplicates([doc_id, key]))
    return found.select(*[F.col(quoted(c)) for c in docs.columns])
