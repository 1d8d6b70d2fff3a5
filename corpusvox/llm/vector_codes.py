"""Vector code compression: a product quantiser fitted and applied with norm-of-sum bounds.

Components become whole numbers (floor of ``scale`` times the component) and each vector is cut
into equal consecutive parts.  A part position has its own codebook, which starts as that part
of the first vectors in id order; each round assigns every part to its nearest entry (squared
Euclidean distance, ties to the lower index) and moves every used entry to the floored mean of
its parts.  After the last round the parts are assigned once more.

For each part and entry a row keeps the last exact distance and the round it was measured in
(its stamp).  The history of all codebooks is small and every task has it, so the displacement
of an entry since that round is known as one vector: its norm is the norm of the sum of the
moves, never more than the sum of their norms.  Distance minus displacement bounds the present
distance from below, distance plus displacement from above.  A part whose other entries all lie
above its own entry's upper bound keeps it without any work; else its own distance is measured,
and then only the entries whose lower bound does not exceed it.  Measured distances are exact
integers; bounds are floats with a margin wider than their rounding, so they decide only what
is certain and the codes equal those of a full search.

A round is one pass over the rows, which also sums the parts of each entry per task; these
partial sums are added up in Spark and only the codebooks (parts x entries x part length
numbers, whatever the number of vectors) reach the driver.  Rows are not shuffled.

Defined results: rows whose vector is null, or holds a null or a component that is not finite,
are dropped; so are vectors with components so large that a squared distance would pass 64
bits, and vectors whose length is not that of the first one (least id) whose length is a
positive multiple of ``parts``.  A null id comes after all others; equal ids are ordered by
their vectors and each row counts; with fewer rows than entries there are as many entries as
rows; equal entries leave all but the first unused; no rows give an empty result.  Other columns
pass through, but those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from corpusvox.llm.common import BROADCAST_ROWS, free_name, quoted
from corpusvox.session import cut_lineage

#: Wider than the rounding of a distance kept as a 32-bit float, and of the sums made with it.
MARGIN = 1e-6
#: Rows worked on at a time.
ROWS = 4096
STATE = ("_vector", "_code", "_seen", "_stamp", "_error", "_scans", "_sums")


def whole_numbers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(vector: Column, scale: int, length: int | None = None, parts: int = 8) -> Column:
    """Whether a vector takes part: finite, in the range of exact distances, and of the right length."""
    size = F.size(vector)
    n = F.lit(length) if length else size
    limit = F.sqrt(F.lit(float(1 << 60)) / n) - 1
    fits = F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) * scale < limit), F.lit(False)))
    right = (size == length) if length else ((size > 0) & (size % parts == 0))
    return F.coalesce(right & fits, F.lit(False))


class Codebooks:
    """The codebooks of all rounds so far; the last one is in force."""

    def __init__(self, first: np.ndarray) -> None:
        """``first``: parts x entries x part length."""
        self.history = [first]

    def net(self) -> np.ndarray:
        """parts x rounds x entries: how far each entry lies from where it was in each round."""
        moved = (np.stack(self.history) - self.history[-1]).astype(np.float64)
        return np.sqrt((moved * moved).sum(axis=3)).transpose(1, 0, 2) * (1 + 1e-12)

    def update(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> None:
        new = self.history[-1].copy()
        for (part, entry), (n, total) in sums.items():
            new[part, entry] = [t // n for t in total]
        self.history.append(new)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.history[-1].ravel().tolist())).encode()).hexdigest()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, book: np.ndarray, net: np.ndarray, own: np.ndarray, seen: np.ndarray,
           stamp: np.ndarray) -> int:
    """Bring the codes of one part position up to date, in place; returns the number of measured distances.

    x: rows x length; book: entries x length; net: rounds x entries; own: rows; seen and stamp:
    rows x entries, the distance of each entry when it was last measured and the round of that."""
    now, k = len(net) - 1, len(book)
    rows = np.arange(len(x))
    moved = net[stamp, np.arange(k)]
    low = seen * (1 - MARGIN) - moved
    high = seen[rows, own] * (1 + MARGIN) + moved[rows, own]
    low[rows, own] = np.inf
    ask = np.flatnonzero(low.min(axis=1) <= high)
    if not len(ask):
        return 0
    mine = squared(x[ask], book[own[ask]])
    seen[ask, own[ask]], stamp[ask, own[ask]] = np.sqrt(mine), now
    r, j = np.nonzero(low[ask] <= (np.sqrt(mine) * (1 + MARGIN))[:, None])
    d = squared(x[ask[r]], book[j])
    seen[ask[r], j], stamp[ask[r], j] = np.sqrt(d), now
    best = np.full((len(ask), k), np.iinfo(np.int64).max)
    best[np.arange(len(ask)), own[ask]] = mine
    best[r, j] = d
    own[ask] = best.argmin(axis=1)
    return len(ask) + len(r)


def first_assignment(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.stack([squared(x, np.broadcast_to(e, x.shape)) for e in book], axis=1)
    return d.argmin(axis=1), np.sqrt(d).astype(np.float32)


def round_of(books: Codebooks, last: bool):
    """One pass over the rows: new codes, bounds and, before the last pass, the task's sums by entry."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, net = books.history[-1], books.net()
        parts, k, m = book.shape
        sums, counts = np.zeros((parts, k, m), np.int64), np.zeros((parts, k), np.int64)
        schema = None

        for whole in batches:
            schema = pa.schema([pa.field("_vector", pa.binary()) if f.name == "_vector" else f for f in whole.schema])
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                n = len(batch)
                col = {s: batch.column(batch.schema.get_field_index(s)) for s in STATE}

                def matrix(name, dtype, *shape):
                    return np.frombuffer(b"".join(col[name].to_pylist()), dtype).reshape(n, *shape)
                if len(books.history) == 1:
                    x = col["_vector"].flatten().to_numpy(zero_copy_only=False).reshape(n, parts, m)
                else:
                    x = matrix("_vector", np.int32, parts, m).astype(np.int64)
                error, scans = np.zeros(n, np.int64), np.array(col["_scans"].to_pylist(), np.int64)
                if len(books.history) == 1:
                    code = np.empty((n, parts), np.uint8 if k <= 256 else np.int32)
                    seen, stamp = np.empty((n, parts, k), np.float32), np.zeros((n, parts, k), np.uint8)
                    for p in range(parts):
                        code[:, p], seen[:, p] = first_assignment(x[:, p], book[p])
                    scans += parts * k
                else:
                    code = matrix("_code", np.uint8 if k <= 256 else np.int32, parts).copy()
                    seen = matrix("_seen", np.float32, parts, k).copy()
                    stamp = matrix("_stamp", np.uint8, parts, k).copy()
                    for p in range(parts):
                        own, s, t = code[:, p].astype(np.int64), seen[:, p], stamp[:, p]
                        scans[0] += assign(x[:, p], book[p], net[p], own, s, t)
                        code[:, p], seen[:, p], stamp[:, p] = own, s, t
                for p in range(parts):
                    if last:
                        error += squared(x[:, p], book[p][code[:, p]])
                    else:
                        np.add.at(sums[p], code[:, p], x[:, p])
                        counts[p] += np.bincount(code[:, p], minlength=k)

                def packed(a):
                    return pa.array([r.tobytes() for r in a], pa.binary())
                new = {"_code": packed(code), "_error": pa.array(error), "_scans": pa.array(scans),
                       **({c: pa.nulls(n, pa.binary()) for c in ("_vector", "_seen", "_stamp")} if last else
                          {"_vector": packed(x.astype(np.int32)), "_seen": packed(seen), "_stamp": packed(stamp)})}
                yield pa.RecordBatch.from_arrays(
                    [new.get(f.name, batch.column(i)) for i, f in enumerate(schema)], schema=schema)
        if schema is not None and not last:
            found = [{"part": p, "entry": j, "n": int(counts[p, j]), "total": sums[p, j].tolist()}
                     for p, j in zip(*np.nonzero(counts), strict=True)]
            values = {"_sums": pa.array([found], schema.field("_sums").type)}
            yield pa.RecordBatch.from_arrays(
                [values.get(f.name, pa.nulls(1, f.type)) for f in schema], schema=schema)
    return run


def quantise(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", parts: int = 8,
             entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, Codebooks | None]:
    """``vectors`` with ``code`` (binary: a byte a part), ``error`` (exact squared distance) and
    ``scans`` (distances measured, summed by the rows of a batch on its first), and the codebooks.

    ``entries`` is at most 256 and ``rounds`` at most 250."""
    if not (0 < entries <= 256 and 0 <= rounds <= 250 and parts > 0):
        raise ValueError("entries must be 1..256, rounds 0..250 and parts positive")
    names = [c for c in vectors.columns if c.lower() not in ("code", "error", "scans")]
    v = F.col(quoted(vector))
    order = [F.col(quoted(vec_id)).asc_nulls_last(), F.col("_ints").asc()]
    sized = vectors.where(usable(v, scale, parts=parts)).withColumn("_ints", whole_numbers(v, scale))
    head = sized.orderBy(*order).select(F.size("_ints").alias("n")).limit(1).collect()
    none = {"code": "binary", "error": "long", "scans": "long"}
    if not head:
        return vectors.where(F.lit(False)).select(*[F.col(quoted(c)) for c in names], *[
            F.lit(None).cast(t).alias(c) for c, t in none.items()]), None
    length = head[0].n
    kept = vectors.where(usable(v, scale, length)).withColumn("_ints", whole_numbers(v, scale))
    start = np.array([r["_ints"] for r in kept.orderBy(*order).select("_ints").limit(entries).collect()], np.int64)
    books = Codebooks(start.reshape(len(start), parts, length // parts).transpose(1, 0, 2).copy())

    sums = "array<struct<part:int,entry:int,n:long,total:array<long>>>"
    types = {"_code": "binary", "_seen": "binary", "_stamp": "binary", "_error": "long", "_sums": sums}
    state = kept.select(
        *[F.col(quoted(c)) for c in names], F.col("_ints").alias("_vector"), F.lit(0).cast("long").alias("_scans"),
        *[F.lit(None).cast(t).alias(c) for c, t in types.items()])
    for i in range(rounds + 1):
        schema = StructType([StructField(f.name, BinaryType() if f.name == "_vector" else f.dataType)
                             for f in state.schema.fields])
        state = cut_lineage(state.where("_sums IS NULL").mapInArrow(round_of(books, i == rounds), schema))
        if i < rounds:
            each = state.where("_sums IS NOT NULL").select(F.explode("_sums").alias("s"))
            wide = each.select("s.part", "s.entry", "s.n", F.posexplode("s.total").alias("pos", "x"))
            total = wide.groupBy("part", "entry", "pos").agg(
                F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
            found: dict[tuple[int, int], tuple[int, list[int]]] = {}
            for r in sorted(total, key=lambda r: (r.part, r.entry, r.pos)):
                found.setdefault((r.part, r.entry), (r.n, []))[1].append(int(r.x))
            books.update(found)
    return state.select(*[F.col(quoted(c)) for c in names], F.col("_code").alias("code"),
                        F.col("_error").alias("error"), F.col("_scans").alias("scans")), books


def with_group_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """``coded`` with ``label_error``: the sum of ``error`` over the rows of equal label, nulls together."""
    name = free_name(coded, "_label")
    sums = coded.groupBy(F.col(quoted(label)).alias(name)).agg(F.sum("error").alias("label_error"))
    if sums.count() <= BROADCAST_ROWS:
        sums = F.broadcast(sums)
    base = coded.drop(*[c for c in coded.columns if c.lower() == "label_error"])
    return base.join(sums, F.col(quoted(label)).eqNullSafe(F.col(name)), "left").drop(name)
