"""Quality grades by ordinal cumulative-link regression on hashed text.

A text is a set of hashed features: its words, the first bytes of its words, and coarse shape
classes (share of capitals and of symbols, repetition).  All grades share one weight vector w;
with ordered thresholds t the model says P(grade <= g_k) = sigmoid(t_k - w.x).  The result is
the expected grade and the probability of a grade of at least ``good``.

The fit takes a sample of rated rows that is bounded by ``max_rows`` (in expectation, by a hash
of the id) and weighs only features that occur in ``min_share`` of it, so the model's size does
not grow with the input.  Each step's gradient is a sum of one row per task.

Defined results: a null text counts as empty and has shape features only; rows without an id,
a rating or a text to join are not learned from; several ratings of an id each count; with no
ratings at all every text gets a null grade and a null probability; repeated rows each get a
row; columns of the input that carry a result's name are replaced, other extra columns pass
through.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from corpusvox.llm.common import free_name, prepare, quoted, rows_udf, with_fields
from corpusvox.session import cut_lineage

FEATURES = StructType([StructField("x", ArrayType(IntegerType()))])
SCORE = StructType([StructField("eta", DoubleType())])
SIGNS = b"#*$%&|<>!"
AS_WORDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
NOT_SIGN = bytes(c for c in range(256) if c not in SIGNS)


@dataclass(frozen=True)
class Limits:
    """Bounds of the sample and the model, and the steps of the fit."""
    max_rows: int = 20_000
    bits: int = 18
    min_share: float = 0.003
    steps: int = 60
    rate: float = 0.1
    decay: float = 3e-4
    tasks: int = 6


@dataclass(frozen=True)
class Model:
    grades: list[float]
    weights: np.ndarray
    thresholds: np.ndarray


class Buckets(dict):
    """Feature -> hash bucket, remembered; starts anew when it has grown large."""

    def __init__(self, bits: int) -> None:
        super().__init__()
        self.mask = (1 << bits) - 1

    def __missing__(self, feature: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        bucket = self[feature] = zlib.crc32(feature) & self.mask
        return bucket


def features(data: bytes | None, bucket) -> np.ndarray:
    """The distinct buckets of a text."""
    data = data or b""
    words = data.lower().translate(AS_WORDS).split()
    found = set(words)
    shape = [min(9, 40 * len(data.translate(None, other)) // max(len(data), 1)) for other in (NOT_UPPER, NOT_SIGN)]
    repeat = min(12, int(2 * math.log2((len(words) + 1) / max(len(found), 1))))
    found |= {b"^" + w[:4] for w in found}
    found |= {b"\0upper%d" % shape[0], b"\0sign%d" % shape[1], b"\0repeat%d" % repeat}
    return np.unique(np.fromiter(map(bucket, found), np.int32, len(found)))


def feature_column(text: Column, bits: int) -> Column:
    def make(bits=bits):
        bucket = Buckets(bits).__getitem__
        return lambda rows: [(features(x, bucket),) for x in rows]
    return rows_udf(make, FEATURES)(text.cast("binary"))["x"]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40.0, 40.0)))


def gradient(eta: np.ndarray, y: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the negative log likelihood: by each row's eta, and by each threshold."""
    k = len(thresholds)
    f = np.zeros((len(y), k + 2))
    f[:, -1] = 1.0
    f[:, 1:-1] = sigmoid(thresholds[None, :] - eta[:, None])
    d = f * (1.0 - f)
    row = np.arange(len(y))
    p = np.maximum(f[row, y + 1] - f[row, y], 1e-9)
    up, down = d[row, y + 1] / p, d[row, y] / p
    by_threshold = np.array([down[y == j + 1].sum() - up[y == j].sum() for j in range(k)])
    return up - down, by_threshold


def fit(ratings: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade",
        limits: Limits = Limits()) -> Model:
    """Learn from ``ratings`` (doc_id, grade) of the texts in ``docs``."""
    spark = docs.sparkSession
    sc = prepare(spark).sparkContext
    rated = ratings.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(grade)).cast("double").alias("g"))
    rated = rated.where("id IS NOT NULL AND g IS NOT NULL")
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    sample = cut_lineage(rated.where(u < limits.max_rows / max(1, rated.count())))
    grades = [r["g"] for r in sample.select("g").distinct().orderBy("g").collect()]
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("t")).join(
        F.broadcast(sample), "id")  # at most about max_rows narrow rows
    rows = cut_lineage(rows.select("g", feature_column(F.col("t"), limits.bits).alias("x")))
    n = rows.count()
    if len(grades) < 2 or not n:
        return Model(grades, np.zeros(1 << limits.bits, np.float32), np.zeros(max(0, len(grades) - 1)))
    often = rows.select(F.explode("x").alias("b")).groupBy("b").count().where(
        F.col("count") >= max(3, math.ceil(limits.min_share * n)))
    kept = np.sort(np.array([r["b"] for r in often.collect()], np.int64))
    at = np.full(1 << limits.bits, -1, np.int64)
    at[kept] = np.arange(len(kept))
    place, known = sc.broadcast(at), sc.broadcast(np.array(grades))

    def narrowed(batches):
        for b in batches:
            x = b.column(1)
            y = np.searchsorted(known.value, b.column(0).to_numpy(zero_copy_only=False))
            mapped = place.value[x.values.to_numpy(zero_copy_only=False)[x.offsets[0].as_py():x.offsets[-1].as_py()]]
            ends = np.concatenate(([0], np.cumsum(mapped >= 0)))[x.offsets.to_numpy() - x.offsets[0].as_py()]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(mapped[mapped >= 0], pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), lists], names=["y", "x"])

    data = cut_lineage(rows.mapInArrow(narrowed, "y int, x array<int>").coalesce(limits.tasks))
    size, k = len(kept), len(grades) - 1
    share = np.array([r["count"] for r in data.groupBy("y").count().orderBy("y").collect()], float)
    under = np.clip(np.cumsum(share)[:-1] / n, 1e-6, 1 - 1e-6)
    start = np.log(under / (1 - under))
    params = np.concatenate((np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 1e-3))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, limits.steps + 1):
        thresholds = np.cumsum(np.concatenate((params[size:size + 1], np.exp(params[size + 1:]))))
        now = sc.broadcast((params[:size].copy(), thresholds))

        def slopes(batches, now=now):
            w, t = now.value
            total = np.zeros(len(w) + len(t))
            for b in batches:
                y, x = b.column(0).to_numpy(), b.column(1)
                first = x.offsets[0].as_py()
                idx = x.values.to_numpy(zero_copy_only=False)[first:x.offsets[-1].as_py()]
                row = np.repeat(np.arange(len(y)), np.diff(x.offsets.to_numpy()))
                by_eta, by_t = gradient(np.bincount(row, w[idx], minlength=len(y)), y, t)
                total[:len(w)] += np.bincount(idx, by_eta[row], minlength=len(w))
                total[len(w):] += by_t
            yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

        g = sum(np.frombuffer(r["g"]) for r in data.mapInArrow(slopes, "g binary").collect()) / n
        now.unpersist()
        by_t = g[size:]
        later = np.cumsum(by_t[::-1])[::-1]
        g = np.concatenate((g[:size] + limits.decay * params[:size], later[:1],
                            later[1:] * np.exp(params[size + 1:])))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = limits.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
        move[size:] *= 0.3
        params = params - move
    weights = np.zeros(1 << limits.bits, np.float32)
    weights[kept] = params[:size]
    return Model(grades, weights, np.cumsum(np.concatenate((params[size:size + 1], np.exp(params[size + 1:size + k])))))


def grade_texts(docs: DataFrame, model: Model, text: str = "text", good: float | None = None,
                least: float = 0.5, bits: int = Limits.bits) -> DataFrame:
    """``docs`` with expected_grade, tail_prob (of a grade of ``good`` at least; default the best) and kept."""
    names = ["expected_grade", "tail_prob", "kept"]
    if len(model.grades) < 2:
        one = F.lit(None).cast("double")
        return with_fields(docs, F.struct(one.alias(names[0]), one.alias(names[1]), F.lit(True).alias(names[2])), names)
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model.weights)

    def make(shared=shared, bits=bits):
        bucket, w = Buckets(bits).__getitem__, shared.value
        return lambda rows: [(float(w[features(x, bucket)].sum(dtype=np.float64)),) for x in rows]
    tmp = free_name(docs, "_eta")
    rows = docs.withColumn(tmp, rows_udf(make, SCORE)(F.col(quoted(text)).cast("binary"))["eta"])
    above = [F.lit(1.0) / (1.0 + F.exp(F.lit(float(t)) - F.col(quoted(tmp)))) for t in model.thresholds]
    gaps = np.diff(model.grades)
    expected = sum((F.lit(float(d)) * p for d, p in zip(gaps, above, strict=True)), F.lit(float(model.grades[0])))
    target = model.grades[-1] if good is None else good
    below = sum(g < target for g in model.grades)
    tail = F.lit(1.0) if below == 0 else F.lit(0.0) if below > len(above) else above[below - 1]
    out = with_fields(rows, F.struct(expected.alias(names[0]), tail.alias(names[1]), (tail >= least).alias(names[2])), names)
    return out.drop(tmp)
