"""Noise level and speech gate over scored frames (W12), as a scan of affine maps.

Frames that fail the speech score (and are not below ``decibel_thres``) are noise: the first one of
a session sets the noise level, each later one moves it to (db + level * (n - 1)) / n.  A frame
that passes the score stays speech only if its decibels reach ``decibel_thres`` and exceed the
level before it by ``snr_thres``.

Any stretch of frames maps the level before it to the level after it by x -> p x + q.  A long
session is cut into buckets: each bucket finds the map of each of its prefixes, the maps of whole
buckets (two numbers each) are composed along the session, and every row then gets its level from
its bucket's entry level by one multiplication.  So no task reads a whole session and no bucket
runs twice.  Only the session's first noise frame is no affine step of the level; counts of noise
frames per bucket say which bucket holds it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusvox.plans.sequence import B, _null_safe_join, is_whole, range_buckets

#: The level of a session without a noise frame so far.
NO_LEVEL = -100.0
#: Noise frames scanned with one cumulative sum; a power of (n - 1) / n over so many stays in range.
BLOCK = 64


def prefix_maps(noise: np.ndarray, db: np.ndarray, n: int, fresh: bool) -> tuple[np.ndarray, np.ndarray]:
    """(p, q) of the map over the first i frames, for i = 0 .. len; ``fresh``: no noise frame before."""
    keep = (n - 1) / n
    x = db[noise]
    p = np.concatenate(([1.0], keep ** np.arange(1, len(x) + 1)))
    q = np.zeros(len(x) + 1)
    at = 0
    if fresh and len(x):
        p[1:], q[1], at = 0.0, x[0], 1
    while at < len(x):
        part = x[at:at + BLOCK] / n
        power = keep ** np.arange(1, len(part) + 1) if keep else np.zeros(len(part))
        q[at + 1:at + 1 + len(part)] = power * (q[at] + np.cumsum(part / power)) if keep else part
        at += len(part)
    seen = np.concatenate(([0], np.cumsum(noise)))
    return p[seen], q[seen]


def noise_gate(frames: DataFrame, session: str, order: Sequence[str], speech: str, db: str, n: int = 100,
               snr_thres: float = -100.0, decibel_thres: float = -100.0, rows_per_bucket: int | None = None) -> DataFrame:
    """``frames`` with ``noise_level`` (before the frame, in dB) and ``gated`` (speech that passes the gate)."""
    order = list(order)
    is_noise = ~F.col(speech).cast("boolean") & (F.col(db) >= decibel_thres)
    rows = range_buckets(frames.withColumn("_noise", F.coalesce(is_noise, F.lit(False))), [session], order, rows_per_bucket)
    whole = is_whole(rows)
    chain = Window.partitionBy(session).orderBy(B)
    if whole:
        rows = rows.withColumn("_fresh", F.lit(True))
    else:
        counts = rows.groupBy(session, B).agg(F.sum(F.col("_noise").cast("int")).alias("k"))
        fresh = counts.select(session, B, (F.sum("k").over(chain) - F.col("k") == 0).alias("_fresh"))
        rows = _null_safe_join(rows, fresh, [session, B])
    rows = rows.repartition(session, B).sortWithinPartitions(session, B, *order)
    added = ("_p", "_q", "_p_end", "_q_end")
    schema = StructType([*rows.schema.fields, *[StructField(c, DoubleType()) for c in added]])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, p0, q0, fresh = None, 1.0, 0.0, True
        for b in batches:
            if not b.num_rows:
                continue
            column = dict(zip(b.schema.names, b.columns))
            noise = column["_noise"].to_numpy(zero_copy_only=False).astype(bool)
            x = column[db].to_numpy(zero_copy_only=False).astype(float)
            bucket, starts = column[B].to_numpy(), column["_fresh"].to_numpy(zero_copy_only=False)
            key = column[session].dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = np.flatnonzero((np.diff(key) != 0) | (np.diff(bucket) != 0)) + 1
            out = np.empty((4, b.num_rows))
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                here = (column[session][lo].as_py(), int(bucket[lo]))
                if here != at:
                    at, p0, q0, fresh = here, 1.0, 0.0, bool(starts[lo])
                p, q = prefix_maps(noise[lo:hi], x[lo:hi], n, fresh)
                fresh = fresh and not noise[lo:hi].any()
                p, q = p * p0, p * q0 + q
                out[:, lo:hi] = p[:-1], q[:-1], p[1:], q[1:]
                p0, q0 = p[-1], q[-1]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out)], [*b.schema.names, *added])
    maps = rows.mapInArrow(scan, schema)
    if whole:
        out = maps.withColumn("_entry", F.lit(NO_LEVEL))
    else:
        place = F.struct(*order)
        ends = maps.groupBy(session, B).agg(F.max_by(F.struct("_p_end", "_q_end"), place).alias("m"))
        per_key = ends.groupBy(session).agg(F.array_sort(F.collect_list(F.struct(B, "m"))).alias("ms"))
        step = F.aggregate("ms", F.array(F.lit(NO_LEVEL)), lambda acc, x: F.concat(acc, F.array(
            x["m"]["_p_end"] * F.element_at(acc, -1) + x["m"]["_q_end"])))
        entry = per_key.select(session, F.explode(F.arrays_zip(F.transform("ms", lambda x: x[B]).alias("b"),
                                                               F.slice(step, 1, F.size("ms")).alias("level"))).alias("e")).select(
            session, F.col("e.b").alias(B), F.col("e.level").alias("_entry"))
        out = _null_safe_join(maps, entry, [session, B])
    level = F.col("_p") * F.col("_entry") + F.col("_q")
    out = out.withColumn("noise_level", level)
    passes = F.col(speech).cast("boolean") & (F.col(db) >= decibel_thres) & (F.col(db) - F.col("noise_level") >= snr_thres)
    return out.withColumn("gated", F.coalesce(passes, F.lit(False))).drop(
        B, "_noise", "_fresh", "_p", "_q", "_p_end", "_q_end", "_entry")
