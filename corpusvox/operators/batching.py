"""Sharding, shuffling, sorting and batching (T*, B*, K2/K6 ids).

Every rule here needs a row's position in some order.  Positions come from
``plans.sequence.seq_row_number`` (range buckets + per-bucket offsets), never
from a window without ``partitionBy``.  Randomness is a hash of
(seed, epoch, key), so a recomputed task gets the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvox.plans.sequence import _null_safe_join, seq_cumsum, seq_row_number


def with_position(df: DataFrame, order: Sequence[str], name: str = "pos") -> DataFrame:
    """0-based global position in ``order`` (which must be total)."""
    out = seq_row_number(df, [], list(order), name).drop("_seq_b")
    return out.withColumn(name, F.col(name) - 1)


def hash_key(seed: int, epoch: int, key) -> Column:
    """Deterministic shuffle key: md5 of 'seed:epoch:key' (hex, ordered as text)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), k.cast("string")))


def epoch_shuffle(df: DataFrame, key: str, epoch: int, seed: int = 0, name: str = "pos") -> DataFrame:
    """A fresh global order per epoch."""
    return with_position(df.withColumn("_shuf", hash_key(seed, epoch, key)), ["_shuf", key], name).drop("_shuf")


def rank_slice(df: DataFrame, pos: str, n: int, world: int, drop_remainder: bool = True) -> DataFrame:
    """B1: contiguous slices of n // world rows; the remainder is dropped (or kept by the last rank)."""
    per = n // world
    if per == 0:
        return df.where(F.lit(False)).withColumn("rank", F.lit(0))
    rank = F.floor(F.col(pos) / per).cast("int")
    if drop_remainder:
        return df.withColumn("rank", rank).where(F.col("rank") < world)
    return df.withColumn("rank", F.least(rank, F.lit(world - 1)))


def strided_shard(df: DataFrame, pos: str, n: int, world: int, num_workers: int = 1) -> DataFrame:
    """B2: rank = slot % world, then worker = slot-in-rank % num_workers; when there are
    fewer items than shards the list is repeated to fill them (rows may appear twice)."""
    total = max(n, world)
    copies = -(-world // n) if 0 < n < world else 1
    out = df.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))) \
        .withColumn("_slot", F.col(pos) + F.col("_c") * n).where(F.col("_slot") < total)
    out = out.withColumn("rank", (F.col("_slot") % world).cast("int")) \
             .withColumn("_p", F.floor(F.col("_slot") / world))
    # items per rank, then the same fill rule for workers
    m = F.floor((F.lit(total) - F.col("rank") + world - 1) / world)
    copies2 = F.when(m < num_workers, F.ceil(F.lit(num_workers) / m)).otherwise(F.lit(1)).cast("int")
    out = out.withColumn("_c2", F.explode(F.sequence(F.lit(0), copies2 - 1))) \
        .withColumn("_slot2", F.col("_p") + F.col("_c2") * m) \
        .where(F.col("_slot2") < F.greatest(m, F.lit(num_workers)))
    return out.withColumn("worker", (F.col("_slot2") % num_workers).cast("int")) \
        .drop("_c", "_slot", "_p", "_c2", "_slot2")


def buffer_order(df: DataFrame, pos: str, buffer_size: int, within: Sequence[Column | str],
                 name: str = "idx") -> DataFrame:
    """Consecutive buffers of ``buffer_size`` rows (by position), re-ordered
    inside each buffer.  A buffer is bounded, so the window over it is too."""
    b = df.withColumn("buffer", F.floor(F.col(pos) / buffer_size).cast("long"))
    w = Window.partitionBy("buffer").orderBy(*within, F.col(pos))
    return b.withColumn(name, (F.row_number().over(w) - 1).cast("long"))


def rank_full_batches(df: DataFrame, pos: str, batch_size: int, world: int) -> DataFrame:
    """Global batches of batch_size*world rows; rank r takes slice r."""
    g = batch_size * world
    return df.withColumn("batch", F.floor(F.col(pos) / g).cast("long")) \
             .withColumn("rank", F.floor((F.col(pos) % g) / batch_size).cast("int"))


def shard_ids(df: DataFrame, pos: str, rows_per_shard: int = 1000) -> DataFrame:
    """K2: shard = floor(pos / N) over the key order."""
    return df.withColumn("shard", F.floor(F.col(pos) / rows_per_shard).cast("long"))


def aligned_slices(df: DataFrame, pos: str, n: int, nj: int) -> DataFrame:
    """K6: nj slices of n // nj rows; the remainder goes to the last slice."""
    per = max(n // nj, 1)
    return df.withColumn("slice", F.least(F.floor(F.col(pos) / per), F.lit(nj - 1)).cast("int"))


BATCH_SCHEMA = T.StructType([T.StructField("buffer", T.LongType()), T.StructField("idx", T.LongType()),
                             T.StructField("batch_in_buffer", T.IntegerType())])


def _greedy(budget: int, kind: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        lens = pdf["length"].to_numpy()
        out = np.zeros(len(pdf), dtype=np.int32)
        b, longest, count = 0, 0, 0
        for i, ln in enumerate(lens):
            new_longest = max(longest, ln)
            cost = (count + 1) if kind == "example" else new_longest * (count + 1)
            if count > 0 and cost > budget:
                b, longest, count = b + 1, ln, 1
            else:
                longest, count = new_longest, count + 1
            out[i] = b
        return pd.DataFrame({"buffer": pdf["buffer"].to_numpy(), "idx": pdf["idx"].to_numpy(),
                             "batch_in_buffer": out})
    return run


def dynamic_batches(buffered: DataFrame, length: str, budget: int = 2000, kind: str = "frame") -> DataFrame:
    """Greedy batches inside each sort buffer: a new batch starts when
    ``max_len * (count + 1) > budget`` (``kind='example'`` counts rows).  An
    oversized first row forms its own batch (no empty batches).  Batches never
    cross a buffer, so each group is bounded by the buffer size.

    Input needs ``buffer`` and ``idx`` (from ``buffer_order``).  Adds ``batch_in_buffer``
    and a global ``batch_id`` = dense rank of (buffer, batch_in_buffer)."""
    keyed = buffered.select("buffer", "idx", F.col(length).alias("length"))
    ids = keyed.groupBy("buffer").applyInPandas(_greedy(budget, kind), BATCH_SCHEMA)
    out = buffered.join(ids, ["buffer", "idx"])
    # batch ids: offsets from per-buffer batch counts (one row per buffer)
    per = ids.groupBy("buffer").agg((F.max("batch_in_buffer") + 1).cast("long").alias("_nb"))
    per = seq_cumsum(per, [], ["buffer"], {"_off": F.col("_nb")}).withColumn("_off", F.col("_off") - F.col("_nb"))
    return out.join(per.select("buffer", "_off"), "buffer") \
        .withColumn("batch_id", (F.col("_off") + F.col("batch_in_buffer")).cast("long")).drop("_off")


def local_batches(df: DataFrame, pos: str, length: str, buffer_size: int = 30, most: int = 5000, budget: int = 2000,
                  kind: str = "frame") -> DataFrame:
    """Buffers of ``buffer_size`` rows in arrival order, rows longer than ``most`` dropped, each
    buffer sorted by length and cut greedily (see ``dynamic_batches``; batches end with their buffer)."""
    kept = df.withColumn("buffer", F.floor(F.col(pos) / buffer_size).cast("long")).where(F.col(length) <= most)
    w = Window.partitionBy("buffer").orderBy(length, pos)  # at most buffer_size rows
    return dynamic_batches(kept.withColumn("idx", (F.row_number().over(w) - 1).cast("long")), length, budget, kind)


def batch_stats(batched: DataFrame, length: str, batch: str = "batch_id") -> DataFrame:
    """Per batch count, max length, padded size and padding share."""
    return batched.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(length).alias("max_len"),
                                      F.sum(length).alias("sum_len")) \
        .withColumn("padded", F.col("n") * F.col("max_len")) \
        .withColumn("pad_share", 1 - F.col("sum_len") / F.col("padded"))


def top_n(df: DataFrame, group: Sequence[str], score: str, n: int, tie: str) -> DataFrame:
    """T4/T5: best n per group by score desc (tie -> lower ``tie``); Catalyst plans a WindowGroupLimit."""
    w = Window.partitionBy(*group).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def best_of(df: DataFrame, group: Sequence[str], item: str, logprob: str, length: str,
            length_penalty: float | None = None, idx: str | None = None) -> DataFrame:
    """Argmax of logprob/len (or logprob/((5+len)/6)^p); first maximum wins.
    A partial aggregate, so a group with many candidates is combined map-side."""
    ln = F.col(length).cast("double")
    penalty = ln if length_penalty is None else F.pow((5 + ln) / 6, length_penalty)
    score = F.col(logprob) / penalty
    order_idx = F.col(idx or item)
    return df.groupBy(*group).agg(F.max_by(F.col(item), F.struct(score, -order_idx)).alias("best"))


class DurationChain:
    """Greedy batches by duration as a map from entry to exit state, for ``chained_fold``.

    State: the running sum of the open batch, null before the first row.  The row that begins a bucket decides whether the batch
    goes on, so a batch's end is known with the next row; batch numbers count the ends before."""

    fields = "idx long, batch long"

    def __init__(self, budget_ms: int, long_ms: int) -> None:
        self.budget_ms, self.long_ms = budget_ms, long_ms

    def guess(self, offset: int) -> tuple:
        return (0 if offset else None,)

    def run(self, state: tuple, batches: Iterator[pd.DataFrame], last: bool) -> tuple[tuple, list, int]:
        (cum,), ends, out = state, 0, []
        for b in batches:
            budgets = b["least"].clip(lower=self.budget_ms)
            for i, d, budget in zip(b["idx"].tolist(), b["dur"].tolist(), budgets.tolist(), strict=True):
                if cum is not None and not (cum + d < budget and d < self.long_ms):
                    ends, cum = ends + 1, 0
                cum = (cum or 0) + d
                out.append((i, ends))
        return (cum,), out, ends


def duration_batches(seg: DataFrame, rec: str, idx: str, dur: str, budget_ms: int = 300_000,
                     long_ms: int = 60_000, rows_per_bucket: int | None = None) -> DataFrame:
    """Per recording, segments in ascending duration (then index); the batch
    continues while the running sum plus the next duration stays under the budget
    (at least the shortest duration) and the next segment is shorter than
    ``long_ms``.  A recording of many segments is cut into buckets that run at once
    (see ``chained_fold``)."""
    from corpusvox.plans.chained import chained_fold

    rows = seg.select(F.col(rec).cast("long").alias("rec"), F.col(idx).cast("long").alias("idx"),
                      F.col(dur).cast("long").alias("dur"))
    rows = _null_safe_join(rows, rows.groupBy("rec").agg(F.min("dur").alias("least")), ["rec"])
    out = chained_fold(rows, "rec", ["dur", "idx"], ["least"], DurationChain(budget_ms, long_ms), rows_per_bucket)
    return out.select("rec", "idx", (F.col("_before") + F.col("batch")).cast("int").alias("batch"))
