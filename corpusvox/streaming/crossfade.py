"""Cross-fade of consecutive chunks (ST7) with a batch twin.

Window: Hamming of length 2*ov.  Chunk i's first ov samples become
``x[k] * w[k] + tail[k] * w[ov + k]`` where ``tail`` is the previous chunk's
last ov samples; every chunk but the last holds its last ov samples back for
the next one.  The batch twin reads the previous tail with ``seq_lag`` and is
exact when a chunk has at least 2*ov samples (its tail is then untouched by
its own fade); the streaming operator keeps the faded tail in state.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvox.plans.sequence import B, seq_neighbors


def hamming(n: int) -> list[float]:
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)]


def crossfade_batch(chunks: DataFrame, stream: str, order: list[str], samples: str, ov: int) -> DataFrame:
    w = hamming(2 * ov)
    win_in = F.array(*[F.lit(v) for v in w[:ov]])
    win_out = F.array(*[F.lit(v) for v in w[ov:]])
    x = chunks.select(stream, *order, F.transform(samples, lambda v: v.cast("double")).alias("_x"))
    x = x.withColumn("_tail", F.slice("_x", -ov, ov))
    x = seq_neighbors(x, [stream], order, prev=["_tail"], next=[order[0]]).drop(B)
    head = F.zip_with(F.zip_with(F.slice("_x", 1, ov), win_in, lambda a, b: a * b),
                      F.zip_with(F.col("_tail_prev"), win_out, lambda a, b: a * b), lambda a, b: a + b)
    faded = F.when(F.col("_tail_prev").isNull(), F.col("_x")) \
        .otherwise(F.concat(head, F.slice("_x", ov + 1, F.greatest(F.size("_x") - ov, F.lit(0)))))
    last = F.col(order[0] + "_next").isNull()
    out = F.when(last, faded).otherwise(F.slice(faded, 1, F.greatest(F.size(faded) - ov, F.lit(0))))
    return x.select(stream, *order, out.alias("out"))


OUT = T.StructType([T.StructField("stream", T.LongType()), T.StructField("chunk", T.LongType()),
                    T.StructField("out", T.ArrayType(T.DoubleType()))])
STATE = T.StructType([T.StructField("tail", T.ArrayType(T.DoubleType()))])


def crossfade_stream(chunks: DataFrame, stream: str, chunk: str, samples: str, final: str, ov: int) -> DataFrame:
    """Streaming ST7: state = the faded tail of the last emitted chunk."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    w = np.array(hamming(2 * ov))
    prepared = chunks.select(F.col(stream).cast("long").alias("stream"), F.col(chunk).cast("long").alias("chunk"),
                             F.col(samples).alias("x"), F.col(final).cast("boolean").alias("final"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        tail = np.array(state.get[0]) if state.exists else None
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("chunk")
        rows = []
        for c, x, fin in zip(pdf["chunk"], pdf["x"], pdf["final"]):
            x = np.asarray(x, dtype=float).copy()
            if tail is not None:
                x[:ov] = x[:ov] * w[:ov] + tail * w[ov:]
            tail = x[-ov:].copy()
            rows.append((int(key[0]), int(c), (x if fin else x[:-ov]).tolist()))
            if fin:
                state.remove()
                tail = None
                break
        if tail is not None:
            state.update((tail.tolist(),))
        if rows:
            yield pd.DataFrame(rows, columns=["stream", "chunk", "out"])

    return prepared.groupBy("stream").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
