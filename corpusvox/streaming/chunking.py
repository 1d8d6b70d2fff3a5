"""Re-chunking a per-session stream (ST3, ST6) with a batch twin.

A chunk schedule is a list of leading chunk sizes followed by a steady size:
``(15, 24)`` then 48 gives chunks of 15, 24, 48, 48, ... (ST6); a constant
stride is ``()`` then n (ST3).  The stream keeps the not-yet-full remainder in
state and emits full chunks as they complete; the final flag emits the short
tail and drops the state.  The batch twin numbers items with the scalable row
number and maps item index -> chunk with the same schedule.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvox.plans.sequence import seq_row_number

CHUNK_SCHEMA = T.StructType([
    T.StructField("session", T.LongType()), T.StructField("chunk", T.LongType()),
    T.StructField("n_items", T.LongType()), T.StructField("total", T.DoubleType()),
])
STATE_SCHEMA = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("pending", T.ArrayType(T.DoubleType())),
])


def chunk_of(idx: Column, lead: Sequence[int], steady: int) -> Column:
    """Chunk number of a 0-based item index under the schedule."""
    bounds = np.cumsum(lead).tolist() if lead else []
    expr = None
    start = 0
    for i, b in enumerate(bounds):
        cond = idx < b
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
        start = b
    tail = F.lit(len(bounds)) + F.floor((idx - start) / steady)
    return (tail if expr is None else expr.otherwise(tail)).cast("long")


def size_of(chunk: int, lead: Sequence[int], steady: int) -> int:
    return lead[chunk] if chunk < len(lead) else steady


def rechunk_batch(items: DataFrame, session: str, order: list[str], value: str,
                  lead: Sequence[int] = (), steady: int = 7) -> DataFrame:
    """Batch twin: every chunk including the final short tail."""
    x = seq_row_number(items.select(F.col(session).cast("long").alias("session"), *order,
                                    F.col(value).cast("double").alias("v")), ["session"], order, "_rn")
    x = x.withColumn("chunk", chunk_of(F.col("_rn") - 1, lead, steady))
    return x.groupBy("session", "chunk").agg(F.count(F.lit(1)).alias("n_items"), F.sum("v").alias("total"))


def rechunk_stream(items: DataFrame, session: str, order: list[str], value: str, final: str,
                   lead: Sequence[int] = (), steady: int = 7) -> DataFrame:
    """Streaming ST3/ST6: emit each chunk once it is full; the final item flushes the tail."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    prepared = items.select(F.col(session).cast("long").alias("session"), *order,
                            F.col(value).cast("double").alias("v"), F.col(final).cast("boolean").alias("final"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chunk, pending = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        rows = []
        for v, fin in zip(pdf["v"].to_numpy(), pdf["final"].to_numpy()):
            pending.append(float(v))
            if len(pending) == size_of(chunk, lead, steady):
                rows.append((int(key[0]), chunk, len(pending), float(np.sum(pending))))
                chunk, pending = chunk + 1, []
            if fin:
                if pending:
                    rows.append((int(key[0]), chunk, len(pending), float(np.sum(pending))))
                state.remove()
                break
        else:
            state.update((chunk, pending))
        if rows:
            yield pd.DataFrame(rows, columns=CHUNK_SCHEMA.fieldNames())

    return prepared.groupBy("session").applyInPandasWithState(step, CHUNK_SCHEMA, STATE_SCHEMA, "append",
                                                               GroupStateTimeout.NoTimeout)
