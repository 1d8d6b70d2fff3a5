"""Frame stacking over long-form frames (W7 at scale) and its online form (ST4).

Output i of an utterance with T frames stacks m frames at positions
p = n*i + j - (m-1)//2 (j < m), each read from frame clamp(p, 0, T-1); there
are ceil(T/n) outputs.  The batch form sends every frame to the (i, j) slots
that read it (the first and last frames also fill the padded slots) and
groups by (utterance, i): a group holds m values, so no utterance is ever
collected into one row.  The streaming form keeps the frames still needed by
pending outputs in state and flushes the padded tail on the final frame.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lfr_long(frames: DataFrame, utt: str, t: str, x: str, m: int = 7, n: int = 6) -> DataFrame:
    """(utt, t, x) -> (utt, i, stacked ARRAY) with x a scalar or an array per frame."""
    pad = (m - 1) // 2
    lens = frames.groupBy(utt).agg(F.count(F.lit(1)).alias("_T"))
    f = frames.select(utt, t, x).join(lens, utt)
    n_out = F.ceil(F.col("_T") / n).cast("long")
    p_max = n * (n_out - 1) + (m - 1) - pad
    p_lo = F.when(F.col(t) == 0, F.lit(-pad)).otherwise(F.col(t)).cast("long")
    p_hi = F.when(F.col(t) == F.col("_T") - 1, F.greatest(p_max, F.col(t))).otherwise(F.col(t)).cast("long")
    f = f.withColumn("_p", F.explode(F.sequence(p_lo, p_hi)))
    i_lo = F.greatest(F.lit(0), F.ceil((F.col("_p") + pad - (m - 1)) / n)).cast("long")
    i_hi = F.least(n_out - 1, F.floor((F.col("_p") + pad) / n)).cast("long")
    f = f.where(i_hi >= i_lo).withColumn("i", F.explode(F.sequence(i_lo, i_hi)))
    f = f.withColumn("j", F.col("_p") - F.col("i") * n + pad)
    g = f.groupBy(utt, "i").agg(F.array_sort(F.collect_list(F.struct("j", F.col(x).alias("v")))).alias("_s"))
    return g.select(utt, "i", F.transform("_s", lambda s: s["v"]).alias("stacked"))


OUT = T.StructType([T.StructField("utt", T.LongType()), T.StructField("i", T.LongType()),
                    T.StructField("stacked", T.ArrayType(T.DoubleType()))])
STATE = T.StructType([T.StructField("first", T.DoubleType()), T.StructField("base", T.LongType()),
                      T.StructField("buf", T.ArrayType(T.DoubleType())), T.StructField("next_i", T.LongType())])


def lfr_stream(frames: DataFrame, utt: str, t: str, x: str, final: str, m: int = 7, n: int = 6) -> DataFrame:
    """ST4: online stacking of scalar frames; state = first frame, the buffered
    frames from ``base`` on, and the next output index."""
    from pyspark.sql.streaming.state import GroupStateTimeout
    pad = (m - 1) // 2
    prepared = frames.select(F.col(utt).cast("long").alias("utt"), F.col(t).cast("long").alias("t"),
                             F.col(x).cast("double").alias("x"), F.col(final).cast("boolean").alias("final"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            first, base, buf, nxt = state.get
            buf = list(buf)
        else:
            first, base, buf, nxt = None, 0, [], 0
        pdf = pd.concat(list(batches), ignore_index=True).sort_values("t")
        rows, done = [], False
        for v, fin in zip(pdf["x"], pdf["final"]):
            if first is None:
                first = float(v)
            buf.append(float(v))
            total = base + len(buf)          # frames seen so far
            while n * nxt + (m - 1) - pad <= total - 1:   # output window complete
                rows.append((int(key[0]), nxt, [buf[min(max(p, 0), total - 1) - base] if p >= 0 else first
                                                for p in range(n * nxt - pad, n * nxt - pad + m)]))
                nxt += 1
            if fin:
                n_out = -(-total // n)
                while nxt < n_out:
                    rows.append((int(key[0]), nxt, [first if p < 0 else buf[min(p, total - 1) - base]
                                                    for p in range(n * nxt - pad, n * nxt - pad + m)]))
                    nxt += 1
                done = True
                break
            keep_from = max(0, n * nxt - pad)
            if keep_from > base:
                buf = buf[keep_from - base:]
                base = keep_from
        if done:
            state.remove()
        else:
            state.update((first, base, buf, nxt))
        if rows:
            yield pd.DataFrame(rows, columns=["utt", "i", "stacked"])

    return prepared.groupBy("utt").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
