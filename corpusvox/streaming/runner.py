"""Run a streaming plan over files that arrive in order, and read back its sink.

Used by the registered streaming queries and their tests: the input table is made once, then
arrives as ``n_slices`` writes of consecutive event times.  After each one the query runs with
``availableNow`` from its checkpoint, so a slice is one micro-batch however many files it has, and
all tasks write and read it.  The plan appends to a Parquet sink.  Source, checkpoint and sink live
under the session's shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusvox.session import cut_lineage, ensure_checkpoint_dir


def _root(spark: SparkSession) -> str:
    d = ensure_checkpoint_dir(spark)
    if not d:
        raise RuntimeError("spark.checkpoint.dir is not set")
    return d.rstrip("/") + f"/stream-{uuid.uuid4().hex}"


#: Off between slices, so that timers meet the next slice's rows before they fire, as within one run.
NO_DATA_CONF = "spark.sql.streaming.noDataMicroBatches.enabled"


def slices(df: DataFrame, time_col: str, n_slices: int = 4) -> list[DataFrame]:
    """``df`` as consecutive event-time slices; rows without a time come before all others."""
    t = F.unix_micros(F.col(time_col).cast("timestamp"))
    lo, hi = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if lo is None:
        return [df]
    width = (hi - lo) // n_slices + 1
    inside = [(t >= lo + i * width) & (t < lo + (i + 1) * width) for i in range(n_slices)]
    return [df.where(x | t.isNull() if i == 0 else x) for i, x in enumerate(inside)]


def write_slices(df: DataFrame, time_col: str, path: str, n_slices: int = 4) -> None:
    """Write the slices of ``df``, one write each."""
    for part in slices(df, time_col, n_slices):
        part.write.mode("append").parquet(path)


def run_available(spark: SparkSession, source: DataFrame, time_col: str,
                  plan: Callable[[DataFrame], DataFrame], n_slices: int = 4) -> DataFrame:
    """Replay ``source`` as an ordered file stream through ``plan``; return the sink as a table."""
    root = _root(spark)
    src, sink, ckpt = f"{root}/source", f"{root}/sink", f"{root}/checkpoint"
    parts = slices(cut_lineage(source), time_col, n_slices)
    no_data = spark.conf.get(NO_DATA_CONF)
    try:
        for i, part in enumerate(parts):
            part.write.mode("append").parquet(src)
            spark.conf.set(NO_DATA_CONF, no_data if i == len(parts) - 1 else "false")
            out = plan(spark.readStream.schema(source.schema).parquet(src))
            q = (out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
                 .outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
    finally:
        spark.conf.set(NO_DATA_CONF, no_data)
    return spark.read.schema(out.schema).parquet(sink)
