"""Live speech sessions with time-outs (ST2, ST8) by ``transformWithStateInPandas``.

State per session: the segmentation fold and the time of its last frame, in a value state.  A
frame that comes more than ``timeout_ms`` after the last one begins a new visit, named by the time
of its first frame: the open segment is closed first and the fold starts anew.  A timer at the last frame's time plus the time-out does
the same when nothing comes any more, and clears the state.  Closed segments are emitted as
[beg, end], a segment that is open at the end of a micro-batch as [beg, NULL].

On the event clock timers fire when the watermark passes, so a replay gives the same rows as a
live run.  On the processing clock the time of arrival counts, and the state also has a
time-to-live of twice the time-out.  The state store must be RocksDB (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusvox.streaming.vad import VadConfig, VadFold

OUT = "session long, began_ms long, seg long, beg_ms long, end_ms long"
FOLD = ("frame long, in_speech boolean, window array<int>, beg long, low_run long, floor long, seg long, "
        "began long, last long")
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Sessions(StatefulProcessor):
    def __init__(self, cfg: VadConfig, timeout_ms: int, order: list[str], event_clock: bool) -> None:
        self.cfg, self.timeout_ms, self.order, self.event_clock = cfg, timeout_ms, order, event_clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keep = {} if self.event_clock else {"ttlDurationMs": 2 * self.timeout_ms}
        self.state = handle.getValueState("fold", FOLD, **keep)

    def closed(self, key: int, began: int, segments: list) -> list[tuple]:
        ms = self.cfg.frame_ms
        return [(key, began, int(s), int(b) * ms, int(e) * ms) for s, b, e in segments]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        now = None if self.event_clock else timerValues.getCurrentProcessingTimeInMs()
        at = pdf["at_ms"].to_numpy().astype(np.int64) if self.event_clock else np.full(len(pdf), now)
        speech = pdf["speech"].to_numpy()
        held = self.state.get() if self.state.exists() else None
        fold = VadFold(self.cfg, tuple(held[:7]) if held else None)
        began, last = (held[7], held[8]) if held else (int(at[0]), None)
        opened, out = fold.open_segment(), []
        late = np.diff(np.concatenate(([at[0] if last is None else last], at))) > self.timeout_ms
        cuts = np.flatnonzero(late).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(at)], strict=True):
            if a in cuts:
                out += self.closed(key[0], began, fold.finish())
                fold, began = VadFold(self.cfg), int(at[a])
            out += self.closed(key[0], began, fold.push(speech[a:b]))
        last = int(at[-1])
        now_open = fold.open_segment()
        if now_open and (now_open != opened or cuts):
            out.append((key[0], began, int(now_open[0]), int(now_open[1]) * self.cfg.frame_ms, None))
        frame, in_speech, window, beg, low, floor, seg = fold.state()
        self.state.update((int(frame), bool(in_speech), [int(x) for x in window], int(beg), int(low), int(floor), int(seg),
                           int(began), last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(last + self.timeout_ms)
        yield pd.DataFrame(out, columns=COLUMNS).astype({"end_ms": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            held = self.state.get()
            out = self.closed(key[0], held[7], VadFold(self.cfg, tuple(held[:7])).finish())
            self.state.clear()
        yield pd.DataFrame(out, columns=COLUMNS).astype({"end_ms": "Int64"})

    def close(self) -> None:
        pass


COLUMNS = [f.split()[0] for f in OUT.split(", ")]


def sessions_stream(frames: DataFrame, session: str, order: list[str], speech: str, time: str, timeout_ms: int,
                    cfg: VadConfig = VadConfig(), delay: str = "0 seconds", event_clock: bool = True) -> DataFrame:
    """(session, began_ms, seg, beg_ms, end_ms) of a stream of scored frames; ``time`` is a timestamp."""
    rows = frames.withWatermark(time, delay) if event_clock else frames
    rows = rows.select(F.col(session).cast("long").alias("session"), *[c for c in order if c != time], F.col(time),
                       F.unix_millis(time).alias("at_ms"), F.col(speech).cast("int").alias("speech"))
    return rows.groupBy("session").transformWithStateInPandas(
        Sessions(cfg, timeout_ms, order, event_clock), outputStructType=OUT, outputMode="append",
        timeMode="eventTime" if event_clock else "processingTime")


def final_segments(emitted: DataFrame) -> DataFrame:
    """One row a segment: the closed form of those that were open first, and those that stayed open."""
    return emitted.groupBy("session", "began_ms", "seg", "beg_ms").agg(F.max("end_ms").alias("end_ms"))
