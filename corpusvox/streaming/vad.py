"""Speech segmentation over scored frames, as a per-session fold (ST1, ST2, ST8, W9).

Each frame arrives with a speech decision (``p_speech >= p_noise + thres``,
computed as a column before the fold).  The fold keeps:

* a window of the last ``win`` decisions (W9 hysteresis): silence -> speech
  when at least ``sil_to_speech`` of them are speech;
* while in speech, a run of frames whose window holds at most
  ``speech_to_sil`` speech frames; when that run reaches ``max_end_sil``
  frames the segment ends ``lookahead`` frames after the run began;
* a forced end when a segment reaches ``max_segment`` frames;
* a final flag that closes an open segment and drops the session state.

Segment starts look back ``win + lookback`` frames (not before the previous
end).  Times are frame index x ``frame_ms``.  The same ``VadFold`` object runs
in the batch twin (buckets of a session's frames, chained by their states) and in
Structured Streaming (``applyInPandasWithState``,
state carried between micro-batches), so both give identical segments.

This is a re-aimed, documented simplification of the reference's detector:
frame scores come in as columns (no neural scoring, no energy/SNR gate).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class VadConfig:
    frame_ms: int = 10
    win: int = 20               # 200 ms window
    sil_to_speech: int = 15     # 150 ms of speech in the window
    speech_to_sil: int = 15
    lookback: int = 20          # 200 ms look-back at the start
    max_end_sil: int = 65       # 800 ms - 150 ms
    lookahead: int = 10         # 100 ms look-ahead at the end
    max_segment: int = 6000     # 60 s
    speech_noise_thres: float = 0.6


SEGMENT_SCHEMA = T.StructType([
    T.StructField("session", T.LongType()), T.StructField("seg", T.LongType()),
    T.StructField("beg_ms", T.LongType()), T.StructField("end_ms", T.LongType()),
])

STATE_SCHEMA = T.StructType([
    T.StructField("frame", T.LongType()), T.StructField("in_speech", T.BooleanType()),
    T.StructField("window", T.ArrayType(T.IntegerType())), T.StructField("beg", T.LongType()),
    T.StructField("low_run", T.LongType()), T.StructField("floor", T.LongType()), T.StructField("seg", T.LongType()),
])


class NoiseFloor:
    """Running noise level in dB over frames judged non-speech: the first
    such frame sets it, later ones update avg = (db + avg*(N-1)) / N.  A frame that
    passes the score test stays speech only when its SNR (db - noise) and its dB
    reach the thresholds (defaults -100 -- effectively open)."""

    def __init__(self, n: int = 100, snr_thres: float = -100.0, decibel_thres: float = -100.0,
                 avg: float | None = None):
        self.n, self.snr_thres, self.decibel_thres, self.avg = n, snr_thres, decibel_thres, avg

    def gate(self, speech: np.ndarray, db: np.ndarray) -> np.ndarray:
        out = np.zeros(len(speech), dtype=int)
        for k, (s, d) in enumerate(zip(speech, db)):
            if s:
                noise = self.avg if self.avg is not None else -100.0
                out[k] = int((d - noise) >= self.snr_thres and d >= self.decibel_thres)
            else:
                self.avg = float(d) if self.avg is None else (float(d) + self.avg * (self.n - 1)) / self.n
        return out


class VadFold:
    def __init__(self, cfg: VadConfig, state: tuple | None = None):
        self.cfg = cfg
        if state is None:
            self.frame, self.in_speech, self.window = 0, False, [0] * cfg.win
            self.beg, self.low_run, self.floor, self.seg = 0, 0, 0, 0
        else:
            self.frame, self.in_speech, window, self.beg, self.low_run, self.floor, self.seg = state
            self.window = list(window)

    def state(self) -> tuple:
        return (self.frame, self.in_speech, list(self.window), self.beg, self.low_run, self.floor, self.seg)

    def _close(self, end: int, out: list):
        out.append((self.seg, self.beg, end))
        self.seg += 1
        self.in_speech, self.low_run, self.floor = False, 0, end
        self.window = [0] * self.cfg.win

    def push(self, speech: np.ndarray) -> list[tuple[int, int, int]]:
        """Feed frame decisions in time order; returns closed (seg, beg, end) frames."""
        c, out = self.cfg, []
        win = self.window
        wsum = sum(win)
        for s in speech:
            f = self.frame
            pos = f % c.win
            wsum += int(s) - win[pos]
            win[pos] = int(s)
            if not self.in_speech:
                if wsum >= c.sil_to_speech:
                    self.in_speech, self.low_run = True, 0
                    self.beg = max(self.floor, f - c.win - c.lookback + 1)
            else:
                self.low_run = self.low_run + 1 if wsum <= c.speech_to_sil else 0
                if self.low_run >= c.max_end_sil:
                    self._close(min(f + 1, f - self.low_run + 1 + c.lookahead), out)
                    win, wsum = self.window, 0
                elif f + 1 - self.beg >= c.max_segment:
                    self._close(f + 1, out)
                    win, wsum = self.window, 0
            self.frame += 1
        self.window = win
        return out

    def finish(self) -> list[tuple[int, int, int]]:
        out: list = []
        if self.in_speech:
            self._close(self.frame, out)
        return out

    def open_segment(self) -> tuple[int, int] | None:
        return (self.seg, self.beg) if self.in_speech else None


def speech_flag(p_speech, p_noise, thres: float = 0.6):
    """Frame decision column: p_speech >= p_noise + thres."""
    return (F.col(p_speech) >= F.col(p_noise) + thres) if isinstance(p_speech, str) else (p_speech >= p_noise + thres)


def _rows(session, segs, cfg):
    return [(int(session), int(s), int(b) * cfg.frame_ms, int(e) * cfg.frame_ms) for s, b, e in segs]


class VadChain:
    """The fold as a map from entry to exit state, for ``chained_fold``; segments are numbered outside."""

    fields = "pos long, beg long, end long"

    def __init__(self, cfg: VadConfig) -> None:
        self.cfg = cfg

    def guess(self, offset: int) -> tuple:
        return self.normal((offset, False, [0] * self.cfg.win, 0, 0, 0, 0))

    def normal(self, state: tuple) -> tuple:
        """A floor that no later segment can reach, and what only matters in speech, become 0."""
        frame, in_speech, window, beg, low, floor, _ = state
        floor = floor if floor > frame - self.cfg.win - self.cfg.lookback else 0
        return (frame, in_speech, window, beg, low, floor, 0) if in_speech else (frame, False, window, 0, 0, floor, 0)

    def run(self, state: tuple, batches: Iterator[pd.DataFrame], last: bool) -> tuple[tuple, list, int]:
        fold, out = VadFold(self.cfg, tuple(state)), []
        for b in batches:
            out += fold.push(b["speech"].to_numpy())
        if last:
            out += fold.finish()
        return self.normal(fold.state()), out, len(out)


def segments_batch(frames: DataFrame, session: str, order: list[str], speech: str,
                   cfg: VadConfig = VadConfig(), rows_per_bucket: int | None = None) -> DataFrame:
    """Batch twin: offline mode, closed segments only.  A long session is cut into buckets that
    run in many tasks at once (see ``chained_fold``)."""
    from corpusvox.plans.chained import chained_fold

    rows = frames.select(F.col(session).cast("long").alias("session"), *order, F.col(speech).cast("int").alias("speech"))
    out = chained_fold(rows, "session", order, ["speech"], VadChain(cfg), rows_per_bucket)
    return out.select("session", (F.col("_before") + F.col("pos")).alias("seg"), (F.col("beg") * cfg.frame_ms).alias("beg_ms"),
                      (F.col("end") * cfg.frame_ms).alias("end_ms"))


STREAM_OUT = T.StructType([
    T.StructField("session", T.LongType()), T.StructField("seg", T.LongType()),
    T.StructField("beg_ms", T.LongType()), T.StructField("end_ms", T.LongType()),
])


def segments_stream(frames: DataFrame, session: str, order: list[str], speech: str, final: str,
                    cfg: VadConfig = VadConfig(), emit_open: bool = False,
                    timeout: str | None = None) -> DataFrame:
    """ST1/ST2/ST8 on a streaming DataFrame.  State per session = the fold state;
    a row with ``final`` true closes the open segment and removes the state.
    ``emit_open`` adds streaming-mode rows [beg, NULL] when a segment opens
    (closed segments are always [beg, end]).  ``timeout`` (e.g. '1 hour') drops
    sessions that never send a final chunk."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    prepared = frames.select(F.col(session).cast("long").alias("session"), *order,
                             F.col(speech).cast("int").alias("speech"), F.col(final).cast("boolean").alias("final"))

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        v = VadFold(cfg, tuple(state.get) if state.exists else None)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        rows = []
        before = v.open_segment()
        finals = pdf["final"].to_numpy()
        speech = pdf["speech"].to_numpy()
        cut = np.flatnonzero(finals)
        end = int(cut[0]) + 1 if len(cut) else len(pdf)
        segs = v.push(speech[:end])
        rows += _rows(key[0], segs, cfg)
        if len(cut):
            rows += _rows(key[0], v.finish(), cfg)
            state.remove()
        else:
            opened = v.open_segment()
            if emit_open and opened is not None and opened != before:
                rows.append((int(key[0]), int(opened[0]), int(opened[1]) * cfg.frame_ms, None))
            state.update(v.state())
            if timeout:
                state.setTimeoutDuration(timeout)
        if rows:
            yield pd.DataFrame(rows, columns=STREAM_OUT.fieldNames())

    tmo = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return prepared.groupBy("session").applyInPandasWithState(step, STREAM_OUT, STATE_SCHEMA, "append", tmo)
