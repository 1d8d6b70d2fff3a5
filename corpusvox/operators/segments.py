"""Segment, turn, sentence and frame operators.

A segment table has a recording key, a total order inside the recording,
``start``/``end`` bounds and usually a ``label``.  Neighbour access goes
through ``plans.sequence`` (``seq_lag``/``seq_lead``/``seq_cumsum``/
``seq_ffill``) so a recording that holds a third of all rows is still cut
into many tasks.  Sequential rules from the reference are rewritten as
exact window expressions where the dependency allows it:

* W2 merge: the running merged end is always the previous row's end (the
  end is overwritten, not maxed), so "new island" is a lag comparison.
* W3 overlap split: a pair only moves prev.end and cur.start, which no other
  pair reads, so one lag/lead pass is exact.
* W4 smoothing: a short turn copies the *already smoothed* previous label or
  the *original* next label; the result is a forward fill of per-row values.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvox.plans.sequence import (B, is_whole, one_bucket, range_buckets, seq_cummin, seq_cumsum, seq_ffill, seq_lag, seq_lead,
                                      seq_neighbors)
from corpusvox.session import cut_lineage


def _l(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


# ------------------------------------------------------------ turns

def merge_turns(seg: DataFrame, rec: str, order: Sequence[str], start="start", end="end",
                label="label", mark_whole: bool = False) -> DataFrame:
    """Merge consecutive rows of one label when the next starts at or before
    the current (merged) end; the merged end is the last row's end.

    Output: rec, island (0-based), label, start, end, n (rows merged); with ``mark_whole`` also
    ``_seq_b`` if no recording needed cutting, so that a later step by island need not ask again."""
    order = _l(order)
    x = range_buckets(seg.select(rec, *order, start, end, label).withColumn("_in", F.lit(True)), [rec], order)
    x = seq_neighbors(x, [rec], order, prev=["_in", label, end], next=["_in", label, start], prev_suffix="_prev",
                      next_suffix="_next")
    # a missing label is a label of its own; the ends of a recording are told by _in, not by NULL values
    new = F.col("_in_prev").isNull() | ~F.col(label).eqNullSafe(F.col(label + "_prev")) | \
        F.coalesce(F.col(start) > F.col(end + "_prev"), F.lit(False))
    # the row closes its island when the next row would open a new one
    closes = F.col("_in_next").isNull() | ~F.col(label + "_next").eqNullSafe(F.col(label)) | \
        F.coalesce(F.col(start + "_next") > F.col(end), F.lit(False))
    x = seq_cumsum(x.withColumn("_new", new.cast("long")).withColumn("_closes", closes),
                   [rec], order, {"island": F.col("_new")})
    # one row per island opens it and one closes it: primitive aggregates, hash path
    # the label is constant inside an island, so it rides in the grouping key
    out = x.groupBy(rec, "island", label).agg(
        F.max(F.when(F.col("_new") == 1, F.col(start))).alias(start),
        F.max(F.when(F.col("_closes"), F.col(end))).alias(end),
        F.count(F.lit(1)).alias("n")).withColumn("island", F.col("island") - 1)
    return one_bucket(out) if mark_whole and is_whole(x) else out


def split_overlaps(seg: DataFrame, rec: str, order: Sequence[str], start="start", end="end",
                   tol: float = 1e-4) -> DataFrame:
    """Where prev.end > cur.start + tol both move to the midpoint."""
    order = _l(order)
    x = seq_neighbors(seg, [rec], order, prev=[end], next=[start])
    new_start = F.when(F.col(end + "_prev") > F.col(start) + tol,
                       (F.col(start) + F.col(end + "_prev")) / 2).otherwise(F.col(start))
    new_end = F.when(F.col(end) > F.col(start + "_next") + tol,
                     (F.col(start + "_next") + F.col(end)) / 2).otherwise(F.col(end))
    return x.withColumn("_ns", new_start).withColumn("_ne", new_end) \
        .drop(start, end, end + "_prev", start + "_next", B) \
        .withColumnRenamed("_ns", start).withColumnRenamed("_ne", end)


def relabel_first_appearance(seg: DataFrame, rec: str, order: Sequence[str], label="label",
                             out: str = "label") -> DataFrame:
    """Labels renumbered 0, 1, ... by first appearance inside each recording.

    The window runs over (recording, label) pairs -- one row per distinct label."""
    order = _l(order)
    first = seg.groupBy(rec, label).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
    ids = first.withColumn("_new", (F.dense_rank().over(Window.partitionBy(rec).orderBy("_first")) - 1).cast("int"))
    return seg.join(ids.select(rec, label, "_new"), [rec, label]).drop(label).withColumnRenamed("_new", out)


def smooth_turns(seg: DataFrame, rec: str, order: Sequence[str], start="start", end="end", label="label",
                 min_dur: float = 1.0, materialize: bool = False) -> DataFrame:
    """Round bounds to 2 decimals; a turn shorter than ``min_dur`` takes the
    label of the nearer neighbour (gap to the previous rounded end vs. gap to the
    next *unrounded* start, ties -> previous; first -> next, last -> previous),
    reading the previous label after its own smoothing; then W2 merge.

    Rounding is half-even on the binary value, like Python's ``round``
    (Spark's ``round`` goes through the decimal text, half-up)."""
    order = _l(order)
    x = seg.withColumn("_rs", round_half_even(F.col(start), 2)).withColumn("_re", round_half_even(F.col(end), 2)) \
        .withColumn("_in", F.lit(True))
    x = seq_neighbors(x, [rec], order, prev=["_in", "_re", label], next=["_in", start, label], prev_suffix="_p",
                      next_suffix="_n")
    first, last = F.col("_in_p").isNull(), F.col("_in_n").isNull()
    short = (F.col("_re") - F.col("_rs")) < min_dur
    take_prev = short & ~(first & last) & (last | (~first & (
        (F.col("_rs") - F.col("_re_p")) <= (F.col(start + "_n") - F.col("_re")))))
    take_next = short & ~(first & last) & ~take_prev
    # wrapped, so that a missing label is carried forward like any other
    own = F.when(take_next, F.col(label + "_n")).otherwise(F.col(label)).alias("v")
    val = F.when(~F.coalesce(take_prev, F.lit(False)), F.struct(own))
    x = seq_ffill(x.withColumn("_val", val), [rec], order, "_val", "_smoothed")
    x = x.select(rec, *order, F.col("_rs").alias(start), F.col("_re").alias(end), F.col("_smoothed")["v"].alias(label))
    if materialize:
        x = cut_lineage(x)
    return merge_turns(x, rec, order, start, end, label)


def round_half_even(x: Column, digits: int) -> Column:
    """Round a DOUBLE to ``digits`` decimals, half to even, in binary arithmetic."""
    k = 10.0 ** digits
    r = x * k
    f = F.floor(r)
    d = r - f
    return F.when(d > 0.5, f + 1).when(d < 0.5, f).otherwise(f + F.pmod(f, F.lit(2))) / k


def diarization_postprocess(seg: DataFrame, rec: str, order: Sequence[str], min_dur: float = 1.0) -> DataFrame:
    """W5 relabel -> W2 merge -> W3 overlap split -> W4 smooth.

    Each stage is a handful of shuffles; the stage outputs are checkpointed to
    the shared checkpoint folder so the chain's lineage (and plan) stays short."""
    order = _l(order)
    r = relabel_first_appearance(seg.select(rec, *order, "start", "end", "label"), rec, order)
    m = cut_lineage(merge_turns(r, rec, order))
    s = cut_lineage(split_overlaps(m, rec, ["island"]))
    s = s.select(rec, F.col("island").alias("seg"), "start", "end", "label")
    return smooth_turns(s, rec, ["seg"], min_dur=min_dur, materialize=True)


# ------------------------------------------------------------ checks

def recording_check(seg: DataFrame, rec: str, order: Sequence[str], start="start", end="end",
                    n_samples: str | None = None, sr: int = 16000) -> DataFrame:
    """Per recording: reversed bounds, overlaps with the previous segment,
    sample-count mismatches (when samples are given) and total duration."""
    order = _l(order)
    x = seq_lag(seg, [rec], order, [end], suffix="_prev")
    bad_len = (F.col(n_samples) != (F.floor(F.col(end) * sr) - F.floor(F.col(start) * sr))) \
        if n_samples else F.lit(False)
    return x.groupBy(rec).agg(
        F.count(F.lit(1)).alias("n_segments"),
        F.sum((F.col(end) < F.col(start)).cast("int")).cast("long").alias("n_reversed"),
        F.sum(F.coalesce((F.col(start) < F.col(end + "_prev")).cast("int"), F.lit(0))).cast("long").alias("n_overlap"),
        F.sum(bad_len.cast("int")).cast("long").alias("n_bad_length"),
        F.sum(F.col(end) - F.col(start)).alias("duration"))


# ------------------------------------------------------------ runs

def forward_fill_class(df: DataFrame, rec: str, order: Sequence[str], cls: str, oov, out: str = "cls_filled",
                       default=0) -> DataFrame:
    """The out-of-vocabulary class takes the previous frame's (filled) class, else ``default``."""
    x = df.withColumn("_c", F.when(F.col(cls) != F.lit(oov), F.col(cls)))
    x = seq_ffill(x, [rec], _l(order), "_c", out)
    return x.withColumn(out, F.coalesce(F.col(out), F.lit(default))).drop("_c", B)


def run_starts(df: DataFrame, rec: str, order: Sequence[str], value: str) -> DataFrame:
    """Flag rows that start a run of equal values (collapsing runs = keeping these)."""
    x = seq_lag(df.withColumn("_in", F.lit(True)), [rec], _l(order), [value, "_in"], suffix="_prev")
    changed = F.col("_in_prev").isNull() | ~F.col(value).eqNullSafe(F.col(value + "_prev"))
    return x.withColumn("run_start", changed).drop(value + "_prev", "_in", "_in_prev", B)


# ------------------------------------------------------------ chunks

def sv_chunks(seg: DataFrame, n_samples: str, seg_start: str, fs: int = 16000, seg_dur: float = 1.5,
              seg_shift: float = 0.75) -> DataFrame:
    """Overlapping chunks inside a speech segment.  Starts every shift; the
    end is clipped to the segment; the first chunk whose end reaches the
    segment end is the last; its start moves back to end - length (floor 0).

    Adds chunk (0-based), chunk_start, chunk_end (seconds, absolute) and
    pad (samples of zero padding when the segment is shorter than a chunk)."""
    ln, sh = int(seg_dur * fs), int(seg_shift * fs)
    n = F.col(n_samples)
    x = seg.withColumn("_st", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(sh)))
                                        .otherwise(F.array().cast("array<bigint>"))))
    x = x.where((F.col("_st") == 0) | (F.col("_st") - sh + ln < n))
    ed = F.least(F.col("_st") + ln, n)
    st = F.greatest(F.lit(0), ed - ln)
    return x.select("*", (F.col("_st") / sh).cast("long").alias("chunk"),
                    (st / fs + F.col(seg_start)).alias("chunk_start"), (ed / fs + F.col(seg_start)).alias("chunk_end"),
                    F.greatest(F.lit(0), F.lit(ln) - (ed - st)).alias("pad")).drop("_st")


def fixed_chunks(seg: DataFrame, n_samples: str, chunk: int = 480000, min_tail: int = 480) -> DataFrame:
    """W1b + P12: non-overlapping chunks; a chunk shorter than ``min_tail`` samples is dropped."""
    n = F.col(n_samples)
    x = seg.withColumn("_st", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(chunk)))
                                        .otherwise(F.array().cast("array<bigint>"))))
    x = x.withColumn("chunk_len", F.least(F.lit(chunk), n - F.col("_st")))
    return x.where(F.col("chunk_len") >= min_tail) \
        .select("*", (F.col("_st") / chunk).cast("long").alias("chunk"), F.col("_st").alias("chunk_offset")).drop("_st")


# ------------------------------------------------------------ range join

def assign_speakers(sent: DataFrame, turns: DataFrame, rec: str, sent_key: str, turn_order: str,
                    bin_width: float, start="start", end="end", spk="spk") -> DataFrame:
    """Each sentence takes the speaker of the turn with the largest positive
    overlap; equal overlaps -> earliest turn; no overlap -> speaker 0.

    The range join is an equi-join on (recording, time bin): both sides are
    exploded into the bins they touch and a pair is kept only in the bin that
    holds the later of the two starts, so each overlapping pair is seen once
    and a long recording spreads over many join keys."""
    def binned(df, cols):
        return df.select(*cols, F.explode(F.sequence(F.floor(F.col(start) / bin_width).cast("long"),
                                                     F.floor(F.col(end) / bin_width).cast("long"))).alias("_bin"))
    s = binned(sent.select(rec, sent_key, start, end), [rec, sent_key, start, end])
    t = binned(turns.select(rec, turn_order, F.col(start).alias("t_start"), F.col(end).alias("t_end"), spk)
               .withColumnRenamed("t_start", start).withColumnRenamed("t_end", end), [rec, turn_order, start, end, spk]) \
        .withColumnRenamed(start, "_ts").withColumnRenamed(end, "_te")
    j = s.join(t, [rec, "_bin"])
    ov = F.least(F.col(end), F.col("_te")) - F.greatest(F.col(start), F.col("_ts"))
    j = j.where((ov > 0) & (F.col("_bin") == F.floor(F.greatest(F.col(start), F.col("_ts")) / bin_width)))
    best = j.groupBy(rec, sent_key).agg(F.max_by(F.col(spk), F.struct(ov, -F.col(turn_order))).alias("_spk"))
    return sent.join(best, [rec, sent_key], "left").withColumn(spk, F.coalesce(F.col("_spk"), F.lit(0))).drop("_spk")


# ------------------------------------------------------------ frames

def frame_labels(seg: DataFrame, rec: str, spk: str, shift: float, start="start", end="end",
                 window: tuple[float, float] | None = None) -> DataFrame:
    """Rasterise segments to frames rint(start/shift) .. rint(end/shift)-1,
    clipped to an optional [from, to) window; (rec, frame, spk) distinct."""
    f0 = F.rint(F.col(start) / shift).cast("long")
    f1 = F.rint(F.col(end) / shift).cast("long")
    if window:
        f0 = F.greatest(f0, F.lit(int(round(window[0] / shift))))
        f1 = F.least(f1, F.lit(int(round(window[1] / shift))))
    x = seg.select(rec, spk, f0.alias("_f0"), f1.alias("_f1")).where(F.col("_f1") > F.col("_f0"))
    return x.select(rec, spk, F.explode(F.sequence("_f0", F.col("_f1") - 1)).alias("frame")).distinct()


def powerset_table(max_speakers: int = 6, max_overlap: int = 3) -> list[int]:
    """bitmaps of all speaker sets of size <= max_overlap (with the empty set), ascending."""
    kinds = {0}
    for k in range(1, max_overlap + 1):
        for combo in combinations(range(max_speakers), k):
            kinds.add(sum(1 << i for i in combo))
    return sorted(kinds)


def powerset_encode(frames: DataFrame, rec: str, spk_idx: str, max_speakers: int = 6,
                    max_overlap: int = 3) -> DataFrame:
    """per (rec, frame): bitmap = sum(1 << spk) -> class id (index in the
    power-set table), or oov = table size for unknown combinations."""
    table = powerset_table(max_speakers, max_overlap)
    arr = F.array(*[F.lit(v).cast("long") for v in table])
    bit = F.pow(F.lit(2.0), F.col(spk_idx)).cast("long")
    bm = frames.groupBy(rec, "frame").agg(F.sum(bit).alias("bitmap"))
    pos = F.array_position(arr, F.col("bitmap"))
    return bm.withColumn("cls", F.when(pos > 0, pos - 1).otherwise(F.lit(len(table))).cast("int"))


def powerset_decode(cls: Column, max_speakers: int = 6, max_overlap: int = 3) -> Column:
    """F13 inverse: class id -> array of speaker bits (oov -> NULL)."""
    table = powerset_table(max_speakers, max_overlap)
    arr = F.array(*[F.lit(v).cast("long") for v in table])
    bitmap = F.element_at(arr, cls + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(max_speakers - 1)),
                       lambda i: F.pmod(F.floor(bitmap / F.pow(F.lit(2.0), i)), F.lit(2)).cast("int"))


def diarization_error(ref: DataFrame, sys: DataFrame, rec: str, spk: str, n_frames: DataFrame,
                      n_speakers: int) -> DataFrame:
    """A13 from long-form frame tables (rec, frame, spk) for reference and system
    (speaker labels already mapped).  Silent frames are not materialised:
    ``n_frames`` gives (rec, frames) and ``correct`` is derived from mismatches."""
    r = ref.select(rec, "frame", spk).withColumn("r", F.lit(1))
    s = sys.select(rec, "frame", spk).withColumn("s", F.lit(1))
    both = r.join(s, [rec, "frame", spk], "full")
    per = both.groupBy(rec, "frame").agg(F.sum(F.coalesce("r", F.lit(0))).alias("n_ref"),
                                         F.sum(F.coalesce("s", F.lit(0))).alias("n_sys"),
                                         F.sum((F.coalesce("r", F.lit(0)) * F.coalesce("s", F.lit(0)))).alias("n_map"))
    tot = per.agg(
        F.sum((F.col("n_ref") > 0).cast("long")).alias("speech_scored"),
        F.sum(((F.col("n_ref") > 0) & (F.col("n_sys") == 0)).cast("long")).alias("speech_miss"),
        F.sum(((F.col("n_ref") == 0) & (F.col("n_sys") > 0)).cast("long")).alias("speech_falarm"),
        F.sum("n_ref").cast("long").alias("speaker_scored"),
        F.sum(F.greatest(F.col("n_ref") - F.col("n_sys"), F.lit(0))).cast("long").alias("speaker_miss"),
        F.sum(F.greatest(F.col("n_sys") - F.col("n_ref"), F.lit(0))).cast("long").alias("speaker_falarm"),
        F.sum(F.least("n_ref", "n_sys") - F.col("n_map")).cast("long").alias("speaker_error"),
        F.sum(F.col("n_ref") + F.col("n_sys") - 2 * F.col("n_map")).cast("long").alias("_mismatch"))
    tot_frames = n_frames.agg(F.sum("frames").cast("long").alias("frames")).first()["frames"] or 0
    return tot.select(
        "speech_scored", "speech_miss", "speech_falarm", "speaker_scored", "speaker_miss", "speaker_falarm",
        "speaker_error",
        (F.col("speaker_miss") + F.col("speaker_falarm") + F.col("speaker_error")).alias("diarization_error"),
        F.lit(tot_frames).cast("long").alias("frames"),
        (F.lit(float(tot_frames)) - F.col("_mismatch") / float(n_speakers)).alias("correct"),
        F.try_divide((F.col("speaker_miss") + F.col("speaker_falarm") + F.col("speaker_error")).cast("double"),
                     F.col("speaker_scored")).alias("der"))


def label_max_pool(frames: DataFrame, rec: str, hop: int = 8, n_frames: DataFrame | None = None) -> DataFrame:
    """Non-overlapping max pooling of active (rec, frame, spk) rows by hop;
    with ``n_frames`` the incomplete tail window is dropped."""
    x = frames.withColumn("pooled", F.floor(F.col("frame") / hop).cast("long"))
    if n_frames is not None:
        x = x.join(n_frames.select(rec, "frames"), rec).where(F.col("pooled") < F.floor(F.col("frames") / hop)) \
            .drop("frames")
    return x.select(*[c for c in x.columns if c != "frame"]).distinct()


def label_majority(frames: DataFrame, rec: str, spk: str, n_frames: DataFrame, win: int = 512,
                   hop: int = 128) -> DataFrame:
    """Centre-padded (first/last half window copied) sliding windows; a
    speaker is on in window k when its active frames inside exceed win/2.

    Each active frame is exploded into the windows that contain it (win/hop of
    them) -- work grows with active frames, not with window count x speakers."""
    pad = win // 2
    x = frames.join(n_frames.select(rec, "frames"), rec)
    # padded index p = frame + pad; the pad copies frames [0, pad) and [T-pad, T) once more
    copies = F.array(F.col("frame") + pad)
    copies = F.when(F.col("frame") < pad, F.concat(copies, F.array(F.col("frame")))).otherwise(copies)
    copies = F.when(F.col("frame") >= F.col("frames") - pad,
                    F.concat(copies, F.array(F.col("frame") + 2 * pad))).otherwise(copies)
    x = x.select(rec, spk, "frames", F.explode(copies).alias("p"))
    n_win = F.floor((F.col("frames") + 2 * pad - win) / hop) + 1
    k_lo = F.greatest(F.lit(0), F.ceil((F.col("p") - win + 1) / hop)).cast("long")
    k_hi = F.least(n_win - 1, F.floor(F.col("p") / hop)).cast("long")
    x = x.where(k_hi >= k_lo).select(rec, spk, F.explode(F.sequence(k_lo, k_hi)).alias("window"))
    return x.groupBy(rec, spk, "window").agg(F.count(F.lit(1)).alias("active")) \
        .where(F.col("active") > win // 2)


# ------------------------------------------------------------ sentences

# Punctuation marks by punctuation id (2, 3, 4, 5).
PUNC_MARKS = ("，", "。", "？", "、")


def sentences(tokens: DataFrame, rec: str, order: Sequence[str], text: str = "token", punc: str = "punc",
              t_start: str = "t_start", t_end: str = "t_end", keep_tail: bool = False) -> DataFrame:
    """Cut after every token whose punctuation id > 1.  Words join with a
    space when the word starts with an ASCII letter or the text so far ends
    with one; the mark is appended.  A sentence starts where the previous one
    ended (the first at its first token's start).  Without a closing mark the
    tail is dropped unless ``keep_tail`` (its end is then its largest token end).

    One pass of neighbour values over the tokens gives everything: the
    previous token's end is the previous sentence's end at a sentence's first
    token.  Output: rec, sid, text, start, end, n_tokens."""
    order = _l(order)
    closes = (F.col(punc) > 1).cast("long")
    x = range_buckets(tokens, [rec], order)
    x = seq_cumsum(x.withColumn("_close", closes), [rec], order, {"_closes": F.col("_close")})
    x = x.withColumn("sid", F.col("_closes") - F.col("_close"))
    x = seq_neighbors(x, [rec], order, prev=["sid", text, t_end], prev_suffix="_p")
    first_in_sentence = F.col("sid_p").isNull() | (F.col("sid_p") != F.col("sid"))
    letter = "^[A-Za-z]"
    sep = F.when(F.col(text).rlike(letter), F.lit(" ")) \
        .when(~first_in_sentence & F.col(text + "_p").rlike("[A-Za-z]$"), F.lit(" ")).otherwise(F.lit(""))
    marks = F.array(*[F.lit(m) for m in PUNC_MARKS])
    mark = F.when(F.col(punc) > 1, F.element_at(marks, (F.col(punc) - 1).cast("int"))).otherwise(F.lit(""))
    x = x.withColumn("_piece", F.concat(sep, F.col(text), mark)) \
        .withColumn("_start", F.when(first_in_sentence, F.coalesce(F.col(t_end + "_p"), F.col(t_start))))
    key = F.struct(*[F.col(c) for c in order])
    per = x.groupBy(rec, "sid").agg(
        F.array_sort(F.collect_list(F.struct(key.alias("k"), F.col("_piece").alias("p")))).alias("_ps"),
        F.max("_start").alias("start"),
        F.coalesce(F.max(F.when(F.col("_close") == 1, F.col(t_end))), F.max(t_end)).alias("end"),
        F.max("_close").alias("_closed"), F.count(F.lit(1)).alias("n_tokens"))
    if not keep_tail:
        per = per.where(F.col("_closed") == 1)
    return per.select(rec, "sid", F.array_join(F.transform("_ps", lambda s: s["p"]), "").alias("text"),
                      "start", "end", "n_tokens")


# ------------------------------------------------------------ transcripts

def combine_segments(seg: DataFrame, rec: str, order: str, text: str = "text") -> DataFrame:
    """One row per recording: segment texts joined by a space in segment
    order.  The output row is the recording's transcript, so its size is the
    recording's text; segments are collected with their order and sorted."""
    return seg.groupBy(rec).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("_s"),
        F.count(F.lit(1)).alias("n_segments")) \
        .select(rec, "n_segments", F.array_join(F.transform("_s", lambda x: x["t"]), " ").alias(text))


def combine_results(seg: DataFrame, rec: str, order: str, text: str = "text", start_ms: str = "start",
                    stamps: str = "stamps", lists: Sequence[str] = ()) -> DataFrame:
    """A16 in full: one row per recording with the texts joined by a space, the (begin, end) stamps
    shifted by their segment's start and put one after the other, and any other list fields likewise.

    The row is the recording's whole result, as the format has it; ``shifted_stamps`` is the long form."""
    own = F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(start_ms).alias("at"),
                   F.col(stamps).alias("s"), *[F.col(c) for c in lists])
    x = seg.groupBy(rec).agg(F.array_sort(F.collect_list(own)).alias("_s"))
    shifted = F.flatten(F.transform("_s", lambda p: F.transform(F.coalesce(p["s"], F.array()), lambda q: F.struct(
        (q["beg"] + p["at"]).alias("beg"), (q["end"] + p["at"]).alias("end")))))
    return x.select(rec, F.size("_s").alias("n_segments"), F.array_join(F.transform("_s", lambda p: p["t"]), " ").alias(text),
                    shifted.alias(stamps), *[_flat(c) for c in lists])


def _flat(name: str) -> Column:
    return F.flatten(F.transform("_s", lambda p: F.coalesce(p[name], F.array()))).alias(name)


def shifted_stamps(seg: DataFrame, rec: str, order: str, start_ms: str = "start", stamps: str = "stamps") -> DataFrame:
    """A16 long form: (rec, order, pos, beg, end) with each stamp shifted by its segment's start."""
    x = seg.select(rec, order, F.col(start_ms).alias("_at"), F.posexplode(stamps).alias("pos", "_p"))
    return x.select(rec, order, "pos", (F.col("_p.beg") + F.col("_at")).alias("beg"),
                    (F.col("_p.end") + F.col("_at")).alias("end"))


def number_segments(seg: DataFrame, rec: str, order: Sequence[str], name: str = "idx") -> DataFrame:
    """1-based segment number inside each recording."""
    from corpusvox.plans.sequence import seq_row_number
    return seq_row_number(seg, [rec], _l(order), name).drop(B)


def transcript_blocks(seg: DataFrame, fmt: str, start_ms: str = "start", end_ms: str = "end",
                      text: str = "text", idx: str = "idx") -> DataFrame:
    """K8: one rendered block per segment.  srt: index, always hours, ',' marker;
    vtt: hours only when > 0, '.'; '-->' inside text becomes '->'; tsv: integer
    ms and tabs replaced by spaces; txt: the stripped text; json: id, start, end and text."""
    from corpusvox.functions.text import py_strip
    from corpusvox.functions.timefmt import format_timestamp
    t = py_strip(F.col(text))
    safe = F.replace(t, F.lit("-->"), F.lit("->"))
    s, e = F.col(start_ms), F.col(end_ms)
    if fmt == "srt":
        block = F.concat_ws("\n", F.col(idx).cast("string"),
                            F.concat(format_timestamp(s, True, ","), F.lit(" --> "), format_timestamp(e, True, ",")),
                            safe, F.lit(""))
    elif fmt == "vtt":
        block = F.concat_ws("\n", F.concat(format_timestamp(s), F.lit(" --> "), format_timestamp(e)), safe, F.lit(""))
    elif fmt == "tsv":
        block = F.concat_ws("\t", s.cast("long").cast("string"), e.cast("long").cast("string"),
                            F.replace(t, F.lit("\t"), F.lit(" ")))
    elif fmt == "txt":
        block = t
    elif fmt == "json":
        block = F.to_json(F.struct(F.col(idx).alias("id"), s.alias("start"), e.alias("end"), t.alias("text")))
    else:
        raise ValueError(fmt)
    return seg.withColumn("block", block)


# ------------------------------------------------------------ integrate-and-fire

def cif_fire(df: DataFrame, rec: str, order: Sequence[str], weight: str, threshold) -> DataFrame:
    """Accumulate weights in order; a frame fires when the sum reaches the threshold, which is
    then subtracted once, so a frame fires at most once and a heavy weight fires on later frames too.

    Fires are served one a frame as they fall due, like a queue: with S the running sum and
    A = floor(S / threshold) due by frame j, the fires up to frame n are n plus the least of
    0 and A - j over the frames j up to n.  Both are scans, so weights of any size are exact.
    ``fires`` is 0 or 1, ``left`` the sum after the frame, ``n_tokens`` (W16b) what is due by the
    frame.  The running sums are written once, as the second scan reads them twice.  Weights are not
    negative; use whole weights to avoid float drift."""
    order = _l(order)
    x = cut_lineage(seq_cumsum(df, [rec], order, {"_cs": F.col(weight), "_n": F.lit(1).cast("long")}))
    due = F.floor(F.col("_cs") / threshold)
    x = seq_cummin(x, [rec], order, due - F.col("_n"), "_low", "_low_before").drop(B)
    low, before = F.least(F.col("_low"), F.lit(0)), F.least(F.coalesce("_low_before", F.lit(0)), F.lit(0))
    return (x.withColumn("fires", (1 + low - before).cast("long")).withColumn("n_tokens", due.cast("long"))
            .withColumn("left", F.col("_cs") - threshold * (F.col("_n") + low)).drop("_cs", "_n", "_low", "_low_before"))


# ------------------------------------------------------------ speaker permutation

def best_assignment(gain) -> list[int]:
    """For each row of a gain matrix the column it is paired with (-1: none), with the largest total.

    Shortest augmenting paths with row and column prices; cubic in the number of rows."""
    import numpy as np

    n, m = gain.shape
    if n > m:
        back = best_assignment(gain.T)
        out = [-1] * n
        for j, i in enumerate(back):
            if i >= 0:
                out[i] = j
        return out
    cost = -gain.astype(float)
    row_price, col_price = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for new in range(n):
        dist, via = np.full(m, np.inf), np.full(m, -1)
        done = np.zeros(m, bool)
        row, col, base = new, -1, 0.0
        while True:
            step = base + cost[row] - row_price[row] - col_price
            better = ~done & (step < dist)
            dist[better], via[better] = step[better], col
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[col]
            done[col] = True
            if owner[col] < 0:
                break
            row = owner[col]
        row_price[new] += base
        for j in np.flatnonzero(done):
            if j != col:
                row_price[owner[j]] += base - dist[j]
            col_price[j] -= base - dist[j]
        while col >= 0:
            before = via[col]
            owner[col] = new if before < 0 else owner[before]
            col = before
    out = [-1] * n
    for j, i in enumerate(owner):
        if i >= 0:
            out[i] = j
    return out


def best_speaker_mapping(ref: DataFrame, sys: DataFrame, rec: str, spk: str) -> DataFrame:
    """Per recording, the one-to-one map of system speakers to reference
    speakers with the largest total overlap (frames active in both).  The
    confusion table has one row per (ref, sys) speaker pair; each recording's
    table is solved exactly, whatever its number of speakers.  Unmatched system
    speakers keep a NULL target."""
    from typing import Any

    import numpy as np
    import pandas as pd

    conf = ref.select(rec, "frame", F.col(spk).alias("r")).join(
        sys.select(rec, "frame", F.col(spk).alias("s")), [rec, "frame"]) \
        .groupBy(rec, "r", "s").agg(F.count(F.lit(1)).alias("n"))
    sys_spk = sys.select(rec, F.col(spk).alias("s")).distinct().withColumn("r", F.lit(None).cast("string")) \
        .withColumn("n", F.lit(0).cast("long"))
    conf = conf.select(rec, F.col("r").cast("string"), F.col("s").cast("string"), "n").unionByName(
        sys_spk.select(rec, "r", F.col("s").cast("string"), "n"))

    def solve(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        s_ids = sorted(pdf["s"].unique())
        r_ids = sorted(pdf["r"].dropna().unique())
        m = np.zeros((len(s_ids), len(r_ids)))
        both = pdf.dropna(subset=["r"])
        np.add.at(m, (np.searchsorted(s_ids, both["s"]), np.searchsorted(r_ids, both["r"])), both["n"])
        pair = best_assignment(m) if r_ids else [-1] * len(s_ids)
        return pd.DataFrame({rec: key[0], "sys_spk": s_ids, "ref_spk": [
            r_ids[j] if j >= 0 and m[i, j] > 0 else None for i, j in enumerate(pair)]})

    return conf.groupBy(rec).applyInPandas(
        solve, T.StructType([T.StructField(rec, conf.schema[rec].dataType),
                             T.StructField("sys_spk", T.StringType()), T.StructField("ref_spk", T.StringType())]))


# ------------------------------------------------------------ token timestamps

# Frame rate of the upsampled peaks, thresholds (frames) and the default shift.
TIME_RATE = 10.0 * 6 / 1000 / 3
START_END_THRESHOLD = 5
MAX_TOKEN_DURATION = 12


def token_timestamps(fires: DataFrame, lengths: DataFrame, rec: str, idx: str = "k", frame: str = "frame",
                     token: str = "token", shift: float = -1.5) -> DataFrame:
    """Peaks (fire frames, one more than tokens) -> per-token [begin, end] ms.

    Token k spans fire k .. fire k+1; a span longer than 12 frames is cut at 12
    (the rest is silence); the last token ends halfway to the utterance end when
    more than 5 frames remain, else at the end.  ``lengths`` gives (rec,
    num_frames).  Output (rec, k, token, beg_ms, end_ms); leading/trailing
    silence rows are not part of the result, as in the reference's list."""
    f = fires.select(rec, idx, token, (F.col(frame) + shift).alias("_f"))
    f = seq_neighbors(f, [rec], [idx], next=["_f"]).drop(B)
    last_k = f.groupBy(rec).agg(F.max(idx).alias("_last_k"))
    f = f.join(last_k, rec).join(lengths.select(rec, F.col("num_frames").alias("_nf")), rec) \
        .where(F.col(idx) < F.col("_last_k"))
    span = F.col("_f_next") - F.col("_f")
    end_frames = F.when(span <= MAX_TOKEN_DURATION, F.col("_f_next")).otherwise(F.col("_f") + MAX_TOKEN_DURATION)
    # the last emitted interval is the final token's (or its trailing silence when it was cut)
    is_final = F.col(idx) == F.col("_last_k") - 1
    tail = F.when(F.col("_nf") - F.col("_f_next") > START_END_THRESHOLD, (F.col("_nf") + F.col("_f_next")) * 0.5) \
        .otherwise(F.col("_nf").cast("double"))
    end_frames = F.when(is_final & (span <= MAX_TOKEN_DURATION), tail).otherwise(end_frames)
    return f.select(rec, idx, token, (F.col("_f") * TIME_RATE * 1000).cast("long").alias("beg_ms"),
                    (end_frames * TIME_RATE * 1000).cast("long").alias("end_ms"))


# ------------------------------------------------------------ timestamp-token segments

def timestamp_segments(tokens: DataFrame, rec: str, pos: str, tok: str, ts_begin: int,
                       precision: float = 0.02) -> DataFrame:
    """A token >= ``ts_begin`` is a timestamp.  Two consecutive timestamps
    close a slice after the first of them; each slice becomes a segment from its
    first token's time to its last token's time with the tokens in between as
    text.  A stream without consecutive timestamps is one segment ending at its
    last timestamp (NULL end when there is none or it is the zero timestamp).

    Output (rec, seg, start, end, n_text)."""
    bucket = [B] if B in tokens.columns else []
    x = tokens.where(F.col(rec).isNotNull()).select(rec, pos, tok, *bucket, (F.col(tok) >= ts_begin).alias("_ts"))
    x = seq_neighbors(x, [rec], [pos], prev=["_ts"])
    boundary = F.coalesce(F.col("_ts") & F.col("_ts_prev"), F.lit(False))
    x = seq_cumsum(x.withColumn("_b", boundary.cast("long")), [rec], [pos], {"seg": F.col("_b")})
    key = F.col(pos)
    sl = x.groupBy(rec, "seg").agg(
        F.min_by(tok, key).alias("_first"), F.max_by(tok, key).alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.max_by(F.when(F.col("_ts"), F.col(tok)), F.when(F.col("_ts"), key)).alias("_lt"))
    # a recording has no more slices than tokens, so one that was whole stays whole
    sl = seq_neighbors(one_bucket(sl) if is_whole(x) else sl, [rec], ["seg"], next=["seg"]).drop(B)
    # a closing slice ends at the first timestamp of a pair (the row before each boundary); rows after
    # the last pair belong to no closed slice; slice 0 without a next one has no pair at all
    closed = F.col("seg_next").isNotNull()
    end = F.when(closed, F.col("_last")).otherwise(F.when(F.col("_lt") != ts_begin, F.col("_lt")))
    return sl.where(closed | (F.col("seg") == 0)).select(
        rec, "seg", F.when(closed, (F.col("_first") - ts_begin) * precision).otherwise(F.lit(0.0)).alias("start"),
        ((end - ts_begin) * precision).alias("end"),
        F.when(closed, F.col("_n") - 2).otherwise(F.col("_n")).alias("n_text"))


def end_detect(hyps: DataFrame, utt: str, length: str, score: str, M: int = 3, d_end: float = -10.0,
               at: Column | None = None) -> DataFrame:
    """per utterance, at step ``at`` (default: the longest ended hypothesis),
    ended when for each of the M lengths at, at-1, ... the best hypothesis of that
    length trails the overall best by more than |d_end| (missing lengths fail)."""
    best = hyps.groupBy(utt).agg(F.max(score).alias("_best"), F.max(length).alias("_i"))
    per_len = hyps.groupBy(utt, length).agg(F.max(score).alias("_s"))
    j = best.join(per_len, utt, "left")
    i = at if at is not None else F.col("_i")
    hit = (F.col(length) <= i) & (F.col(length) > i - M) & (F.col("_s") - F.col("_best") < d_end)
    return j.groupBy(utt).agg((F.count(F.when(hit, 1)) == M).alias("ended"))
