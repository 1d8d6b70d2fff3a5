"""Array-valued column functions for embeddings and frame sequences.

Vectors are ``ARRAY<FLOAT|DOUBLE>``; frame sequences are ``ARRAY<ARRAY<FLOAT>>``
shaped [T][D].  All math uses higher-order functions (``transform``,
``zip_with``, ``aggregate``) with DOUBLE accumulators, so it stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvox.functions.text import bound

def D0() -> Column:
    return F.lit(0.0).cast("double")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), D0(),
                       lambda acc, v: acc + v)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a, floor: float = 1e-12) -> Column:
    """x / max(||x||, floor).  The norm is one aggregate pass; its finish
    step rescales, so the cost stays linear in the vector length."""
    x = _c(a)
    return F.aggregate(x, D0(), lambda acc, v: acc + v.cast("double") * v.cast("double"),
                       lambda ss: F.transform(x, lambda v: v.cast("double") / F.greatest(F.sqrt(ss), F.lit(floor))))


def cosine(a, b, floor: float = 1e-12) -> Column:
    """cosine similarity with the norm floor on both sides."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(floor)) * F.greatest(norm(b), F.lit(floor)))


def sq_distance(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)),
                       D0(), lambda acc, v: acc + v)


def peak(a) -> Column:
    return F.array_max(F.transform(_c(a), lambda x: F.abs(x.cast("double"))))


def peak_normalize(a, mode: str = "energy", max_amplitude: float = 0.6) -> Column:
    """``energy``: x / max(peak, 0.01) * 0.999; ``cap``: scale to max_amplitude
    only when the peak exceeds it; ``clip``: divide by the peak only when it is > 1.

    The peak is found in one pass and the rescale runs in its finish step."""
    x = _c(a)
    if mode == "energy":
        fin = lambda p: F.transform(x, lambda v: v.cast("double") / F.greatest(p, F.lit(0.01)) * 0.999)
    elif mode == "cap":
        fin = lambda p: F.transform(x, lambda v: F.when(p > max_amplitude, v.cast("double") / p * max_amplitude)
                                    .otherwise(v.cast("double")))
    elif mode == "clip":
        fin = lambda p: F.transform(x, lambda v: F.when(p > 1, v.cast("double") / p)
                                    .otherwise(v.cast("double")))
    else:
        raise ValueError(mode)
    return F.aggregate(x, D0(), lambda acc, v: F.greatest(acc, F.abs(v.cast("double"))), fin)


def frames_of(vec) -> Column:
    """A 1-D signal as a [T][1] frame sequence."""
    return F.transform(_c(vec), lambda v: F.array(v.cast("double")))


def frame_mean(frames) -> Column:
    """Mean over frames, per dimension (frames non-empty)."""
    f = _c(frames)
    dims = F.sequence(F.lit(0), F.size(F.element_at(f, 1)) - 1)
    return F.transform(dims, lambda d: F.aggregate(f, D0(), lambda acc, r: acc + r[d].cast("double")) / F.size(f))


def utterance_mvn(frames, norm_vars: bool = True, eps: float = 1e-20) -> Column:
    """Subtract the per-utterance mean; optionally divide by the population std
    (clamped at eps).  The reference's mean+var path divides by sqrt(std); we divide by std.

    Each statistic is one ``aggregate`` pass whose finish step rewrites the
    frames, so the per-frame work is O(D) and the whole call O(T*D)."""
    f = _c(frames)
    t = F.size(f)
    zeros = F.transform(F.element_at(f, 1), lambda x: F.lit(0.0).cast("double"))
    centred = F.aggregate(
        f, zeros, lambda acc, r: F.zip_with(acc, r, lambda a, x: a + x.cast("double")),
        lambda acc: F.transform(f, lambda r: F.zip_with(r, acc, lambda x, s: x.cast("double") - s / t)))
    if not norm_vars:
        return centred
    return F.aggregate(
        centred, zeros, lambda acc, r: F.zip_with(acc, r, lambda a, x: a + x * x),
        lambda acc: F.transform(centred, lambda r: F.zip_with(
            r, acc, lambda x, s: x / F.greatest(F.sqrt(s / t), F.lit(eps)))))


def apply_cmvn(frames, shift, scale) -> Column:
    """(x + shift) * scale per dimension."""
    return F.transform(_c(frames), lambda r: F.zip_with(
        F.zip_with(r, _c(shift), lambda x, s: x.cast("double") + s), _c(scale), lambda y, k: y * k))


def lfr(frames, m: int = 7, n: int = 6) -> Column:
    """Stack m frames every n; left pad (m-1)//2 copies of frame 0; the last
    outputs are padded with the final frame.  ceil(T/n) outputs of m*D values."""
    pad = (m - 1) // 2

    def stacked(f):
        t = F.size(f)
        outs = F.sequence(F.lit(0), F.ceil(t / F.lit(n)).cast("int") - 1)
        return F.when(t > 0, F.transform(outs, lambda i: F.flatten(F.transform(
            F.sequence(F.lit(0), F.lit(m - 1)),
            lambda j: F.element_at(f, F.least(F.greatest(i * n + j - pad, F.lit(0)), t - 1) + 1))))) \
            .otherwise(F.array().cast("array<array<double>>"))
    return bound(_c(frames), stacked)


def splice(frames, context: int) -> Column:
    """Each frame joined with +-context neighbours, zero padded at the edges."""
    def spliced(f):
        t = F.size(f)
        zero = F.transform(F.element_at(f, 1), lambda x: F.lit(0.0).cast("double"))
        return F.transform(F.sequence(F.lit(0), t - 1), lambda i: F.flatten(F.transform(
            F.sequence(F.lit(-context), F.lit(context)),
            lambda o: F.when((i + o >= 0) & (i + o < t),
                             F.transform(F.element_at(f, i + o + 1), lambda x: x.cast("double"))).otherwise(zero))))
    return bound(_c(frames), spliced)


def subsample(frames, k: int) -> Column:
    """Keep every k-th frame starting at 0."""
    return F.filter(_c(frames), lambda x, i: i % k == 0)


def pad_to(arr, length, pad_value) -> Column:
    """Right-pad with ``pad_value`` to ``length`` (or trim)."""
    a = _c(arr)
    ln = length if isinstance(length, Column) else F.lit(length)
    return F.slice(F.concat(a, F.array_repeat(F.lit(pad_value), F.greatest(ln - F.size(a), F.lit(0)))), 1, ln)


def pad_mask(lengths, max_len) -> Column:
    """True at padded positions."""
    ml = max_len if isinstance(max_len, Column) else F.lit(max_len)
    return F.transform(F.sequence(F.lit(0), ml - 1), lambda i: i >= _c(lengths))


def frame_energy_db(signal, frame_len: int, shift: int) -> Column:
    """10*log10(sum(x^2) + 1e-6) over frames of ``frame_len`` samples every ``shift``."""
    s = _c(signal)
    n = F.floor((F.size(s) - frame_len) / shift) + 1
    return F.when(F.size(s) >= frame_len, F.transform(F.sequence(F.lit(0), n - 1), lambda i: 10 * F.log10(
        F.aggregate(F.slice(s, i * shift + 1, frame_len), D0(),
                    lambda acc, x: acc + x.cast("double") * x.cast("double")) + 1e-6))) \
        .otherwise(F.array().cast("array<double>"))


def split_chunks(seq, chunk: int, left: int, right: int) -> Column:
    """Cut a sequence into chunks of ``chunk`` core items with ``left`` /
    ``right`` items of context (fewer at the edges); array of struct(idx, lo, items)."""
    s = _c(seq)
    n = F.ceil(F.size(s) / chunk).cast("int")
    return F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        i.alias("idx"),
        (i * chunk - F.greatest(F.lit(0), i * chunk - left)).alias("lo"),
        F.slice(s, F.greatest(F.lit(0), i * chunk - left) + 1,
                F.least(F.size(s), (i + 1) * chunk + right) - F.greatest(F.lit(0), i * chunk - left)).alias("items"))))


def stitch_chunks(chunks, chunk: int) -> Column:
    """W20 inverse: drop each chunk's context and concatenate the cores."""
    return F.flatten(F.transform(_c(chunks), lambda c: F.slice(c["items"], c["lo"] + 1, chunk)))


def pad_or_trim(arr, length: int, pad_value=0.0) -> Column:
    """F8: right-pad with ``pad_value`` or cut to exactly ``length`` items."""
    return pad_to(arr, length, pad_value)


def clip_at(arr, length: int, start: Column) -> Column:
    """F8: a window of ``length`` items starting at ``start`` (0-based) when longer."""
    a = _c(arr)
    return F.when(F.size(a) > length, F.slice(a, start + 1, length)).otherwise(a)


def trim_silence_bounds(db, threshold_db: float = 20.0, keep_left: int = 0, keep_right: int = 0) -> Column:
    """first and last frame whose energy is within ``threshold_db`` of the peak,
    widened by the keep margins and clipped: struct(first, last) (frame indexes)."""
    d = _c(db)
    peak_db = F.array_max(d)
    idx = F.filter(F.transform(d, lambda v, i: F.when(v > peak_db - threshold_db, i)), lambda i: i.isNotNull())
    return F.struct(F.greatest(F.lit(0), F.array_min(idx) - keep_left).alias("first"),
                    F.least(F.size(d) - 1, F.array_max(idx) + keep_right).alias("last"))


def mel_filterbank(n_mels: int, n_fft: int, sample_rate: int, fmin: float = 0.0, fmax: float | None = None):
    """Triangular filters on the HTK mel scale (built from the parameters)."""
    fmax = fmax or sample_rate / 2
    mel = lambda f: 2595.0 * np.log10(1.0 + np.asarray(f) / 700.0)
    inv = lambda m: 700.0 * (10 ** (np.asarray(m) / 2595.0) - 1.0)
    pts = inv(np.linspace(mel(fmin), mel(fmax), n_mels + 2))
    freqs = np.linspace(0, sample_rate / 2, n_fft // 2 + 1)
    fb = np.zeros((n_mels, len(freqs)))
    for i in range(n_mels):
        lo, c, hi = pts[i], pts[i + 1], pts[i + 2]
        fb[i] = np.clip(np.minimum((freqs - lo) / max(c - lo, 1e-9), (hi - freqs) / max(hi - c, 1e-9)), 0, None)
    return fb


def log_mel(signal, frame_len: int = 400, hop: int = 160, n_fft: int = 512, n_mels: int = 80,
            sample_rate: int = 16000, floor: float = 1e-10) -> Column:
    """framing, Hamming window, power spectrum (rfft), mel filterbank, log with
    a floor -> ARRAY<ARRAY<DOUBLE>> [frames][n_mels].  One Arrow-batched pandas UDF
    running numpy per row (the signal of one utterance is one row)."""
    from pyspark.sql import types as T

    fb = mel_filterbank(n_mels, n_fft, sample_rate)
    win = np.hamming(frame_len)

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def run(s: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            x = np.asarray(x, dtype=np.float64)
            if len(x) < frame_len:
                return []
            n = 1 + (len(x) - frame_len) // hop
            idx = np.arange(frame_len)[None, :] + hop * np.arange(n)[:, None]
            spec = np.abs(np.fft.rfft(x[idx] * win, n=n_fft)) ** 2
            return np.log(np.maximum(spec @ fb.T, floor)).tolist()
        return s.map(one)

    return run(_c(signal))
