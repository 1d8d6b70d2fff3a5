"""Codec token stream functions (F16-F18) as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token id offsets of the two codec streams and the group shape.
AUDIO_OFFSET = 65536
SECOND_STREAM_SHIFT = 1024
FIRST_PER_GROUP = 2
SECOND_PER_GROUP = 3
# Tail used to pad an incomplete group of five when de-interleaving.
RESHAPE_PAD = (0, 0, 0, 1024, 1024, 1024)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _groups(a: Column, b: Column) -> Column:
    return F.least(F.floor(F.size(b) / SECOND_PER_GROUP), F.floor(F.size(a) / FIRST_PER_GROUP)).cast("int")


def _interleave(a: Column, b: Column, off_a: int, off_b: int) -> Column:
    g = _groups(a, b)
    return F.when(g > 0, F.flatten(F.transform(F.sequence(F.lit(0), g - 1), lambda i: F.concat(
        F.transform(F.slice(a, i * FIRST_PER_GROUP + 1, FIRST_PER_GROUP), lambda x: x + off_a),
        F.transform(F.slice(b, i * SECOND_PER_GROUP + 1, SECOND_PER_GROUP), lambda x: x + off_b))))) \
        .otherwise(F.array().cast("array<bigint>"))


def interleave_streams(vq02, vq06) -> Column:
    """groups of 2 first-stream + 3 second-stream ids, min(len02//2, len06//3)
    groups, tails dropped; ids offset by 65536 and 65536+1024."""
    return _interleave(_c(vq02), _c(vq06), AUDIO_OFFSET, AUDIO_OFFSET + SECOND_STREAM_SHIFT)


def render_audio_tokens(vq02, vq06) -> Column:
    """F16 render: the interleaved ids (second stream +1024) as '<audio_N>' text."""
    ids = _interleave(_c(vq02), _c(vq06), 0, SECOND_STREAM_SHIFT)
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit("<audio_"), x.cast("string"), F.lit(">"))), "")


def parse_audio_tokens(text) -> Column:
    """F16 parse: '<audio_N>' tokens -> N + 65536."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"<audio_(\d+)>"), 1),
                       lambda s: s.cast("bigint") + AUDIO_OFFSET)


def deinterleave(mix) -> Column:
    """pad to a multiple of 5 from the tail of RESHAPE_PAD, then per group
    first stream = 2 ids + 1024 pad, second stream = 3 ids + 1.  Returns an
    array of struct(a, b) aligned in time (3 steps per group)."""
    m = _c(mix)
    pad_len = (F.lit(5) - F.size(m) % 5) % 5
    pad = F.slice(F.array(*[F.lit(v).cast("bigint") for v in RESHAPE_PAD]),
                  F.lit(len(RESHAPE_PAD)) - pad_len + 1, pad_len)
    full = F.when(pad_len > 0, F.concat(m, pad)).otherwise(m)
    g = (F.size(full) / 5).cast("int")
    steps = F.sequence(F.lit(0), g * 3 - 1)
    first = F.transform(steps, lambda t: F.when(t % 3 == 2, F.lit(1024).cast("bigint"))
                        .otherwise(F.element_at(full, (F.floor(t / 3) * 5 + t % 3 + 1).cast("int"))))
    second = F.transform(steps, lambda t: F.element_at(full, (F.floor(t / 3) * 5 + 2 + t % 3 + 1).cast("int")) + 1)
    return F.when(g > 0, F.arrays_zip(first.alias("a"), second.alias("b")))
