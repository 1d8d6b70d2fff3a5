"""Utterance manifests: assembly, completeness, validity, key-set checks.

Tables are keyed by ``utt`` (utterance id) and ``spk`` (speaker id).  All
joins are declared plainly; Catalyst/AQE pick broadcast vs. sort-merge from
runtime sizes, so a speaker table that turns out small is broadcast and a
feature table as large as the manifest is shuffled on ``utt``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvox.functions.text import py_strip, word_tokens
from corpusvox.plans.sequence import seq_row_number


def attach(df: DataFrame, feature: DataFrame, on: str | Sequence[str],
           defaults: Mapping[str, object], flag: str | None = None) -> DataFrame:
    """Left-join a feature table; fill misses with defaults; optional presence flag.

    ``defaults`` maps feature column -> default value (python literal or Column).
    """
    keys = [on] if isinstance(on, str) else list(on)
    cols = list(defaults)
    right = feature.select(*keys, *cols)
    if flag:
        right = right.withColumn(flag, F.lit(True))
    out = df.join(right, keys, "left")
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), d if isinstance(d, Column) else F.lit(d)))
    if flag:
        out = out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return out


def zeros(dim: int, dtype: str = "float") -> Column:
    return F.array_repeat(F.lit(0.0).cast(dtype), dim)


def assemble_utterances(wav: DataFrame, text: DataFrame | None = None,
                        utt2spk: DataFrame | None = None,
                        utt_features: Sequence[tuple[DataFrame, Mapping[str, object], str | None]] = (),
                        spk_features: Sequence[tuple[DataFrame, Mapping[str, object], str | None]] = ()
                        ) -> DataFrame:
    """The audio list drives; text, speaker and features are attached.

    Misses become ``""`` (text), ``"unknown"`` (speaker) or the feature's
    default (zeros vector, empty token list, ...).
    """
    out = wav
    if text is not None:
        out = attach(out, text, "utt", {"text": ""})
    if utt2spk is not None:
        out = attach(out, utt2spk, "utt", {"spk": "unknown"})
    for feat, defaults, flag in utt_features:
        out = attach(out, feat, "utt", defaults, flag)
    for feat, defaults, flag in spk_features:
        out = attach(out, feat, "spk", defaults, flag)
    return out


def completeness_report(manifest: DataFrame, checks: Mapping[str, DataFrame], key: str = "utt") -> DataFrame:
    """One row per (utterance, missing thing), from anti joins.

    ``checks`` maps a reason label to a table keyed by ``key``.
    """
    parts = [manifest.select(key).join(t.select(key), key, "left_anti").withColumn("reason", F.lit(r))
             for r, t in checks.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keep_paired(left: DataFrame, right: DataFrame, key: str = "utt") -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` with a partner in ``right`` and the dropped ones."""
    keys = right.select(key).distinct()
    return left.join(keys, key, "left_semi"), left.join(keys, key, "left_anti")


def keyset_diff(tables: Mapping[str, DataFrame], key: str = "utt") -> DataFrame:
    """Keys not present in every table, with the tables that lack them.

    Empty result <=> all key sets are equal.
    """
    names = list(tables)
    tagged = None
    for n in names:
        t = tables[n].select(key).distinct().withColumn("table", F.lit(n))
        tagged = t if tagged is None else tagged.unionByName(t)
    per_key = tagged.groupBy(key).agg(F.collect_set("table").alias("present"))
    everyone = F.array(*[F.lit(n) for n in names])
    return (per_key.where(F.size("present") < len(names))
            .select(key, F.array_sort(F.array_except(everyone, "present")).alias("missing_in")))


def last_wins(df: DataFrame, key: str, pos: str, cols: Sequence[str]) -> DataFrame:
    """Per key keep the values of the row with the highest position (dict semantics)."""
    return df.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(c) for c in cols]), F.col(pos)).alias("_v"),
        F.count(F.lit(1)).alias("n_copies"),
    ).select(key, *[F.col("_v")[c].alias(c) for c in cols], "n_copies")


def length_filter(df: DataFrame, length: str = "n_samples", n_tokens: str = "n_tokens",
                  min_length: float = 100, max_length: float = 40960,
                  token_min_length: int = 1, token_max_length: int = 200) -> DataFrame:
    """Both bounds inclusive; a bound <= 0 on the max side disables it."""
    cond = F.col(length) >= min_length
    if max_length and max_length > 0:
        cond &= F.col(length) <= max_length
    cond &= F.col(n_tokens) >= token_min_length
    if token_max_length and token_max_length > 0:
        cond &= F.col(n_tokens) <= token_max_length
    return df.where(cond)


def spk2utt(utt2spk: DataFrame) -> DataFrame:
    """A2 in long form: (spk, idx, utt) with utts sorted inside each speaker.

    The Kaldi line ``spk utt1 utt2 ...`` is a rendering of this table by the
    sink; keeping it long means a hot speaker is never collected into one row.
    """
    return seq_row_number(utt2spk.select("spk", "utt"), ["spk"], ["utt"], "idx").drop("_seq_b")


def corpus_counts(utt2spk: DataFrame) -> DataFrame:
    """A4: utterances, speakers, mean utterances per speaker."""
    return utt2spk.agg(
        F.count(F.lit(1)).alias("n_utts"),
        F.countDistinct("spk").alias("n_spks"),
    ).withColumn("utts_per_spk", F.try_divide(F.col("n_utts").cast("double"), F.col("n_spks")))


def length_stats(df: DataFrame, length: str = "n_tokens") -> DataFrame:
    """A3: min / max / mean of a length column (NULL on an empty table)."""
    return df.agg(F.min(length).alias("min_len"), F.max(length).alias("max_len"),
                  F.avg(length).alias("mean_len"), F.count(length).alias("n"))


def shape_table(df: DataFrame, kind: str = "sound", key: str = "utt", samples: str = "n_samples",
                text: str = "text", sample_rate: int = 16000, frame_shift_ms: float = 10,
                lfr_n: int = 1, min_len: int = 0, max_len: int = 0) -> DataFrame:
    """K5: key -> length.  Audio: ceil(samples*1000/(sr*shift*lfr_n)) frames;
    text: words if the text has a space, else characters.  A bound applies only
    when configured and > 0."""
    if kind == "sound":
        length = frame_count(F.col(samples), sample_rate, frame_shift_ms, lfr_n)
    else:
        length = text_length(F.col(text))
    out = df.select(key, length.alias("length"))
    if min_len and min_len > 0:
        out = out.where(F.col("length") >= min_len)
    if max_len and max_len > 0:
        out = out.where(F.col("length") <= max_len)
    return out


def text_length(text: Column) -> Column:
    """on the stripped line, ``len(line.split())`` if it contains a space, else characters."""
    line = py_strip(text)
    return F.when(F.instr(line, " ") > 0, F.size(word_tokens(line))).otherwise(F.length(line)).cast("long")


def audio_index_length(samples: Column, sample_rate: int = 16000) -> Column:
    """index length of an audio source counts whole seconds only (x100)."""
    return (F.floor(samples / sample_rate) * 100).cast("long")


# ------------------------------------------------------------ row rules

def keep_sample_rates(df: DataFrame, rate: str, target: int, least: int = 16000) -> DataFrame:
    """Keep rows whose rate is ``target`` already or at least ``least`` (a NULL rate is dropped)."""
    return df.where((F.col(rate) == target) | (F.col(rate) >= least))


def drop_long(df: DataFrame, length: str, most: int = 5000) -> DataFrame:
    """Drop rows longer than ``most`` before they are batched (a NULL length is kept)."""
    return df.where(F.coalesce(F.col(length) <= most, F.lit(True)))


def align_frames(df: DataFrame, frames: str, tokens: str, ratio: int) -> DataFrame:
    """With n = min(frames // ratio, tokens), keep the first ``ratio * n`` frames and n tokens."""
    n = F.least(F.floor(F.size(frames) / ratio), F.size(tokens)).cast("int")
    return df.withColumns({frames: F.slice(frames, F.lit(1), n * ratio), tokens: F.slice(tokens, F.lit(1), n)})


def token_rate_ok(n_tokens: Column, samples: Column, sample_rate: int = 16000, per_second: int = 25,
                  slack: int = 2) -> Column:
    """Whether the token count is within ``slack`` of what the duration (to 2 decimals) calls for."""
    return F.abs(n_tokens - per_second * F.round(samples / float(sample_rate), 2)) <= slack


def frame_count(samples: Column, sample_rate: int = 16000, frame_shift_ms: float = 10, lfr_n: int = 1) -> Column:
    """K5: frames of an audio of so many samples, the last one started."""
    return F.ceil(samples * 1000.0 / (sample_rate * frame_shift_ms * lfr_n)).cast("long")
