"""Seeded, reproducible augmentation as table operators.

Randomness is a hash of (seed, key, draw): the first 8 hex digits of an md5,
read as an unsigned 32-bit number, so a recomputed task draws the same values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *parts) -> Column:
    """Uniform integer in [0, 2^32) from md5(seed:parts...)."""
    cols = [F.lit(str(seed))] + [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")


def speed_factor(key: Column, factors: Sequence[float] = (0.9, 1.0, 1.1), seed: int = 0) -> Column:
    """One speed factor per utterance (the resampling itself is not built)."""
    arr = F.array(*[F.lit(float(f)) for f in factors])
    return F.element_at(arr, (F.pmod(draw(seed, key), F.lit(len(factors))) + 1).cast("int"))


def permute_speakers(df: DataFrame, rec: str, spk: str, seed: int = 0, out: str = "new_spk") -> DataFrame:
    """A random order of the speakers of each recording, applied through a
    (rec, spk) -> new index mapping (one row per speaker of a recording)."""
    spks = df.select(rec, spk).distinct()
    m = spks.withColumn(out, (F.row_number().over(
        Window.partitionBy(rec).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(rec).cast("string"),
                                                          F.col(spk).cast("string"))), spk)) - 1).cast("int"))
    return df.join(m, [rec, spk])


def mask_spans(df: DataFrame, key: str, length: str, num_mask: int = 2, max_width: int = 10,
               seed: int = 0) -> DataFrame:
    """G1/G3 (static): ``num_mask`` spans per row, width uniform in [0, max_width),
    start uniform in [0, length - width]; one row per span."""
    spans = df.select(key, length, F.explode(F.sequence(F.lit(0), F.lit(num_mask - 1))).alias("mask"))
    width = F.least(F.pmod(draw(seed, F.col(key), F.col("mask"), "w"), F.lit(max_width)), F.col(length))
    spans = spans.withColumn("width", width.cast("long"))
    start = F.pmod(draw(seed, F.col(key), F.col("mask"), "s"), F.col(length) - F.col("width") + 1)
    return spans.withColumn("start", start.cast("long"))


def masked_frames(spans: DataFrame, key: str) -> DataFrame:
    """Distinct masked frame indexes per row (the union of its spans)."""
    return spans.where(F.col("width") > 0).select(
        key, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("frame")).distinct()


def fill_masks(df: DataFrame, key: str, vec: str, spans: DataFrame, axis: str = "time", n_freq: int = 1,
               fill: str = "zero") -> DataFrame:
    """G1: write zero or the row's mean over the masked part of a (time x ``n_freq``) signal kept row by row.

    ``spans`` (from ``mask_spans``) count frames with ``axis="time"`` and bins with ``axis="freq"``;
    a row has ``num_mask`` of them, so they are gathered into its row."""
    own = spans.groupBy(key).agg(F.collect_list(F.struct("start", "width")).alias("_spans"))
    value = {"zero": F.lit(0.0), "mean": F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x) / F.size(vec)}[fill]

    def place(i: Column) -> Column:
        return F.floor(i / n_freq) if axis == "time" else i % n_freq

    def masked(i: Column) -> Column:
        return F.exists(F.coalesce("_spans", F.array()), lambda s: (place(i) >= s["start"]) & (place(i) < s["start"] + s["width"]))
    out = F.transform(vec, lambda x, i: F.when(masked(i), F.col("_fill")).otherwise(x.cast("double")))
    return df.join(own, key, "left").withColumn("_fill", value).withColumn(vec, out).drop("_spans", "_fill")


def disturb_profiles(profiles: DataFrame, rec: str, spk: str, vec: str, prob: float = 0.4,
                     alpha: float = 0.2, seed: int = 0) -> DataFrame:
    """G4 (disturb part): in a seeded share ``prob`` of recordings, every speaker
    profile is mixed with one other profile of the same recording (a seeded
    partner, never itself): normalize(p + alpha * partner).  One partner per
    profile -- a keyed join, never all pairs.  Adds ``disturbed``."""
    from corpusvox.functions.vectors import l2_normalize
    p = profiles.select(rec, spk, vec)
    ranked = p.withColumn("_i", F.dense_rank().over(Window.partitionBy(rec).orderBy(spk)) - 1) \
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(rec)))
    chosen = (F.pmod(draw(seed, F.col(rec), "disturb"), F.lit(1000)) < int(prob * 1000)) & (F.col("_n") > 1)
    partner = F.pmod(F.col("_i") + 1 + F.pmod(draw(seed, F.col(rec), F.col("_i")), F.col("_n") - 1), F.col("_n"))
    x = ranked.withColumn("_chosen", chosen).withColumn("_j", F.when(chosen, partner))
    other = ranked.select(F.col(rec).alias("_r2"), F.col("_i").alias("_j2"), F.col(vec).alias("_pv"))
    j = x.join(other, (x[rec] == other["_r2"]) & (x["_j"] == other["_j2"]), "left")
    mixed = F.zip_with(F.col(vec), F.col("_pv"), lambda a, b: a.cast("double") + alpha * b.cast("double"))
    out = F.when(F.col("_chosen"), l2_normalize(mixed)).otherwise(F.transform(vec, lambda a: a.cast("double")))
    return j.select(rec, spk, out.alias(vec), F.col("_chosen").alias("disturbed"))


def merge_profiles(profiles: DataFrame, rec: str, spk: str, vec: str, prob: float = 0.2,
                   seed: int = 0) -> DataFrame:
    """G4 (merge part): in a seeded share ``prob`` of recordings with two or more
    profiles, a seeded pair (a, b) is merged: a becomes normalize(a + b), b becomes
    a zero vector and its labels map to a (``label_to`` gives the mapping for
    frame labels).  Each recording touches one pair -- a keyed join."""
    from corpusvox.functions.vectors import l2_normalize
    p = profiles.select(rec, spk, vec)
    ranked = p.withColumn("_i", F.dense_rank().over(Window.partitionBy(rec).orderBy(spk)) - 1) \
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(rec)))
    chosen = (F.pmod(draw(seed, F.col(rec), "merge"), F.lit(1000)) < int(prob * 1000)) & (F.col("_n") > 1)
    a = F.pmod(draw(seed, F.col(rec), "a"), F.col("_n"))
    b = F.pmod(a + 1 + F.pmod(draw(seed, F.col(rec), "b"), F.col("_n") - 1), F.col("_n"))
    x = ranked.withColumn("_chosen", chosen).withColumn("_a", a).withColumn("_b", b)
    bvec = ranked.select(F.col(rec).alias("_r2"), F.col("_i").alias("_i2"), F.col(vec).alias("_bv"),
                         F.col(spk).alias("_bspk"))
    aspk = ranked.select(F.col(rec).alias("_r3"), F.col("_i").alias("_i3"), F.col(spk).alias("_aspk"))
    j = x.join(bvec, (x[rec] == bvec["_r2"]) & (x["_b"] == bvec["_i2"]), "left") \
        .join(aspk, (x[rec] == aspk["_r3"]) & (x["_a"] == aspk["_i3"]), "left")
    is_a = F.col("_chosen") & (F.col("_i") == F.col("_a"))
    is_b = F.col("_chosen") & (F.col("_i") == F.col("_b"))
    summed = F.zip_with(F.col(vec), F.col("_bv"), lambda u, w: u.cast("double") + w.cast("double"))
    out = F.when(is_a, l2_normalize(summed)) \
        .when(is_b, F.transform(vec, lambda u: F.lit(0.0).cast("double"))) \
        .otherwise(F.transform(vec, lambda u: u.cast("double")))
    return j.select(rec, spk, out.alias(vec), F.when(is_b, F.col("_aspk")).otherwise(F.col(spk)).alias("label_to"),
                    is_a.alias("merged_into"), is_b.alias("merged_away"))
