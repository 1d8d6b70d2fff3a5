"""More operator families wired to the tables: semi/keyed joins, order restore,
VAD slicing, language id, augmentation draws, writer checks, batch inference,
speaker mapping and duration batching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from corpusvox.operators import augment as Ag
from corpusvox.operators import batching as Bt
from corpusvox.operators import segments as G
from corpusvox.operators.extensions import batch_inference
from corpusvox.plans.q_segments import EV, _frames, events
from corpusvox.plans.registry import T, register
from corpusvox.sources.sinks import keyed_writer_checks


@register("semi_join_speakers", """
SELECT doc_id AS utt, source AS spk FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def q_semi(spark, sf):
    """utt2spk restricted to utterances that have a feature row."""
    d = T(spark, sf, "documents").select(F.col("doc_id").alias("utt"), F.col("source").alias("spk"))
    l = T(spark, sf, "labels").select(F.col("doc_id").alias("utt"))
    return d.join(l, "utt", "left_semi")


@register("keyed_lists", """
SELECT l.doc_id AS key, l.quality AS source, d.n_chars AS target FROM labels l JOIN documents d ON d.doc_id = l.doc_id""")
def q_keyed_lists(spark, sf):
    """The first list drives; every key must exist in the second (checked, else error)."""
    src = T(spark, sf, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("source"))
    tgt = T(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("n_chars").alias("target"))
    if src.join(tgt, "key", "left_anti").limit(1).count():
        raise ValueError("a key of the first list is missing from the second")
    return src.join(tgt, "key")


@register("restore_order", "WITH " + EV + """,
x AS (SELECT rec, event_id, start, value,
             row_number() OVER (PARTITION BY rec ORDER BY start, event_id) - 1 AS seg_idx,
             row_number() OVER (PARTITION BY rec ORDER BY value, start, event_id) - 1 AS dur_rank FROM ev)
SELECT rec, seg_idx, dur_rank, floor(start * 1000)::BIGINT AS beg_ms,
       floor(start * 1000)::BIGINT + floor(value * 100)::BIGINT AS end_ms FROM x""")
def q_restore(spark, sf):
    """Results produced in duration order carry their segment index; joined
    back on (recording, index) they are in time order and shifted by the start."""
    from corpusvox.plans.sequence import seq_row_number
    e = events(spark, sf)
    segs = seq_row_number(e, ["rec"], ["start", "event_id"], "seg_idx").drop("_seq_b") \
        .withColumn("seg_idx", F.col("seg_idx") - 1)
    by_dur = seq_row_number(segs.select("rec", "seg_idx", "value", "start", "event_id"), ["rec"],
                            ["value", "start", "event_id"], "dur_rank").drop("_seq_b")
    # "model results" in duration order: local timestamps relative to the segment
    results = by_dur.select("rec", "seg_idx", (F.col("dur_rank") - 1).alias("dur_rank"),
                            F.lit(0).cast("long").alias("loc_beg"),
                            F.floor(F.col("value") * 100).cast("long").alias("loc_end"))
    back = segs.select("rec", "seg_idx", F.floor(F.col("start") * 1000).cast("long").alias("off")) \
        .join(results, ["rec", "seg_idx"])
    return back.select("rec", "seg_idx", "dur_rank", (F.col("off") + F.col("loc_beg")).alias("beg_ms"),
                       (F.col("off") + F.col("loc_end")).alias("end_ms"))


@register("vad_slices", "WITH " + EV + """,
n AS (SELECT rec, floor(max("end") * 16000)::BIGINT AS n_samples FROM ev GROUP BY rec)
SELECT ev.rec, event_id, floor(start * 1000 * 16)::BIGINT AS beg_idx,
       least(floor("end" * 1000 * 16)::BIGINT, n.n_samples) AS end_idx
FROM ev JOIN n USING (rec)""")
def q_vad_slices(spark, sf):
    """segment milliseconds -> sample indexes (16 per ms), clipped to the length."""
    e = events(spark, sf)
    n = e.groupBy("rec").agg(F.floor(F.max("end") * 16000).cast("long").alias("n_samples"))
    x = e.join(n, "rec")
    return x.select("rec", "event_id", F.floor(F.col("start") * 1000 * 16).cast("long").alias("beg_idx"),
                    F.least(F.floor(F.col("end") * 1000 * 16).cast("long"), F.col("n_samples")).alias("end_idx"))


@register("language_id", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang),
p AS (SELECT source, lang, n / sum(n) OVER (PARTITION BY source) AS prob FROM c)
SELECT source, lang, round(prob, 6) AS prob FROM p
QUALIFY row_number() OVER (PARTITION BY source ORDER BY prob DESC, lang) = 1""")
def q_lang(spark, sf):
    """Arg-max language per source (first in code order on ties) and its probability."""
    d = T(spark, sf, "documents")
    c = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    tot = c.groupBy("source").agg(F.sum("n").alias("t"))
    p = c.join(tot, "source").withColumn("prob", F.col("n") / F.col("t"))
    best = p.groupBy("source").agg(F.min_by(F.struct("lang", "prob"), F.struct(-F.col("prob"), F.col("lang"))).alias("b"))
    return best.select("source", F.col("b.lang").alias("lang"), F.round("b.prob", 6).alias("prob"))


@register("speed_choice", """
SELECT doc_id, [0.9, 1.0, 1.1][(('0x' || md5('7:' || doc_id::VARCHAR)[1:8])::BIGINT % 3) + 1]::DOUBLE AS factor
FROM documents""")
def q_speed(spark, sf):
    """Seeded speed factor per utterance."""
    d = T(spark, sf, "documents")
    return d.select("doc_id", Ag.speed_factor(F.col("doc_id"), seed=7).alias("factor"))


@register("speaker_permutation", """
WITH s AS (SELECT DISTINCT user_id AS rec, event_type AS spk FROM events)
SELECT rec, spk, (row_number() OVER (PARTITION BY rec ORDER BY md5('3:' || rec::VARCHAR || ':' || spk), spk) - 1)::INTEGER
       AS new_spk FROM s""")
def q_permutation(spark, sf):
    """Seeded speaker order per recording (mapping applied by join)."""
    e = T(spark, sf, "events").select(F.col("user_id").alias("rec"), F.col("event_type").alias("spk"))
    return Ag.permute_speakers(e, "rec", "spk", seed=3).select("rec", "spk", "new_spk").distinct()


@register("time_masks", """
WITH m AS (SELECT vec_id, len(embedding)::BIGINT AS n, k FROM embeddings, unnest(range(2)) AS r(k)),
w AS (SELECT vec_id, n, k, least(('0x' || md5('5:' || vec_id::VARCHAR || ':' || k::VARCHAR || ':w')[1:8])::BIGINT % 10, n)
             AS width FROM m),
s AS (SELECT vec_id, width,
             ('0x' || md5('5:' || vec_id::VARCHAR || ':' || k::VARCHAR || ':s')[1:8])::BIGINT % (n - width + 1) AS start
      FROM w WHERE width > 0),
f AS (SELECT DISTINCT vec_id, unnest(range(start, start + width)) AS frame FROM s)
SELECT e.vec_id, count(f.frame) AS masked FROM embeddings e LEFT JOIN f ON f.vec_id = e.vec_id GROUP BY e.vec_id""")
def q_masks(spark, sf):
    """Two seeded time-mask spans per 64-frame signal; number of masked frames."""
    e = T(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"))
    spans = Ag.mask_spans(e, "vec_id", "n", num_mask=2, max_width=10, seed=5)
    frames = Ag.masked_frames(spans, "vec_id")
    return e.join(frames, "vec_id", "left").groupBy("vec_id").agg(F.count("frame").alias("masked"))


def _fill_sql(seed, num_mask, max_width, length, place, fill):
    return f"""
WITH m AS (SELECT vec_id, {length}::BIGINT AS n, k FROM embeddings, unnest(range({num_mask})) AS r(k)),
w AS (SELECT vec_id, n, k, least(('0x' || md5('{seed}:' || vec_id || ':' || k || ':w')[1:8])::BIGINT % {max_width}, n)
             AS width FROM m),
s AS (SELECT vec_id, width, ('0x' || md5('{seed}:' || vec_id || ':' || k || ':s')[1:8])::BIGINT % (n - width + 1) AS start FROM w),
f AS (SELECT DISTINCT vec_id, unnest(range(start, start + width)) AS p FROM s WHERE width > 0),
x AS (SELECT vec_id, i - 1 AS i, v::DOUBLE AS v, avg(v::DOUBLE) OVER (PARTITION BY vec_id) AS mean
      FROM embeddings, unnest(embedding) WITH ORDINALITY AS t(v, i)),
o AS (SELECT x.vec_id, i, CASE WHEN f.p IS NULL THEN v ELSE {fill} END AS v, f.p IS NOT NULL AS hit
      FROM x LEFT JOIN f ON f.vec_id = x.vec_id AND f.p = {place})
SELECT vec_id, round(sum(v * (i + 1)), 6) AS checksum FROM o GROUP BY vec_id"""


def _checksum(df):
    return df.select("vec_id", F.round(F.aggregate(F.transform("embedding", lambda v, i: v * (i + 1)), F.lit(0.0),
                                                   lambda acc, x: acc + x), 6).alias("checksum"))


@register("time_mask_fill", _fill_sql(5, 2, 3, "len(embedding) // 8", "i // 8", "mean"))
def q_time_fill(spark, sf):
    """G1: two time masks on the 8 x 8 signal, filled with its mean."""
    e = T(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select("vec_id", F.floor(F.size("embedding") / 8).alias("n"))
    return _checksum(Ag.fill_masks(e, "vec_id", "embedding", Ag.mask_spans(n, "vec_id", "n", 2, 3, 5), "time", 8, "mean"))


@register("freq_mask_fill", _fill_sql(9, 2, 4, "8", "i % 8", "0.0"))
def q_freq_fill(spark, sf):
    """G1: two frequency masks on the 8 x 8 signal, filled with zero."""
    e = T(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select("vec_id", F.lit(8).cast("long").alias("n"))
    return _checksum(Ag.fill_masks(e, "vec_id", "embedding", Ag.mask_spans(n, "vec_id", "n", 2, 4, 9), "freq", 8, "zero"))


@register("writer_checks", """
SELECT lang AS file, source AS key, count(*) AS count FROM documents GROUP BY lang, source HAVING count(*) > 1""")
def q_writer_checks(spark, sf):
    """K4: duplicate (file, key) pairs reported before a keyed multi-file write."""
    d = T(spark, sf, "documents").select(F.col("lang").alias("file"), F.col("source").alias("key"))
    dups, _ = keyed_writer_checks(d, "file", "key")
    return dups


def _length_model():
    """A stand-in model: score = n_chars / 100 + words (loaded once per worker)."""
    def model(pdf: pd.DataFrame) -> pd.DataFrame:
        words = pdf["text"].str.split().str.len().fillna(0)
        return pd.DataFrame({"doc_id": pdf["doc_id"], "score": pdf["n_chars"] / 100.0 + words})
    return model


@register("batch_inference", """
SELECT doc_id, round(n_chars / 100.0 + len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')), 6)
       AS score FROM documents""")
def q_inference(spark, sf):
    """A user model applied in Arrow batches with mapInPandas; output keyed."""
    d = T(spark, sf, "documents").select("doc_id", "n_chars", "text")
    out = batch_inference(d, _length_model, "doc_id long, score double", batch_size=64)
    return out.select("doc_id", F.round("score", 6).alias("score"))


@register("speaker_mapping")
def q_mapping(spark, sf):
    """Best one-to-one system -> reference speaker map per recording (rows-only)."""
    ref, sys, _ = _frames(spark, sf)
    return G.best_speaker_mapping(ref, sys, "rec", "spk")


@register("duration_batches", """
WITH RECURSIVE s AS (
  SELECT user_id AS rec, event_id AS idx, floor(value * 1000)::BIGINT AS dur,
         row_number() OVER (PARTITION BY user_id ORDER BY floor(value * 1000), event_id) AS k,
         greatest(300000, min(floor(value * 1000)::BIGINT) OVER (PARTITION BY user_id)) AS budget FROM events),
f AS (SELECT rec, k, idx, 0 AS batch, dur AS total FROM s WHERE k = 1
      UNION ALL
      SELECT s.rec, s.k, s.idx, CASE WHEN total + s.dur < budget AND s.dur < 60000 THEN batch ELSE batch + 1 END,
             CASE WHEN total + s.dur < budget AND s.dur < 60000 THEN total + s.dur ELSE s.dur END
      FROM f JOIN s ON s.rec = f.rec AND s.k = f.k + 1)
SELECT rec, idx, batch FROM f""")
def q_duration_batches(spark, sf):
    """Duration-budget batches of a recording's segments."""
    e = events(spark, sf).select("rec", "event_id", F.floor(F.col("value") * 1000).alias("dur_ms"))
    return Bt.duration_batches(e, "rec", "event_id", "dur_ms", budget_ms=300_000, long_ms=60_000)
