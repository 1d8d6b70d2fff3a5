"""Streaming queries and their batch twins over ``events``.

Stand-in: session = user_id; a frame = an event in (ts, event_id) order;
p_speech = value / (value + 5), p_noise = 1 - p_speech; the last event of a
user carries the final flag.  The stream replays the table as time-ordered
files (one per trigger) through ``applyInPandasWithState``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusvox.plans.q_sentences import TOK_SQL
from corpusvox.plans.registry import T, register
from corpusvox.plans.sequence import seq_lead
from corpusvox.streaming import chunking as Ck
from corpusvox.streaming import vad as Vd
from corpusvox.streaming.runner import run_available

ORDER = ["ts", "event_id"]


def frames(spark, sf):
    e = T(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    p = F.col("value") / (F.col("value") + 5)
    e = e.withColumn("speech", Vd.speech_flag(p, 1 - p, 0.6))
    e = seq_lead(e, ["user_id"], ORDER, ["event_id"], suffix="_next").drop("_seq_b")
    return e.withColumn("final", F.col("event_id_next").isNull()).drop("event_id_next")


SCORED_SQL = "(value / (value + 5) >= (1 - value / (value + 5)) + 0.6)"
EVENT_FRAMES = f"""
fr AS (SELECT user_id::BIGINT AS session, 0::BIGINT AS part, true AS shut, {SCORED_SQL}::INTEGER AS s,
              row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f,
              count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def vad_sql(frames: str = EVENT_FRAMES, c: Vd.VadConfig = Vd.VadConfig()) -> str:
    """Frame after frame of each (session, part); ce is the end of the segment that a frame closes.

    ``frames`` ends with ``fr``: session, part, f (from 0), s (speech), n (frames of the part) and
    shut (whether the end of the part closes an open segment)."""
    empty = f"list_transform(range({c.win}), lambda x: 0::INTEGER)"
    return f"""
WITH RECURSIVE {frames},
st AS (
  SELECT DISTINCT session, part, shut, n, -1::BIGINT AS f, false AS sp, {empty} AS w,
         0::BIGINT AS beg, 0::BIGINT AS low, 0::BIGINT AS least_beg, 0::BIGINT AS seg, NULL::BIGINT AS ce FROM fr
  UNION ALL
  SELECT session, part, shut, n, f, CASE WHEN sp THEN ce IS NULL ELSE total >= {c.sil_to_speech} END,
         CASE WHEN ce IS NULL THEN w ELSE {empty} END,
         CASE WHEN NOT sp AND total >= {c.sil_to_speech} THEN greatest(least_beg, f - {c.win + c.lookback - 1}) ELSE beg END,
         CASE WHEN sp AND ce IS NULL THEN low ELSE 0 END, coalesce(ce, least_beg),
         seg + CASE WHEN ce IS NULL THEN 0 ELSE 1 END, ce
  FROM (SELECT *, CASE WHEN NOT sp THEN NULL WHEN low >= {c.max_end_sil} THEN least(f + 1, f - low + {c.lookahead + 1})
                       WHEN f + 1 - beg >= {c.max_segment} THEN f + 1 END AS ce
        FROM (SELECT * REPLACE (CASE WHEN total <= {c.speech_to_sil} THEN low + 1 ELSE 0 END AS low)
              FROM (SELECT *, list_sum(w) AS total
                    FROM (SELECT st.session, st.part, st.shut, st.n, fr.f, st.sp, list_concat(st.w[2:], [fr.s]) AS w, st.beg,
                                 st.low, st.least_beg, st.seg
                          FROM st JOIN fr ON fr.session = st.session AND fr.part = st.part AND fr.f = st.f + 1))))),
done AS (SELECT session, part, seg - 1 AS seg, beg, ce FROM st WHERE ce IS NOT NULL
         UNION ALL SELECT session, part, seg, beg, CASE WHEN shut THEN n END FROM st WHERE f = n - 1 AND sp)
SELECT session, part, seg, beg * {c.frame_ms} AS beg_ms, ce * {c.frame_ms} AS end_ms FROM done"""


VAD_SQL = f"SELECT session, seg, beg_ms, end_ms FROM ({vad_sql()})"


@register("vad_segments", VAD_SQL)
def q_vad_batch(spark, sf):
    """ST1 batch twin: a sequential fold per session."""
    return Vd.segments_batch(frames(spark, sf), "user_id", ORDER, "speech")


@register("vad_segments_stream", VAD_SQL)
def q_vad_stream(spark, sf):
    """ST1/ST2/ST8 in Structured Streaming; equal to the batch twin (tested)."""
    return run_available(spark, frames(spark, sf), "ts",
                         lambda s: Vd.segments_stream(s, "user_id", ORDER, "speech", "final"))


#: A visit ends when no event comes for a day; segments of a few events.
VISIT_MS = 24 * 3600 * 1000
SHORT = Vd.VadConfig(win=4, sil_to_speech=2, speech_to_sil=1, lookback=1, max_end_sil=2, lookahead=1, max_segment=12)
VISIT_FRAMES = f"""
gaps AS (SELECT *, coalesce(ms - lag(ms) OVER o > {VISIT_MS}, true) AS fresh
         FROM (SELECT *, epoch_us(ts) // 1000 AS ms FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
visits AS (SELECT *, max(CASE WHEN fresh THEN ms END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS part FROM gaps),
fr AS (SELECT user_id::BIGINT AS session, part, {SCORED_SQL}::INTEGER AS s,
              part < max(part) OVER (PARTITION BY user_id) OR
              max(ms) OVER (PARTITION BY user_id, part) + {VISIT_MS} <= max(ms) OVER () AS shut,
              row_number() OVER (PARTITION BY user_id, part ORDER BY ts, event_id) - 1 AS f,
              count(*) OVER (PARTITION BY user_id, part) AS n FROM visits)"""


@register("vad_visits_stream",
          f"SELECT session, part AS began_ms, seg, beg_ms, end_ms FROM ({vad_sql(VISIT_FRAMES, SHORT)})")
def q_vad_visits(spark, sf):
    """ST2/ST8: sessions without a final flag are closed by their timers; what is open stays [beg, NULL]."""
    from corpusvox.streaming import sessions as Se
    Se.use_rocksdb(spark)
    source = frames(spark, sf).drop("final")
    out = run_available(spark, source, "ts", lambda s: Se.sessions_stream(
        s, "user_id", ORDER, "speech", "ts", VISIT_MS, SHORT))
    return Se.final_segments(out)


NOISE_SQL = f"""
x AS (SELECT user_id::BIGINT AS session, event_id, {SCORED_SQL} AS sp, 10 * log10(value * value + 1e-6) AS db,
             row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS f,
             count(*) OVER (PARTITION BY user_id) AS n FROM events),
lv AS (SELECT session, event_id, f, n, sp, db, -100.0::DOUBLE AS before,
              CASE WHEN NOT sp AND db >= -20 THEN db ELSE -100.0 END AS after FROM x WHERE f = 0
       UNION ALL
       SELECT x.session, x.event_id, x.f, x.n, x.sp, x.db, lv.after,
              CASE WHEN x.sp OR x.db < -20 THEN lv.after WHEN lv.after < -99.9 THEN x.db
                   ELSE (x.db + lv.after * 19) / 20 END
       FROM lv JOIN x ON x.session = lv.session AND x.f = lv.f + 1),
gt AS (SELECT *, sp AND db >= -20 AND db - before >= 12 AS ok FROM lv)"""


def gated_frames(spark, sf):
    """Frames with their energy (F12), the noise level before them and the gate."""
    from corpusvox.functions.vectors import frame_energy_db
    from corpusvox.streaming.noise import noise_gate
    e = frames(spark, sf).withColumn("db", F.get(frame_energy_db(F.array("value"), 1, 1), F.lit(0)))
    return noise_gate(e, "user_id", ORDER, "speech", "db", n=20, snr_thres=12.0, decibel_thres=-20.0)


@register("noise_gate", f"""
WITH RECURSIVE {NOISE_SQL}
SELECT session, event_id, round(before, 6) AS noise_level, ok AS gated FROM gt""")
def q_noise_gate(spark, sf):
    """Noise level and gate of every frame, by a scan of affine maps."""
    return gated_frames(spark, sf).select(F.col("user_id").cast("long").alias("session"), "event_id",
                                          F.round("noise_level", 6).alias("noise_level"), "gated")


@register("vad_segments_gated", "SELECT session, seg, beg_ms, end_ms FROM (" + vad_sql(
    NOISE_SQL + ",\nfr AS (SELECT session, 0::BIGINT AS part, true AS shut, ok::INTEGER AS s, f, n FROM gt)", SHORT) + ")")
def q_vad_gated(spark, sf):
    """ST1 with the gate of W12 before the state machine."""
    return Vd.segments_batch(gated_frames(spark, sf), "user_id", ORDER, "gated", SHORT)


RECHUNK_SQL = """
x AS (SELECT user_id AS session, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i
      FROM events)
SELECT session, {chunk} AS chunk, count(*) AS n_items, round(sum(value), 6) AS total FROM x GROUP BY 1, 2"""


def _rechunk(spark, sf, lead, steady):
    r = Ck.rechunk_batch(frames(spark, sf), "user_id", ORDER, "value", lead, steady)
    return r.withColumn("total", F.round("total", 6))


SEVENS_SQL = "WITH " + RECHUNK_SQL.format(chunk="(i // 7)::BIGINT")


@register("rechunk", SEVENS_SQL)
def q_rechunk(spark, sf):
    """ST3 batch twin: fixed 7-item chunks, short tail kept."""
    return _rechunk(spark, sf, (), 7)


@register("rechunk_stream", SEVENS_SQL)
def q_rechunk_stream(spark, sf):
    """ST3 in Structured Streaming with the remainder carried in state."""
    out = run_available(spark, frames(spark, sf), "ts",
                        lambda s: Ck.rechunk_stream(s, "user_id", ORDER, "value", "final", (), 7))
    return out.withColumn("total", F.round("total", 6))


@register("token_schedule", "WITH " + RECHUNK_SQL.format(
    chunk="(CASE WHEN i < 15 THEN 0 WHEN i < 39 THEN 1 ELSE 2 + (i - 39) // 48 END)::BIGINT"))
def q_schedule(spark, sf):
    """ST6 batch twin: growing chunk schedule 15 -> 24 -> 48."""
    return _rechunk(spark, sf, (15, 24), 48)


def _chunks(spark, sf):
    """Chunk stream stand-in: stream = embedding label, chunk = vec_id, samples = the 64 values."""
    e = T(spark, sf, "embeddings").select(F.col("label").cast("long").alias("stream"), F.col("vec_id").alias("chunk"),
                                          "embedding")
    e = seq_lead(e, ["stream"], ["chunk"], ["chunk"], suffix="_next").drop("_seq_b")
    return e.withColumn("final", F.col("chunk_next").isNull()).drop("chunk_next")


def _xf_summary(df):
    return df.select("stream", "chunk", F.size("out").alias("n_out"),
                     F.round(F.aggregate(F.transform("out", lambda v, i: v * (i + 1)), F.lit(0.0),
                                         lambda a, x: a + x), 6).alias("checksum"))


XF_SQL = """
WITH h AS (SELECT list_transform(range(16), lambda i: 0.54 - 0.46 * cos(2 * pi() * i / 15)) AS w),
c AS (SELECT label::BIGINT AS stream, vec_id AS chunk, list_transform(embedding, lambda v: v::DOUBLE) AS x,
             lag(embedding[-8:]) OVER (PARTITION BY label ORDER BY vec_id) AS tail,
             lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) IS NULL AS last FROM embeddings),
f AS (SELECT stream, chunk, last,
             CASE WHEN tail IS NULL THEN x
                  ELSE list_transform(x, lambda v, i: CASE WHEN i <= 8 THEN v * w[i] + tail[i]::DOUBLE * w[8 + i] ELSE v END)
             END AS faded FROM c, h),
o AS (SELECT stream, chunk, CASE WHEN last THEN faded ELSE faded[1:len(faded) - 8] END AS out FROM f)
SELECT stream, chunk, len(out)::INTEGER AS n_out,
       round(coalesce(list_sum(list_transform(out, lambda v, i: v * i)), 0.0), 6) AS checksum FROM o"""


@register("crossfade", XF_SQL)
def q_crossfade(spark, sf):
    """ST7 batch twin: Hamming cross-fade of consecutive chunks, overlap 8."""
    from corpusvox.streaming.crossfade import crossfade_batch
    return _xf_summary(crossfade_batch(_chunks(spark, sf), "stream", ["chunk"], "embedding", 8))


@register("crossfade_stream", XF_SQL)
def q_crossfade_stream(spark, sf):
    """ST7 in Structured Streaming (faded tail in state); equal to the batch twin (tested)."""
    from corpusvox.streaming.crossfade import crossfade_stream
    src = _chunks(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("chunk")))
    out = run_available(spark, src, "ts",
                        lambda s: crossfade_stream(s, "stream", "chunk", "embedding", "final", 8))
    return _xf_summary(out)


def _frames_long(spark, sf):
    """Long-form frames: utt = vec_id, t = position, x = the value (64 frames per utterance)."""
    e = T(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("t", "x"))
    return e.select(F.col("vec_id").alias("utt"), F.col("t").cast("long").alias("t"), F.col("x").cast("double"),
                    (F.col("t") == 63).alias("final"))


def _lfr_summary(df):
    return df.select("utt", "i", F.size("stacked").alias("n"),
                     F.round(F.aggregate(F.transform("stacked", lambda v, j: v * (j + 1)), F.lit(0.0),
                                         lambda a, x: a + x), 6).alias("checksum"))


LFR_SQL = """
WITH v AS (SELECT vec_id, embedding AS e, len(embedding) AS t FROM embeddings)
SELECT vec_id AS utt, i::BIGINT AS i, 7 AS n,
       round(sum((j + 1) * e[least(greatest(i * 6 + j - 3, 0), t - 1) + 1]::DOUBLE), 6) AS checksum
FROM v, unnest(range(0, CAST(ceil(t / 6) AS BIGINT))) AS r(i), unnest(range(0, 7)) AS q(j) GROUP BY vec_id, i"""


@register("lfr_online", LFR_SQL)
def q_lfr_online(spark, sf):
    """W7 over long-form frames (ST4 batch twin): each frame is sent to the stacked
    outputs that read it; groups hold 7 values."""
    from corpusvox.streaming.lfr import lfr_long
    return _lfr_summary(lfr_long(_frames_long(spark, sf), "utt", "t", "x", 7, 6))


@register("lfr_online_stream", LFR_SQL)
def q_lfr_stream(spark, sf):
    """ST4 in Structured Streaming: frames arrive in time slices; equal to the batch twin (tested)."""
    from corpusvox.streaming.lfr import lfr_stream
    src = _frames_long(spark, sf).withColumn("ts", F.timestamp_seconds(F.col("t")))
    out = run_available(spark, src, "ts", lambda s: lfr_stream(s, "utt", "t", "x", "final", 7, 6))
    return _lfr_summary(out)


def _words(spark, sf):
    """Word stream stand-in: conversation words in (turn, position) order with punctuation ids."""
    from corpusvox.plans.q_sentences import conv_tokens
    w = conv_tokens(spark, sf).select(F.col("conv_id").alias("session"), "k", "token", "punc")
    last = w.groupBy("session").agg(F.max("k").alias("_last"))
    return w.join(last, "session").withColumn("final", F.col("k") == F.col("_last")).drop("_last") \
        .withColumn("ts", F.timestamp_seconds(F.col("k")))


# Mini-batch after mini-batch of each conversation: (cw, cp) is carried on, (ew, ep) is written out.
CARRY_SQL = "WITH RECURSIVE " + TOK_SQL + """,
mb AS (SELECT conv_id AS session, (k - 1) // 20 AS i, list(token ORDER BY k) AS w, list(punc ORDER BY k) AS p,
              (k - 1) // 20 = max((k - 1) // 20) OVER (PARTITION BY conv_id) AS last FROM k GROUP BY conv_id, (k - 1) // 20),
f AS (
  SELECT session, -1::BIGINT AS i, []::VARCHAR[] AS cw, []::INTEGER[] AS cp, []::VARCHAR[] AS ew, []::INTEGER[] AS ep,
         ''::VARCHAR AS before, ''::VARCHAR AS after, -1::BIGINT AS seq, false AS last FROM mb WHERE i = 0
  UNION ALL
  SELECT session, i, bw[cut + 1:], bp[cut + 1:], bw[:cut],
         CASE WHEN by_comma THEN list_concat(bp[:cut - 1], [3::INTEGER]) ELSE bp[:cut] END,
         after, CASE WHEN cut > 0 THEN bw[cut][-1:] ELSE after END, seq + CASE WHEN cut > 0 THEN 1 ELSE 0 END, last
  FROM (SELECT *, CASE WHEN last THEN len(bw) WHEN stop > 0 THEN stop WHEN len(bw) > 200 THEN comma ELSE 0 END AS cut,
               NOT last AND stop = 0 AND len(bw) > 200 AND comma > 0 AS by_comma
        FROM (SELECT *, coalesce(list_max(list_filter(range(3, len(bw)), lambda x: bp[x] IN (3, 4))), 0) AS stop,
                     coalesce(list_max(list_filter(range(3, len(bw)), lambda x: bp[x] = 2)), 0) AS comma
              FROM (SELECT f.session, mb.i, list_concat(f.cw, mb.w) AS bw, list_concat(f.cp, mb.p) AS bp, f.after, f.seq,
                           mb.last FROM f JOIN mb ON mb.session = f.session AND mb.i = f.i + 1)))),
j AS (SELECT *, list_transform(range(1, len(ew) + 1), lambda x: CASE WHEN x = 1 THEN before ELSE ew[x - 1][-1:] END) AS pr
      FROM f WHERE len(ew) > 0)
SELECT session, seq, len(ew)::BIGINT AS n_words, array_to_string(list_transform(range(1, len(ew) + 1), lambda x:
         CASE WHEN pr[x] <> '' AND ascii(pr[x]) < 128 AND ascii(ew[x]) < 128 THEN ' ' ELSE '' END || ew[x] ||
         CASE WHEN last AND x = len(ew) THEN '' WHEN ep[x] = 2 THEN '，' WHEN ep[x] = 3 THEN '。' WHEN ep[x] = 4 THEN '？'
              WHEN ep[x] = 5 THEN '、' ELSE '' END), '') AS text FROM j"""


@register("punctuation_carry", CARRY_SQL)
def q_punct_batch(spark, sf):
    """W15 batch twin: mini-batches of 20 words, text after the last sentence end carried."""
    from corpusvox.streaming.punctuation import carry_batch
    return carry_batch(_words(spark, sf), "session", ["k"], "token", "punc")


@register("punctuation_carry_stream", CARRY_SQL)
def q_punct_stream(spark, sf):
    """ST5: the same carry with the pending words in streaming state; equal to the batch twin (tested)."""
    from corpusvox.streaming.punctuation import carry_stream
    return run_available(spark, _words(spark, sf), "ts",
                         lambda s: carry_stream(s, "session", ["k"], "token", "punc", "final"))
