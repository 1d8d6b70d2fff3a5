"""Segment / diarization queries over ``events``.

Stand-in: recording = user_id; a turn starts at the event time (seconds since
2024-01-01) and lasts value*300 s (so turns overlap); speaker = event_type;
order = (start, event_id).  Frames are 1 hour wide.  A speech segment for the
chunking operators holds value/10 s of 16 kHz samples.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusvox.operators import segments as G
from corpusvox.plans.registry import T, register

BASE = "2024-01-01 00:00:00"
SHIFT = 3600.0
TYPES = ("click", "error", "purchase", "signup", "view")

EV = f"""ev AS (
  SELECT user_id AS rec, event_id, event_type AS label, value,
         (epoch_us(ts) - epoch_us(TIMESTAMP '{BASE}')) / 1e6 AS start,
         (epoch_us(ts) - epoch_us(TIMESTAMP '{BASE}')) / 1e6 + value * 300 AS "end"
  FROM events)"""


def events(spark, sf):
    e = T(spark, sf, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) -
             F.unix_micros(F.lit(BASE).cast("timestamp"))) / 1e6
    return e.select(F.col("user_id").alias("rec"), "event_id", F.col("event_type").alias("label"), "value",
                    start.alias("start"), (start + F.col("value") * 300).alias("end"))


def _r6(*cols):
    """Round in binary on both sides (floor(x*1e6+0.5)/1e6): the inputs are the same
    IEEE doubles, so this never splits a decimal tie differently."""
    return [(F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c) for c in cols]


MERGE_SQL = """
{name}0 AS (SELECT *, lag(label) OVER w AS lp, lag("end") OVER w AS ep FROM {src}
            WINDOW w AS (PARTITION BY rec ORDER BY {order})),
{name}1 AS (SELECT *, sum(CASE WHEN lp IS NULL OR label <> lp OR start > ep THEN 1 ELSE 0 END)
                      OVER (PARTITION BY rec ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS island FROM {name}0),
{name} AS (SELECT rec, island, any_value(label) AS label, arg_min(start, ({order})) AS start,
                  arg_max("end", ({order})) AS "end", count(*) AS n FROM {name}1 GROUP BY rec, island)"""


@register("merge_turns", "WITH " + EV + "," + MERGE_SQL.format(name="m", src="ev", order="start, event_id") + """
SELECT rec, island, label, floor(start * 1e6 + 0.5) / 1e6 AS start, floor("end" * 1e6 + 0.5) / 1e6 AS "end", n FROM m""")
def q_merge(spark, sf):
    m = G.merge_turns(events(spark, sf), "rec", ["start", "event_id"])
    return m.select("rec", "island", "label", *_r6("start", "end"), "n")


SPLIT_SQL = """
{name} AS (SELECT rec, island, label, n,
                  CASE WHEN lag("end") OVER w > start + 1e-4 THEN (start + lag("end") OVER w) / 2 ELSE start END AS start,
                  CASE WHEN "end" > lead(start) OVER w + 1e-4 THEN (lead(start) OVER w + "end") / 2 ELSE "end" END AS "end"
           FROM {src} WINDOW w AS (PARTITION BY rec ORDER BY island))"""


@register("split_overlaps", "WITH " + EV + "," + MERGE_SQL.format(name="m", src="ev", order="start, event_id")
          + "," + SPLIT_SQL.format(name="s", src="m") + """
SELECT rec, island, label, floor(start * 1e6 + 0.5) / 1e6 AS start, floor("end" * 1e6 + 0.5) / 1e6 AS "end", n FROM s""")
def q_split(spark, sf):
    s = G.split_overlaps(G.merge_turns(events(spark, sf), "rec", ["start", "event_id"], mark_whole=True), "rec", ["island"])
    return s.select("rec", "island", "label", *_r6("start", "end"), "n")


RELABEL_SQL = """
f AS (SELECT rec, label, min((start, event_id)) AS first FROM ev GROUP BY rec, label),
ids AS (SELECT rec, label, (dense_rank() OVER (PARTITION BY rec ORDER BY first) - 1)::INTEGER AS new FROM f),
rl AS (SELECT ev.rec, ev.event_id, ev.start, ev."end", ids.new AS label FROM ev JOIN ids USING (rec, label))"""


@register("relabel_turns", "WITH " + EV + "," + RELABEL_SQL + " SELECT rec, event_id, label FROM rl")
def q_relabel(spark, sf):
    r = G.relabel_first_appearance(events(spark, sf), "rec", ["start", "event_id"])
    return r.select("rec", "event_id", "label")


SMOOTH_SQL = """
r0 AS (SELECT rec, island, label, start AS ustart,
              (CASE WHEN start * 100 - floor(start * 100) > 0.5 THEN floor(start * 100) + 1
                    WHEN start * 100 - floor(start * 100) < 0.5 THEN floor(start * 100)
                    ELSE floor(start * 100) + (floor(start * 100) % 2) END) / 100 AS rs,
              (CASE WHEN "end" * 100 - floor("end" * 100) > 0.5 THEN floor("end" * 100) + 1
                    WHEN "end" * 100 - floor("end" * 100) < 0.5 THEN floor("end" * 100)
                    ELSE floor("end" * 100) + (floor("end" * 100) % 2) END) / 100 AS re FROM s),
r1 AS (SELECT *, lag(re) OVER w AS re_p, lag(label) OVER w AS lab_p, lead(ustart) OVER w AS st_n, lead(label) OVER w AS lab_n
       FROM r0 WINDOW w AS (PARTITION BY rec ORDER BY island)),
r2 AS (SELECT *, (re - rs) < 1.0 AS short, lab_p IS NULL AS is_first, lab_n IS NULL AS is_last FROM r1),
r3 AS (SELECT *, short AND NOT (is_first AND is_last)
                 AND (is_last OR (NOT is_first AND (rs - re_p) <= (st_n - re))) AS take_prev FROM r2),
r4 AS (SELECT *, CASE WHEN NOT short OR (is_first AND is_last) THEN label
                      WHEN take_prev THEN NULL ELSE lab_n END AS val FROM r3),
r5 AS (SELECT rec, island AS event_id, rs AS start, re AS "end",
              last_value(val IGNORE NULLS) OVER (PARTITION BY rec ORDER BY island ROWS UNBOUNDED PRECEDING) AS label
       FROM r4)"""


@register("diarization_postprocess", "WITH " + EV + "," + RELABEL_SQL + ","
          + MERGE_SQL.format(name="m", src="rl", order="start, event_id") + "," + SPLIT_SQL.format(name="s", src="m")
          + "," + SMOOTH_SQL + "," + MERGE_SQL.format(name="z", src="r5", order="event_id") + """
SELECT rec, island, label, floor(start * 1e6 + 0.5) / 1e6 AS start, floor("end" * 1e6 + 0.5) / 1e6 AS "end", n FROM z""")
def q_diar_post(spark, sf):
    z = G.diarization_postprocess(events(spark, sf).select("rec", "event_id", "start", "end", "label"),
                                  "rec", ["start", "event_id"])
    return z.select("rec", "island", "label", *_r6("start", "end"), "n")


@register("recording_check", "WITH " + EV + """,
x AS (SELECT *, lag("end") OVER (PARTITION BY rec ORDER BY start, event_id) AS ep FROM ev)
SELECT rec, count(*) AS n_segments, count(*) FILTER (WHERE "end" < start) AS n_reversed,
       count(*) FILTER (WHERE start < ep) AS n_overlap, 0::BIGINT AS n_bad_length,
       floor(sum("end" - start) * 1e6 + 0.5) / 1e6 AS duration
FROM x GROUP BY rec""")
def q_check(spark, sf):
    c = G.recording_check(events(spark, sf), "rec", ["start", "event_id"])
    return c.select("rec", "n_segments", "n_reversed", "n_overlap", "n_bad_length", *_r6("duration"))


CLS_SQL = ", ".join(f"'{t}'" for t in TYPES)


def _cls(col):
    arr = F.array(*[F.lit(t) for t in TYPES])
    return (F.array_position(arr, F.col(col)) - 1).cast("int")


@register("forward_fill_class", "WITH " + EV + f""",
c AS (SELECT rec, event_id, start, CASE WHEN value < 1 THEN 99 ELSE list_position([{CLS_SQL}], label) - 1 END AS cls FROM ev)
SELECT rec, event_id, cls,
       coalesce(last_value(CASE WHEN cls <> 99 THEN cls END IGNORE NULLS)
                OVER (PARTITION BY rec ORDER BY start, event_id ROWS UNBOUNDED PRECEDING), 0)::INTEGER AS cls_filled
FROM c""")
def q_ffill(spark, sf):
    e = events(spark, sf).withColumn("cls", F.when(F.col("value") < 1, F.lit(99)).otherwise(_cls("label")))
    f = G.forward_fill_class(e, "rec", ["start", "event_id"], "cls", 99)
    return f.select("rec", "event_id", "cls", F.col("cls_filled").cast("int").alias("cls_filled"))


@register("collapse_runs", "WITH " + EV + """,
x AS (SELECT rec, label, lag(label) OVER (PARTITION BY rec ORDER BY start, event_id) AS lp FROM ev)
SELECT rec, count(*) AS n_events, count(*) FILTER (WHERE lp IS NULL OR lp <> label) AS n_runs FROM x GROUP BY rec""")
def q_runs(spark, sf):
    r = G.run_starts(events(spark, sf), "rec", ["start", "event_id"], "label")
    return r.groupBy("rec").agg(F.count(F.lit(1)).alias("n_events"),
                                F.count(F.when(F.col("run_start"), 1)).alias("n_runs"))


def _vad(spark, sf):
    e = events(spark, sf)
    return e.select("event_id", "start", F.floor(F.col("value") / 10 * 16000).cast("long").alias("n_samples"))


@register("sv_chunks", "WITH " + EV + """,
v AS (SELECT event_id, start, floor(value / 10 * 16000)::BIGINT AS n FROM ev),
c AS (SELECT event_id, start, n, st FROM v, unnest(range(0, n, 12000)) AS r(st)
      WHERE st = 0 OR st - 12000 + 24000 < n)
SELECT event_id, (st // 12000)::BIGINT AS chunk,
       floor((greatest(0, least(st + 24000, n) - 24000) / 16000 + start) * 1e6 + 0.5) / 1e6 AS chunk_start,
       floor((least(st + 24000, n) / 16000 + start) * 1e6 + 0.5) / 1e6 AS chunk_end,
       greatest(0, 24000 - (least(st + 24000, n) - greatest(0, least(st + 24000, n) - 24000)))::BIGINT AS pad
FROM c""")
def q_sv_chunks(spark, sf):
    c = G.sv_chunks(_vad(spark, sf), "n_samples", "start")
    return c.select("event_id", "chunk", *_r6("chunk_start", "chunk_end"), F.col("pad").cast("long").alias("pad"))


@register("fixed_chunks", "WITH " + EV + """,
v AS (SELECT event_id, floor(value / 10 * 16000)::BIGINT AS n FROM ev)
SELECT event_id, (st // 48000)::BIGINT AS chunk, least(48000, n - st)::BIGINT AS chunk_len
FROM v, unnest(range(0, n, 48000)) AS r(st) WHERE least(48000, n - st) >= 480""")
def q_fixed_chunks(spark, sf):
    c = G.fixed_chunks(_vad(spark, sf), "n_samples", chunk=48000, min_tail=480)
    return c.select("event_id", "chunk", F.col("chunk_len").cast("long").alias("chunk_len"))


SPK_SQL = "CASE label WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"


@register("assign_speakers", "WITH " + EV + ", evt AS (SELECT * FROM ev WHERE label <> 'purchase'),"
          + MERGE_SQL.format(name="m", src="evt", order="start, event_id") + f""",
turns AS (SELECT rec, island, start, "end", {SPK_SQL} AS spk FROM m),
sent AS (SELECT rec, event_id, start, "end" FROM ev WHERE label = 'purchase'),
j AS (SELECT s.rec, s.event_id, t.spk, t.island, least(s."end", t."end") - greatest(s.start, t.start) AS ov
      FROM sent s JOIN turns t ON s.rec = t.rec AND s.start < t."end" AND t.start < s."end"),
best AS (SELECT rec, event_id, spk FROM j WHERE ov > 0
         QUALIFY row_number() OVER (PARTITION BY rec, event_id ORDER BY ov DESC, island) = 1)
SELECT s.rec, s.event_id, coalesce(b.spk, 0)::INTEGER AS spk FROM sent s LEFT JOIN best b USING (rec, event_id)""")
def q_assign(spark, sf):
    e = events(spark, sf)
    turns = G.merge_turns(e.where(F.col("label") != "purchase"), "rec", ["start", "event_id"])
    spk = F.when(F.col("label") == "click", 1).when(F.col("label") == "error", 2) \
        .when(F.col("label") == "signup", 3).when(F.col("label") == "view", 4)
    turns = turns.withColumn("spk", spk.cast("int"))
    sent = e.where(F.col("label") == "purchase").select("rec", "event_id", "start", "end")
    out = G.assign_speakers(sent, turns, "rec", "event_id", "island", bin_width=86400.0)
    return out.select("rec", "event_id", F.col("spk").cast("int").alias("spk"))


FRAMES_SQL = f"""
fr_ref AS (SELECT DISTINCT rec, label AS spk, f AS frame FROM ev,
           unnest(range(round_even(start / {SHIFT}, 0)::BIGINT, round_even("end" / {SHIFT}, 0)::BIGINT)) AS r(f)),
ev_sys AS (SELECT rec, start, "end", coalesce(lag(label) OVER (PARTITION BY rec ORDER BY start, event_id), label) AS label
           FROM ev),
fr_sys AS (SELECT DISTINCT rec, label AS spk, f AS frame FROM ev_sys,
           unnest(range(round_even(start / {SHIFT}, 0)::BIGINT, round_even("end" / {SHIFT}, 0)::BIGINT)) AS r(f)),
nf AS (SELECT rec, round_even(max("end") / {SHIFT}, 0)::BIGINT AS frames FROM ev GROUP BY rec)"""


def _frames(spark, sf):
    e = events(spark, sf)
    ref = G.frame_labels(e.withColumnRenamed("label", "spk"), "rec", "spk", SHIFT)
    from corpusvox.plans.sequence import seq_lag
    s = seq_lag(e, ["rec"], ["start", "event_id"], ["label"], suffix="_prev").drop("_seq_b")
    s = s.withColumn("spk", F.coalesce("label_prev", "label"))
    sys = G.frame_labels(s, "rec", "spk", SHIFT)
    nf = e.groupBy("rec").agg(F.rint(F.max("end") / SHIFT).cast("long").alias("frames"))
    return ref, sys, nf


@register("frame_labels", "WITH " + EV + "," + FRAMES_SQL + " SELECT rec, spk, frame FROM fr_ref")
def q_frame_labels(spark, sf):
    return _frames(spark, sf)[0].select("rec", "spk", "frame")


@register("powerset_labels", "WITH " + EV + "," + FRAMES_SQL + f""",
pt AS (SELECT list_sort(list_distinct(list_concat([0],
          (SELECT list(b) FROM (SELECT (1 << a) AS b FROM range(6) t(a)
                                UNION SELECT (1 << a) | (1 << b) FROM range(6) t(a), range(6) u(b) WHERE a < b
                                UNION SELECT (1 << a) | (1 << b) | (1 << c) FROM range(6) t(a), range(6) u(b), range(6) v(c)
                                      WHERE a < b AND b < c))))) AS tbl),
bm AS (SELECT rec, frame, sum(1 << (list_position([{CLS_SQL}], spk) - 1))::BIGINT AS bitmap FROM fr_ref GROUP BY rec, frame)
SELECT rec, frame, bitmap,
       (CASE WHEN list_position(pt.tbl, bitmap) IS NOT NULL AND list_position(pt.tbl, bitmap) > 0
             THEN list_position(pt.tbl, bitmap) - 1 ELSE len(pt.tbl) END)::INTEGER AS cls
FROM bm, pt""")
def q_powerset(spark, sf):
    ref = _frames(spark, sf)[0].withColumn("spk_idx", _cls("spk"))
    return G.powerset_encode(ref, "rec", "spk_idx").select("rec", "frame", F.col("bitmap").cast("long"), "cls")


@register("diarization_error", "WITH " + EV + "," + FRAMES_SQL + """,
j AS (SELECT coalesce(r.rec, s.rec) AS rec, coalesce(r.frame, s.frame) AS frame,
             (r.spk IS NOT NULL)::INTEGER AS ri, (s.spk IS NOT NULL)::INTEGER AS si
      FROM fr_ref r FULL OUTER JOIN fr_sys s ON r.rec = s.rec AND r.frame = s.frame AND r.spk = s.spk),
per AS (SELECT rec, frame, sum(ri) AS n_ref, sum(si) AS n_sys, sum(ri * si) AS n_map FROM j GROUP BY rec, frame),
t AS (SELECT count(*) FILTER (WHERE n_ref > 0) AS speech_scored,
             count(*) FILTER (WHERE n_ref > 0 AND n_sys = 0) AS speech_miss,
             count(*) FILTER (WHERE n_ref = 0 AND n_sys > 0) AS speech_falarm,
             sum(n_ref)::BIGINT AS speaker_scored, sum(greatest(n_ref - n_sys, 0))::BIGINT AS speaker_miss,
             sum(greatest(n_sys - n_ref, 0))::BIGINT AS speaker_falarm,
             sum(least(n_ref, n_sys) - n_map)::BIGINT AS speaker_error,
             sum(n_ref + n_sys - 2 * n_map) AS mism FROM per)
SELECT speech_scored, speech_miss, speech_falarm, speaker_scored, speaker_miss, speaker_falarm, speaker_error,
       (speaker_miss + speaker_falarm + speaker_error)::BIGINT AS diarization_error,
       (SELECT sum(frames) FROM nf)::BIGINT AS frames,
       round((SELECT sum(frames) FROM nf) - mism / 5.0, 6) AS correct,
       round((speaker_miss + speaker_falarm + speaker_error) / speaker_scored, 6) AS der
FROM t""")
def q_der(spark, sf):
    ref, sys, nf = _frames(spark, sf)
    d = G.diarization_error(ref, sys, "rec", "spk", nf, n_speakers=len(TYPES))
    return d.withColumn("correct", F.round("correct", 6)).withColumn("der", F.round("der", 6))


@register("label_max_pool", "WITH " + EV + "," + FRAMES_SQL + """
SELECT DISTINCT f.rec, f.spk, f.frame // 8 AS pooled FROM fr_ref f JOIN nf USING (rec) WHERE f.frame // 8 < nf.frames // 8""")
def q_maxpool(spark, sf):
    ref, _, nf = _frames(spark, sf)
    return G.label_max_pool(ref, "rec", 8, nf).select("rec", "spk", "pooled")


@register("label_majority", "WITH " + EV + "," + FRAMES_SQL + """,
p AS (SELECT f.rec, f.spk, nf.frames, f.frame + 8 AS p FROM fr_ref f JOIN nf USING (rec)
      UNION ALL SELECT f.rec, f.spk, nf.frames, f.frame FROM fr_ref f JOIN nf USING (rec) WHERE f.frame < 8
      UNION ALL SELECT f.rec, f.spk, nf.frames, f.frame + 16 FROM fr_ref f JOIN nf USING (rec) WHERE f.frame >= nf.frames - 8),
w AS (SELECT rec, spk, k AS "window" FROM p,
      unnest(range(greatest(0, ceil((p - 16 + 1) / 4))::BIGINT,
                   least((frames + 16 - 16) // 4, p // 4)::BIGINT + 1)) AS r(k))
SELECT rec, spk, "window", count(*) AS active FROM w GROUP BY rec, spk, "window" HAVING count(*) > 8""")
def q_majority(spark, sf):
    ref, _, nf = _frames(spark, sf)
    return G.label_majority(ref, "rec", "spk", nf, win=16, hop=4).select("rec", "spk", "window", "active")
