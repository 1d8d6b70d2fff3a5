"""Smaller operators wired to the tables: integrate-and-fire, data-quality
predicates, mini-sentences, frame energy, field slices, top-k hotwords,
token-weighted loss."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusvox.functions import text as X
from corpusvox.functions import vectors as Vf
from corpusvox.operators import manifest as Mn
from corpusvox.operators import scoring as S
from corpusvox.operators import segments as G
from corpusvox.plans.registry import T, register

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


@register("cif_boundaries", """
SELECT user_id AS rec, event_id,
       (floor(s / 50000) - floor((s - w) / 50000))::BIGINT AS fires, floor(s / 50000)::BIGINT AS n_tokens
FROM (SELECT user_id, event_id, round(value * 100)::BIGINT AS w,
             sum(round(value * 100)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                                   ROWS UNBOUNDED PRECEDING) AS s FROM events)""")
def q_cif(spark, sf):
    """weights = value in hundredths, threshold 500.00."""
    e = T(spark, sf, "events").select(F.col("user_id").alias("rec"), "event_id", "ts",
                                      F.round(F.col("value") * 100).cast("long").alias("w"))
    return G.cif_fire(e, "rec", ["ts", "event_id"], "w", 50000).select("rec", "event_id", "fires", "n_tokens")


@register("cif_heavy", """
WITH RECURSIVE e AS (SELECT user_id AS rec, event_id, round(value * 100)::BIGINT AS w,
                            row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events),
c AS (SELECT rec, event_id, f, (w >= 16000)::BIGINT AS fires, w - 16000 * (w >= 16000)::BIGINT AS "left" FROM e WHERE f = 1
      UNION ALL
      SELECT e.rec, e.event_id, e.f, (c."left" + w >= 16000)::BIGINT, c."left" + w - 16000 * (c."left" + w >= 16000)::BIGINT
      FROM c JOIN e ON e.rec = c.rec AND e.f = c.f + 1)
SELECT rec, event_id, fires, "left" FROM c""")
def q_cif_heavy(spark, sf):
    """W16 with weights of up to three thresholds: what is left over fires on later frames."""
    e = T(spark, sf, "events").select(F.col("user_id").alias("rec"), "event_id", "ts",
                                      F.round(F.col("value") * 100).cast("long").alias("w"))
    return G.cif_fire(e, "rec", ["ts", "event_id"], "w", 16000).select("rec", "event_id", "fires", "left")


@register("quality_flags", f"""
WITH d AS (SELECT doc_id, n_chars, len({WORDS}) AS n FROM documents)
SELECT doc_id,
       n > 5000 AS too_long,
       least(n_chars // 2, n)::BIGINT AS aligned_tokens,
       abs(n - 25 * round(n_chars / 16000.0, 2)) <= 2 AS token_rate_ok,
       (CASE WHEN n_chars % 3 = 0 THEN 16000 ELSE 8000 END) = 16000
         OR (CASE WHEN n_chars % 3 = 0 THEN 16000 ELSE 8000 END) >= 16000 AS rate_ok
FROM d""")
def q_quality(spark, sf):
    """P2 (sample rate), P3 (max length drop flag), P7 (alignment truncation length),
    P13 (token-rate rule); stand-ins: samples = n_chars, tokens = words,
    rate = 16000 when n_chars % 3 == 0 else 8000."""
    d = T(spark, sf, "documents").select("doc_id", "n_chars", F.size(X.word_tokens("text")).alias("n"))
    rate = F.when(F.col("n_chars") % 3 == 0, 16000).otherwise(8000)
    return d.select("doc_id", (F.col("n") > 5000).alias("too_long"),
                    F.least(F.floor(F.col("n_chars") / 2), F.col("n")).cast("long").alias("aligned_tokens"),
                    Mn.token_rate_ok(F.col("n"), F.col("n_chars")).alias("token_rate_ok"),
                    ((rate == 16000) | (rate >= 16000)).alias("rate_ok"))


RATE = "(CASE doc_id % 3 WHEN 0 THEN 16000 WHEN 1 THEN 8000 ELSE 44100 END)"


def _rate():
    return F.when(F.col("doc_id") % 3 == 0, 16000).when(F.col("doc_id") % 3 == 1, 8000).otherwise(44100)


@register("rate_filter", f"SELECT doc_id, {RATE} AS rate FROM documents WHERE {RATE} <> 8000")
def q_rate_filter(spark, sf):
    """Rows at the target rate or at 16 kHz and more stay (the rate is made of the id)."""
    d = T(spark, sf, "documents").select("doc_id", _rate().alias("rate"))
    return Mn.keep_sample_rates(d, "rate", 16000)


@register("length_drop", f"SELECT doc_id, len({WORDS})::INTEGER AS n FROM documents WHERE len({WORDS}) <= 1500")
def q_length_drop(spark, sf):
    """Documents of more than 1500 words are dropped before batching."""
    return Mn.drop_long(T(spark, sf, "documents").select("doc_id", F.size(X.word_tokens("text")).alias("n")), "n", 1500)


@register("frame_alignment", f"""
WITH d AS (SELECT doc_id, {WORDS} AS w, string_split(text, chr(10)) AS l FROM documents),
n AS (SELECT *, least(len(w) // 40, len(l)) AS n FROM d)
SELECT doc_id, (n * 40)::INTEGER AS n_frames, n::INTEGER AS n_tokens,
       w[greatest(n * 40, 1)] AS last_frame, l[greatest(n, 1)] AS last_token FROM n WHERE n > 0""")
def q_frame_alignment(spark, sf):
    """Words stand for frames, lines for tokens, 40 frames a token; both are cut to fit."""
    d = T(spark, sf, "documents").select("doc_id", X.word_tokens("text").alias("f"), F.split("text", "\n").alias("t"))
    x = Mn.align_frames(d, "f", "t", 40).where(F.size("t") > 0)
    return x.select("doc_id", F.size("f").alias("n_frames"), F.size("t").alias("n_tokens"),
                    F.element_at("f", -1).alias("last_frame"), F.element_at("t", -1).alias("last_token"))


@register("token_rate", f"""
SELECT doc_id, abs(len({WORDS}) - 25 * round(n_chars / 800.0, 2)) <= 20 AS ok FROM documents""")
def q_token_rate(spark, sf):
    """Words against 25 for each second of 800 characters, within 20."""
    d = T(spark, sf, "documents").select("doc_id", "n_chars", F.size(X.word_tokens("text")).alias("n"))
    return d.select("doc_id", Mn.token_rate_ok(F.col("n"), F.col("n_chars"), 800, slack=20).alias("ok"))


@register("mini_sentences", f"""
WITH d AS (SELECT doc_id, len({WORDS}) AS n FROM documents)
SELECT doc_id, ((n + 19) // 20)::BIGINT AS n_batches,
       (CASE WHEN n % 20 = 0 THEN 20 ELSE n % 20 END)::BIGINT AS last_size FROM d WHERE n > 0""")
def q_mini(spark, sf):
    """Words in batches of 20, remainder kept (counted per document)."""
    d = T(spark, sf, "documents").select("doc_id", X.word_tokens("text").alias("w")).where(F.size("w") > 0)
    batches = F.transform(F.sequence(F.lit(1), F.size("w"), F.lit(20)), lambda at: F.slice("w", at, F.lit(20)))
    x = d.select("doc_id", F.posexplode(batches).alias("b", "words")) \
        .groupBy("doc_id", "b").agg(F.sum(F.size("words")).alias("sz"))
    return x.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_batches"), F.max_by("sz", "b").alias("last_size"))


@register("frame_energy", """
WITH v AS (SELECT vec_id, embedding AS e FROM embeddings),
f AS (SELECT vec_id, i, 10 * log10(sum(e[i * 4 + k + 1]::DOUBLE * e[i * 4 + k + 1]::DOUBLE) + 1e-6) AS db
      FROM v, unnest(range(0, (len(e) - 8) // 4 + 1)) AS r(i), unnest(range(0, 8)) AS q(k) GROUP BY vec_id, i)
SELECT vec_id, count(*)::INTEGER AS n_frames, round(max(db), 6) AS max_db, round(min(db), 6) AS min_db
FROM f GROUP BY vec_id""")
def q_energy(spark, sf):
    """F12 on the embedding read as a 64-sample signal: frames of 8 every 4."""
    e = T(spark, sf, "embeddings").select("vec_id", Vf.frame_energy_db("embedding", 8, 4).alias("db"))
    return e.select("vec_id", F.size("db").alias("n_frames"), F.round(F.array_max("db"), 6).alias("max_db"),
                    F.round(F.array_min("db"), 6).alias("min_db"))


@register("field_slice", f"""
SELECT conv_id, turn, array_to_string({WORDS}[2:4], ' ') AS f24, array_to_string({WORDS}[3:], ' ') AS f3_
FROM conversations""")
def q_field_slice(spark, sf):
    """fields '2-4' and '3-' of each line."""
    c = T(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.array_join(X.field_slice("text", "2-4"), " ").alias("f24"),
                    F.array_join(X.field_slice("text", "3-"), " ").alias("f3_"))


@register("hotword_topk", f"""
WITH w AS (SELECT conv_id, t.word FROM conversations, unnest({WORDS}) AS t(word)),
c AS (SELECT conv_id, word, count(*) AS score FROM w GROUP BY conv_id, word),
r AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, word) AS rank FROM c)
SELECT conv_id, word, rank FROM r WHERE rank <= 3
UNION ALL SELECT DISTINCT conv_id, '<s>', 4 FROM conversations""")
def q_hotwords(spark, sf):
    """T5: top-3 hotwords per session by summed score (here: word frequency), the
    sentinel '<s>' always kept."""
    c = T(spark, sf, "conversations")
    w = c.select("conv_id", F.explode(X.word_tokens("text")).alias("word")) \
        .groupBy("conv_id", "word").agg(F.count(F.lit(1)).alias("score"))
    top = w.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "word"))) \
        .where("rank <= 3").select("conv_id", "word", F.col("rank").cast("long").alias("rank"))
    sentinel = c.select("conv_id").distinct().select("conv_id", F.lit("<s>").alias("word"),
                                                     F.lit(4).cast("long").alias("rank"))
    return top.unionByName(sentinel)


@register("weighted_loss", """
SELECT source, round(sum(ln(n_chars) * n_chars) / sum(n_chars), 6) AS mean_nll,
       round(exp(sum(ln(n_chars) * n_chars) / sum(n_chars)), 6) AS ppl,
       round(sum(n_chars / 1000.0) / sum(n_chars / 16000.0), 6) AS rtf
FROM documents GROUP BY source""")
def q_weighted_loss(spark, sf):
    """A26/A18 token-weighted mean (and its exp) and A17 ratio of sums, per source."""
    d = T(spark, sf, "documents").select("source", F.log(F.col("n_chars").cast("double")).alias("nll"),
                                         F.col("n_chars").alias("n"))
    g = d.groupBy("source").agg(S.weighted_mean("nll", "n").alias("m"),
                                S.ratio_of_sums(F.col("n") / 1000.0, F.col("n") / 16000.0).alias("rtf"))
    return g.select("source", F.round("m", 6).alias("mean_nll"), F.round(F.exp("m"), 6).alias("ppl"),
                    F.round("rtf", 6).alias("rtf"))


@register("clean_tokens", f"""
SELECT doc_id, len(list_filter({WORDS}, lambda x: x NOT IN ('<s>', '</s>', '<unk>', '<OOV>')))::INTEGER AS n_clean
FROM documents""")
def q_clean_tokens(spark, sf):
    """Special symbols removed from each token sequence."""
    d = T(spark, sf, "documents")
    return d.select("doc_id", F.size(X.drop_symbols(X.word_tokens("text"))).alias("n_clean"))


@register("mean_pooling", """
SELECT vec_id, round(avg(x::DOUBLE), 6) AS pooled FROM embeddings, unnest(embedding) AS t(x) GROUP BY vec_id""")
def q_mean_pool(spark, sf):
    """Mean over frames (each embedding read as 64 one-dim frames)."""
    e = T(spark, sf, "embeddings")
    return e.select("vec_id", F.round(F.element_at(Vf.frame_mean(Vf.frames_of("embedding")), 1), 6).alias("pooled"))


@register("chunk_context", """
SELECT vec_id, i::INTEGER AS idx, least(i * 16, 4)::INTEGER AS lo,
       (least(len(embedding), (i + 1) * 16 + 4) - greatest(i * 16 - 4, 0))::INTEGER AS n_items,
       embedding[greatest(i * 16 - 4, 0) + 1]::DOUBLE AS first_item,
       embedding[least(len(embedding), (i + 1) * 16 + 4)]::DOUBLE AS last_item, true AS stitched_equal
FROM embeddings, unnest(range(0, CAST(ceil(len(embedding) / 16) AS BIGINT))) AS r(i)""")
def q_chunk_context(spark, sf):
    """Split into 16-item chunks with 4 items of context each side, stitch back."""
    e = T(spark, sf, "embeddings").select("vec_id", Vf.split_chunks("embedding", 16, 4, 4).alias("c"), "embedding")
    same = (Vf.stitch_chunks(F.col("c"), 16) == F.col("embedding")).alias("stitched_equal")
    x = e.select("vec_id", same, F.explode("c").alias("x"))
    return x.select("vec_id", "x.idx", "x.lo", F.size("x.items").alias("n_items"),
                    F.element_at("x.items", 1).cast("double").alias("first_item"),
                    F.element_at("x.items", -1).cast("double").alias("last_item"), "stitched_equal")


@register("pad_clip", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e,
                  ('0x' || md5('9:' || vec_id::VARCHAR)[1:8])::BIGINT % (len(embedding) - 32 + 1) AS st
           FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_concat(e, list_transform(range(16), lambda i: 0.0)),
                                             lambda x, i: x * i)), 6) AS padded_sum,
       round(list_sum(list_transform(e[st + 1:st + 32], lambda x, i: x * i)), 6) AS clip_sum FROM v""")
def q_pad_clip(spark, sf):
    """F8: pad-or-trim to 80 items; clip to 32 items at a seeded start."""
    from corpusvox.operators.augment import draw
    e = T(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    start = F.pmod(draw(9, F.col("vec_id")), F.size("e") - 32 + 1)
    chk = lambda a: F.round(F.aggregate(F.transform(a, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x), 6)
    return e.select("vec_id", chk(Vf.pad_or_trim(F.col("e"), 80, 0.0)).alias("padded_sum"),
                    chk(Vf.clip_at(F.col("e"), 32, start)).alias("clip_sum"))


@register("trim_silence", """
WITH f AS (SELECT vec_id, i, 10 * log10(sum(embedding[i * 4 + k + 1]::DOUBLE * embedding[i * 4 + k + 1]::DOUBLE) + 1e-6) AS db
           FROM embeddings, unnest(range(0, (len(embedding) - 8) // 4 + 1)) AS r(i), unnest(range(0, 8)) AS q(k)
           GROUP BY vec_id, i),
p AS (SELECT vec_id, max(db) AS pk, count(*) AS n FROM f GROUP BY vec_id)
SELECT f.vec_id, greatest(0, min(i) - 1)::INTEGER AS first, least(any_value(n) - 1, max(i) + 2)::INTEGER AS last
FROM f JOIN p USING (vec_id) WHERE f.db > p.pk - 3 GROUP BY f.vec_id""")
def q_trim(spark, sf):
    """F24 on F12 energies: frames within 3 dB of the peak, keep 1 frame left and 2 right."""
    e = T(spark, sf, "embeddings").select("vec_id", Vf.frame_energy_db("embedding", 8, 4).alias("db"))
    b = e.select("vec_id", Vf.trim_silence_bounds("db", 3.0, 1, 2).alias("b"))
    return b.select("vec_id", F.col("b.first").cast("int").alias("first"), F.col("b.last").cast("int").alias("last"))


@register("token_timestamps", """
WITH e AS (SELECT user_id AS rec, event_type, round(value * 100)::BIGINT AS w,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame
           FROM events),
c AS (SELECT *, sum(w) OVER (PARTITION BY rec ORDER BY frame ROWS UNBOUNDED PRECEDING) AS s FROM e),
fires AS (SELECT rec, frame, event_type AS token, row_number() OVER (PARTITION BY rec ORDER BY frame) - 1 AS k
          FROM c WHERE floor(s / 50000) > floor((s - w) / 50000)),
nf AS (SELECT rec, count(*) AS nf FROM e GROUP BY rec),
f AS (SELECT fires.*, frame - 1.5 AS f, lead(frame - 1.5) OVER (PARTITION BY rec ORDER BY k) AS fn,
             max(k) OVER (PARTITION BY rec) AS last_k FROM fires)
SELECT f.rec, k, token, (f * (10.0 * 6 / 1000 / 3) * 1000)::BIGINT AS beg_ms,
       (CASE WHEN k = last_k - 1 AND fn - f <= 12
             THEN CASE WHEN nf.nf - fn > 5 THEN (nf.nf + fn) * 0.5 ELSE nf.nf::DOUBLE END
             WHEN fn - f <= 12 THEN fn ELSE f + 12 END * (10.0 * 6 / 1000 / 3) * 1000)::BIGINT AS end_ms
FROM f JOIN nf USING (rec) WHERE k < last_k""")
def q_token_ts(spark, sf):
    """W17 on integrate-and-fire peaks over events (frame = event index, token = event type)."""
    from corpusvox.plans.sequence import seq_row_number
    e = T(spark, sf, "events").select(F.col("user_id").alias("rec"), "event_id", "ts", "event_type",
                                      F.round(F.col("value") * 100).cast("long").alias("w"))
    e = seq_row_number(e, ["rec"], ["ts", "event_id"], "frame").withColumn("frame", F.col("frame") - 1)
    fired = G.cif_fire(e, "rec", ["frame"], "w", 50000).where(F.col("fires") > 0)
    fires = seq_row_number(fired.select("rec", "frame", F.col("event_type").alias("token")), ["rec"], ["frame"], "k") \
        .drop("_seq_b").withColumn("k", F.col("k") - 1)
    lengths = e.groupBy("rec").agg(F.count(F.lit(1)).alias("num_frames"))
    return G.token_timestamps(fires, lengths, "rec").select("rec", "k", "token", "beg_ms", "end_ms")


@register("timestamp_segments", """
WITH t AS (SELECT l_orderkey AS rec, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
                  l_partkey AS tok, l_partkey >= 1500 AS ts FROM lineitem),
b AS (SELECT *, coalesce(ts AND lag(ts) OVER (PARTITION BY rec ORDER BY pos), false)::INTEGER AS bnd FROM t),
s AS (SELECT *, sum(bnd) OVER (PARTITION BY rec ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seg,
             max(bnd) OVER (PARTITION BY rec) AS pairs FROM b),
ls AS (SELECT rec, max(seg) AS last_seg FROM s WHERE pairs = 1 GROUP BY rec),
p AS (SELECT s.rec, seg::BIGINT AS seg, arg_min(tok, pos) AS f, arg_max(tok, pos) AS l, count(*) AS n
      FROM s JOIN ls USING (rec) WHERE pairs = 1 AND seg < last_seg GROUP BY s.rec, seg),
o AS (SELECT rec, arg_max(CASE WHEN ts THEN tok END, CASE WHEN ts THEN pos END) AS lt, count(*) AS n FROM s
      WHERE pairs = 0 GROUP BY rec)
SELECT rec, seg, round((f - 1500) * 0.02::DOUBLE, 6) AS start, round((l - 1500) * 0.02::DOUBLE, 6) AS "end", n - 2 AS n_text FROM p
UNION ALL
SELECT rec, 0, 0.0::DOUBLE, CASE WHEN lt <> 1500 THEN round((lt - 1500) * 0.02::DOUBLE, 6) END, n FROM o""")
def q_ts_segments(spark, sf):
    """W19 stand-in: per order, part keys in line order; keys >= 1500 are timestamp tokens."""
    from corpusvox.plans.sequence import seq_row_number
    li = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rec"), "l_linenumber", "l_partkey", "l_suppkey")
    li = seq_row_number(li, ["rec"], ["l_linenumber", "l_partkey", "l_suppkey"], "pos")
    s = G.timestamp_segments(li.select("rec", "pos", F.col("l_partkey").alias("tok"), "_seq_b"), "rec", "pos", "tok", 1500)
    return s.select("rec", "seg", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n_text")


@register("end_detect", """
WITH h AS (SELECT l_orderkey AS utt, l_linenumber AS len, -l_extendedprice / 1000 AS score FROM lineitem),
b AS (SELECT utt, max(score) AS best, max(len) AS i FROM h GROUP BY utt),
l AS (SELECT utt, len, max(score) AS s FROM h GROUP BY utt, len)
SELECT b.utt, count(l.len) FILTER (WHERE l.s - b.best < -10) = 3 AS ended
FROM b LEFT JOIN l ON l.utt = b.utt AND l.len BETWEEN b.i - 2 AND b.i GROUP BY b.utt""")
def q_end_detect(spark, sf):
    """ended hypotheses per utterance (order): at the last length i, the best
    score of each of the lengths i, i-1, i-2 trails the overall best by more than 10."""
    h = T(spark, sf, "lineitem").select(F.col("l_orderkey").alias("utt"), F.col("l_linenumber").alias("len"),
                                        (-F.col("l_extendedprice") / 1000).alias("score"))
    return G.end_detect(h, "utt", "len", "score", M=3, d_end=-10.0)


def _korean_sql() -> str:
    from corpusvox.functions.text import KOREAN_DIGITS, KOREAN_LETTERS
    expr = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    pairs = list(KOREAN_DIGITS.items()) + list(KOREAN_LETTERS.items()) + \
        [(k.lower(), v) for k, v in KOREAN_LETTERS.items()]
    for k, v in pairs:
        expr = f"replace({expr}, '{k}', '{v}')"
    return expr


@register("korean_clean", f"""
SELECT doc_id, length({_korean_sql()})::INTEGER AS n_chars, md5({_korean_sql()}) AS text_md5 FROM documents""")
def q_korean(spark, sf):
    """digit and letter readings applied to every document text."""
    d = T(spark, sf, "documents").select("doc_id", X.korean_clean(F.col("text")).alias("c"))
    return d.select("doc_id", F.length("c").alias("n_chars"), F.md5("c").alias("text_md5"))


@register("log_mel")
def q_log_mel(spark, sf):
    """F23 on the embedding read as a 64-sample signal: frames of 16 every 8, 4 mel bands
    (rows-only: numpy FFT per row)."""
    e = T(spark, sf, "embeddings").select("vec_id", Vf.log_mel("embedding", 16, 8, 16, 4, 16000).alias("m"))
    return e.select("vec_id", F.size("m").alias("n_frames"),
                    F.round(F.aggregate(F.flatten("m"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@register("sentence_render")
def q_sentence_render(spark, sf):
    """F4 (text form) over each turn's word tokens (rows-only: a left fold per row)."""
    c = T(spark, sf, "conversations")
    r = c.select("conv_id", "turn", X.sentence_postprocess(X.word_tokens("text")).alias("s"))
    return r.select("conv_id", "turn", F.length("s").alias("n_chars"), F.md5("s").alias("text_md5"))
