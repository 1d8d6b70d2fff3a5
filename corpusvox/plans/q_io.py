"""Source/sink round trips: tables are written in the corpus file formats under
the session's shared checkpoint folder and read back with the scanners."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusvox.operators import scoring as S
from corpusvox.plans.q_scoring import WER_CLOSED_FORM
from corpusvox.plans.q_text import VOCAB_SQL, vocabulary
from corpusvox.plans.registry import T, register
from corpusvox.session import cut_lineage, ensure_checkpoint_dir
from corpusvox.sources import kaldi as K
from corpusvox.sources import manifest as Mf
from corpusvox.sources import sinks as Sk


def _dir(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _utts(spark, sf):
    d = T(spark, sf, "documents")
    return d.select(F.col("doc_id").cast("string").alias("utt"),
                    F.format_string("wav/%s/%d.wav", F.col("source"), F.col("doc_id")).alias("wav"),
                    "text", F.col("source").alias("spk"))


FLAT_TEXT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@register("kaldi_roundtrip", f"""
SELECT doc_id::VARCHAR AS utt, 'wav/' || source || '/' || doc_id::VARCHAR || '.wav' AS wav,
       {FLAT_TEXT} AS text, source AS spk
FROM documents WHERE {FLAT_TEXT} <> ''""")
def q_kaldi_roundtrip(spark, sf):
    """K1 -> S1/S2: write wav.scp, text, utt2spk, spk2utt; read back and join."""
    root = _dir(spark, "kaldi")
    Sk.write_kaldi_dir(_utts(spark, sf), root)
    wav = K.read_keyed_text(spark, f"{root}/wav.scp", "utt", "wav")
    text = K.read_keyed_text(spark, f"{root}/text", "utt", "text")
    spk = K.read_utt2spk(spark, f"{root}/utt2spk")
    return wav.join(text, "utt").join(spk, "utt").select("utt", "wav", "text", "spk")


@register("spk2utt_roundtrip", """
SELECT source AS spk, count(*) AS n_utts, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id::VARCHAR) AS utts
FROM documents GROUP BY source""")
def q_spk2utt_roundtrip(spark, sf):
    """K1 spk2utt -> S3 key-list scan."""
    root = _dir(spark, "kaldi")
    Sk.write_kaldi_dir(_utts(spark, sf), root)
    s = K.read_key_list(spark, f"{root}/spk2utt", "spk", "utt_list")
    return s.select("spk", F.size("utt_list").cast("long").alias("n_utts"), F.array_join("utt_list", " ").alias("utts"))


@register("manifest_jsonl_roundtrip", """
SELECT doc_id::VARCHAR AS utt, 'wav/' || source || '/' || doc_id::VARCHAR || '.wav' AS wav, text,
       CASE WHEN doc_id % 3 = 0 THEN 'default_speaker' ELSE source END AS spk
FROM documents WHERE text <> ''""")
def q_manifest_jsonl(spark, sf):
    """K3 -> S8: aliases (wav, transcript, spk, utt), empty ids fall back, a missing speaker defaults."""
    root = _dir(spark, "jsonl")
    u = _utts(spark, sf)
    rec = u.select(F.lit("").alias("utt_id"), "utt", F.col("wav"), F.col("text").alias("transcript"),
                   F.when(F.col("utt").cast("long") % 3 != 0, F.col("spk")).alias("spk"))
    Sk.write_jsonl(rec, root)
    rows, _ = Mf.read_manifest_jsonl(spark, root)
    return rows.select("utt", "wav", "text", "spk")


@register("parquet_shard_roundtrip", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity,
                  (row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_quantity) - 1) // 1000 AS shard FROM lineitem)
SELECT shard, count(*) AS n_rows, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key,
       sum(l_quantity) AS sum_qty, 0::BIGINT AS n_rejects FROM r GROUP BY shard""")
def q_shard_roundtrip(spark, sf):
    """K2 -> S11: key-ordered shards of exactly 1000 rows, a data.list, read back from the list."""
    root = _dir(spark, "shards")
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    shards = cut_lineage(Sk.write_shards(li, "l_orderkey", f"{root}/data", 1000, ["l_linenumber", "l_quantity"]))
    Sk.write_list(shards, f"{root}/data.list")
    back, rejects = Mf.read_parquet_list(spark, f"{root}/data.list")
    per = back.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("l_quantity").alias("sum_qty"))
    return per.join(shards, "path").select("shard", "n_rows", "first_key", "last_key", "sum_qty",
                                           F.lit(rejects.count()).cast("long").alias("n_rejects"))


@register("vocabulary_roundtrip", "WITH " + VOCAB_SQL + " SELECT id, token FROM vocab")
def q_vocab_roundtrip(spark, sf):
    """K7 -> S14: vocabulary file, id = line number; duplicates and a missing <unk> fail."""
    root = _dir(spark, "vocab")
    Sk.write_vocabulary(vocabulary(spark, sf), root)
    return K.read_vocabulary(spark, root)


@register("trials_roundtrip", """
WITH t AS (SELECT d.doc_id AS pos, d.n_chars::DOUBLE AS score, l.quality AS label
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
tot AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM t),
r AS (SELECT pos, score, sum(label) OVER (ORDER BY score, pos ROWS UNBOUNDED PRECEDING) AS fns,
             sum(1 - label) OVER (ORDER BY score, pos ROWS UNBOUNDED PRECEDING) AS tns FROM t),
rr AS (SELECT r.*, fns / tot.p AS fnr, 1 - tns / tot.n AS fpr FROM r, tot)
SELECT round(c / 0.01, 6) AS min_dcf, score AS threshold FROM (
  SELECT 1.0 * fnr * 0.01 + 1.0 * fpr * 0.99 AS c, score, pos FROM rr ORDER BY c, score, pos LIMIT 1)""")
def q_trials_roundtrip(spark, sf):
    """S17 + J5: trial and score lists written as text, read back, joined on (utt1, utt2)."""
    root = _dir(spark, "trials")
    l = T(spark, sf, "labels")
    d = T(spark, sf, "documents").select("doc_id", "n_chars")
    t = l.join(d, "doc_id").select(F.col("doc_id").cast("string").alias("u1"), F.lit("ref").alias("u2"),
                                   "quality", "n_chars")
    t.select(F.concat_ws(" ", "u1", "u2", F.when(F.col("quality") == 1, "target").otherwise("nontarget"))) \
        .write.mode("overwrite").text(f"{root}/trials")
    t.select(F.concat_ws(" ", "u1", "u2", F.col("n_chars").cast("double").cast("string"))) \
        .write.mode("overwrite").text(f"{root}/scores")
    tr = K.read_trials(spark, f"{root}/trials").drop("line_no")
    sc = K.read_scores(spark, f"{root}/scores").drop("line_no")
    j = sc.join(tr, ["utt1", "utt2"], "inner")
    orphans = sc.join(tr, ["utt1", "utt2"], "left_anti").limit(1).count()
    if orphans:
        raise ValueError("a score has no trial")
    trials = j.select(F.col("utt1").cast("long").alias("pos"), "score", "label")
    m = S.min_dcf(S.error_rates(trials))
    return m.select(F.round("min_dcf", 6).alias("min_dcf"), "threshold")


@register("trials_positional", """
WITH t AS (SELECT d.doc_id AS pos, d.n_chars::DOUBLE AS score, l.quality AS label
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
tot AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM t),
r AS (SELECT pos, score, sum(label) OVER (ORDER BY score, pos ROWS UNBOUNDED PRECEDING) AS fns,
             sum(1 - label) OVER (ORDER BY score, pos ROWS UNBOUNDED PRECEDING) AS tns FROM t),
rr AS (SELECT r.*, fns / tot.p AS fnr, 1 - tns / tot.n AS fpr FROM r, tot)
SELECT round(c / 0.01, 6) AS min_dcf, score AS threshold FROM (
  SELECT 1.0 * fnr * 0.01 + 1.0 * fpr * 0.99 AS c, score, pos FROM rr ORDER BY c, score, pos LIMIT 1)""")
def q_trials_positional(spark, sf):
    """Label-only trial lines and score-only lines joined by line position
    (zipWithIndex on each file), then minDCF."""
    root = _dir(spark, "trials")
    l = T(spark, sf, "labels")
    d = T(spark, sf, "documents").select("doc_id", "n_chars")
    # both files come from the same range-partitioned sort, so their line orders agree
    t = l.join(d, "doc_id").orderBy("doc_id").select("doc_id", "quality", "n_chars")
    t.select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("x"),
                         F.when(F.col("quality") == 1, "target").otherwise("nontarget"))).write.mode("overwrite") \
        .text(f"{root}/trials")
    t.select(F.concat_ws(" ", F.lit("?"), F.lit("?"), F.col("n_chars").cast("double").cast("string"))) \
        .write.mode("overwrite").text(f"{root}/scores")
    tr = K.read_trials(spark, f"{root}/trials")
    sc = K.read_scores(spark, f"{root}/scores").select("line_no", "score")
    trials = tr.join(sc, "line_no").select(F.col("utt1").cast("long").alias("pos"), "score", "label")
    m = S.min_dcf(S.error_rates(trials))
    return m.select(F.round("min_dcf", 6).alias("min_dcf"), "threshold")


@register("segments_roundtrip", """
SELECT user_id::VARCHAR AS rec, count(*) AS n_segments,
       floor(sum(value * 300) * 1000 + 0.5) / 1000 AS total_dur FROM events GROUP BY user_id""")
def q_segments_roundtrip(spark, sf):
    """A segments file (utt rec start end) read back and summed per recording."""
    root = _dir(spark, "segments")
    e = T(spark, sf, "events")
    start = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6
    e.select(F.concat_ws(" ", F.col("event_id").cast("string"), F.col("user_id").cast("string"),
                         start.cast("string"), (start + F.col("value") * 300).cast("string"))) \
        .write.mode("overwrite").text(f"{root}/segments")
    s = K.read_segments(spark, f"{root}/segments")
    return s.groupBy("rec").agg(F.count(F.lit(1)).alias("n_segments"),
                                (F.floor(F.sum(F.col("et") - F.col("st")) * 1000 + 0.5) / 1000).alias("total_dur"))


@register("cmvn_file_roundtrip", """
WITH e AS (SELECT (t.dim - 1)::INTEGER AS dim, t.x::DOUBLE AS x FROM embeddings, unnest(embedding) WITH ORDINALITY AS t(x, dim))
SELECT dim, round(sum(x), 6) AS mean_stat, round(sum(x * x), 6) AS var_stat, count(*) AS total_frames FROM e GROUP BY dim""")
def q_cmvn_file(spark, sf):
    """K9 -> read back: the JSON statistics document (sums, squares, frame count)."""
    from corpusvox.operators.features import global_cmvn
    root = _dir(spark, "cmvn")
    Sk.write_cmvn(global_cmvn(T(spark, sf, "embeddings"), "embedding"), root)
    j = spark.read.json(root)
    z = j.select(F.posexplode(F.arrays_zip("mean_stats", "var_stats")).alias("dim", "z"), "total_frames")
    return z.select(F.col("dim").cast("int").alias("dim"), F.round("z.mean_stats", 6).alias("mean_stat"),
                    F.round("z.var_stats", 6).alias("var_stat"), F.col("total_frames").cast("long").alias("total_frames"))


@register("wer_report_roundtrip", WER_CLOSED_FORM + """
SELECT item_id, n::INTEGER AS nwords, (n - d - s)::INTEGER AS cor, s::INTEGER AS sub, 0 AS ins, d::INTEGER AS del,
       (d + s)::INTEGER AS wrong, (sum(n) OVER ())::BIGINT AS wrd, (sum(d + s) OVER ())::BIGINT AS wrong_words FROM c""")
def q_wer_report(spark, sf):
    """Per-utterance detail and a totals row written, then read back and put side by side."""
    from corpusvox.plans.q_scoring import _wer_pairs
    root = _dir(spark, "wer")
    detail = S.wer_detail(_wer_pairs(spark, sf), "item_id", "ref", "hyp")
    Sk.write_wer_report(detail, S.wer_totals(detail), root)
    total = spark.read.json(f"{root}/totals").select("wrd", "wrong_words").first()  # the one totals row
    return spark.read.parquet(f"{root}/detail").select(
        "*", F.lit(total["wrd"]).cast("long").alias("wrd"), F.lit(total["wrong_words"]).cast("long").alias("wrong_words"))


@register("nbest_files_roundtrip", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank
           FROM lineitem)
SELECT rank || 'best_recog' AS nbest, l_orderkey AS key, l_linenumber::BIGINT AS token, round(l_extendedprice, 2) AS score
FROM r WHERE rank <= 2""")
def q_nbest_files(spark, sf):
    """N-best results as '{n}best_recog/{field}' key-value files, read back line by line."""
    from corpusvox.operators.batching import top_n
    root = _dir(spark, "nbest")
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    nb = top_n(li, ["l_orderkey"], "l_extendedprice", 2, "l_linenumber")
    Sk.write_nbest(nb, root, {"token": "l_linenumber", "score": "l_extendedprice"}, key="l_orderkey")
    parts = F.split("value", " ")
    back = spark.read.text(root).select("nbest", "field", parts[0].cast("long").alias("key"), parts[1].alias("v"))
    return back.groupBy("nbest", "key").agg(
        F.max(F.when(F.col("field") == "token", F.col("v").cast("long"))).alias("token"),
        F.round(F.max(F.when(F.col("field") == "score", F.col("v").cast("double"))), 2).alias("score"))


@register("edit_pairs_roundtrip", """
SELECT 'a/' || conv_id || '_' || turn || '.wav' AS prompt_audio_path, text AS target_text,
       'b/' || conv_id || '_' || turn || '.wav' AS target_audio_path, conv_id::VARCHAR AS speaker_id
FROM conversations WHERE role <> 'system' AND turn % 5 <> 1 AND turn % 7 <> 2""")
def q_edit_pairs(spark, sf):
    """Paired edit JSONL; records without both audio paths, or whose audio is
    not in the listing, are dropped (semi joins against the listing)."""
    root = _dir(spark, "edits")
    c = T(spark, sf, "conversations")
    rec = c.select(F.format_string("a/%d_%d.wav", "conv_id", "turn").alias("prompt_audio_path"),
                   F.col("text").alias("prompt_text"), F.col("text").alias("target_text"),
                   F.when(F.col("role") != "system", F.format_string("b/%d_%d.wav", "conv_id", "turn"))
                   .alias("target_audio_path"), F.lit("emotion").alias("edit_type"),
                   F.col("conv_id").cast("string").alias("speaker_id"))
    Sk.write_jsonl(rec, f"{root}/pairs")
    # the listing lacks some prompts and some targets
    listing = c.where("turn % 5 <> 1").select(F.format_string("a/%d_%d.wav", "conv_id", "turn").alias("path")).unionByName(
        c.where("turn % 7 <> 2").select(F.format_string("b/%d_%d.wav", "conv_id", "turn").alias("path")))
    return Mf.read_edit_pairs(spark, f"{root}/pairs", listing).select(
        "prompt_audio_path", "target_text", "target_audio_path", "speaker_id")


@register("calibration_csv_roundtrip", """
SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id""")
def q_calibration_csv(spark, sf):
    """A calibration set read by extension (csv here)."""
    root = _dir(spark, "calib") + ".csv"
    T(spark, sf, "conversations").select("conv_id", "turn").write.mode("overwrite").option("header", "true").csv(root)
    back = Mf.read_by_extension(spark, root)
    return back.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_turns"))


@register("index_jsonl_roundtrip", """
SELECT doc_id::VARCHAR AS key, '<ASR>' AS prompt, source, lang AS target,
       CASE WHEN doc_id % 2 = 0 THEN n_chars::INTEGER ELSE 1 END AS source_len, 0 AS target_len
FROM documents""")
def q_index_jsonl(spark, sf):
    """Index records; missing prompt / lengths take the defaults '<ASR>', 1, 0."""
    root = _dir(spark, "index")
    d = T(spark, sf, "documents")
    d.select(F.col("doc_id").cast("string").alias("key"), "source", F.col("lang").alias("target"),
             F.when(F.col("doc_id") % 2 == 0, F.col("n_chars").cast("int")).alias("source_len")) \
        .write.mode("overwrite").json(root)
    return Mf.read_index_jsonl(spark, root)


@register("scp_inputs_roundtrip", """
SELECT doc_id::VARCHAR AS key, 'wav/' || doc_id::VARCHAR || '.wav' AS data FROM documents""")
def q_scp_inputs(spark, sf):
    """S10 (.scp 'key data' lines) and S6 (scp with a custom key separator) read back."""
    root = _dir(spark, "scp")
    d = T(spark, sf, "documents")
    d.select(F.concat_ws(" ", F.col("doc_id").cast("string"), F.format_string("wav/%d.wav", "doc_id"))) \
        .write.mode("overwrite").text(f"{root}/a.scp")
    d.select(F.concat_ws("|", F.col("doc_id").cast("string"), F.format_string("wav/%d.wav", "doc_id"))) \
        .write.mode("overwrite").text(f"{root}/b.scp")
    a = Mf.read_inputs(spark, f"{root}/a.scp").select("key", "data")
    b = K.read_scp(spark, f"{root}/b.scp", kv_sep="|").select("key", F.col("value").alias("b"))
    return a.join(b, "key").where(F.col("data") == F.col("b")).select("key", "data")


@register("hotword_list_roundtrip", """
SELECT DISTINCT 'w' || conv_id AS word, 'w' || conv_id = '<s>' AS is_last FROM conversations
UNION ALL SELECT '<s>', true""")
def q_hotword_list(spark, sf):
    """A hotword file (one per line, blank lines and blanks around words aside) plus the '<s>' sentinel, last."""
    root = _dir(spark, "hot")
    T(spark, sf, "conversations").select("conv_id").distinct().select(
        F.explode(F.array(F.format_string("  w%d ", "conv_id"), F.lit("   "))).alias("value")) \
        .write.mode("overwrite").text(root)
    w = K.read_hotwords(spark, root)
    last = w.agg(F.max("line_no").alias("last"))
    return w.join(last, w["line_no"] == last["last"], "left").select("word", F.col("last").isNotNull().alias("is_last"))


@register("triples_roundtrip", """
SELECT doc_id::VARCHAR AS key, 'feat/' || doc_id::VARCHAR AS feat, 'lab/' || doc_id::VARCHAR AS label FROM labels""")
def q_triples(spark, sf):
    """Key, feature path, label path lines."""
    root = _dir(spark, "triples")
    T(spark, sf, "labels").select(F.format_string("%d feat/%d lab/%d", "doc_id", "doc_id", "doc_id")) \
        .write.mode("overwrite").text(root)
    return K.read_triples(spark, root)
