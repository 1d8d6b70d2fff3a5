"""Manifest queries.  Stand-ins: utt = documents.doc_id, spk = documents.source,
samples = documents.n_chars, per-utterance feature = labels (covers a part)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusvox.functions.text import word_tokens
from corpusvox.operators import manifest as M
from corpusvox.plans.registry import T, register

WORDS_SQL = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


def _manifest(spark, sf):
    d = T(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("utt"), F.col("source").alias("spk"),
                    F.col("n_chars").alias("n_samples"), "text")


def _labels(spark, sf):
    return T(spark, sf, "labels").select(F.col("doc_id").alias("utt"), "quality", "toxic")


@register("utt_assembly", """
SELECT d.doc_id AS utt, d.source AS spk, d.n_chars AS n_samples, length(d.text)::INTEGER AS text_len,
       coalesce(l.quality, 0) AS quality, coalesce(l.toxic, 0) AS toxic,
       (l.doc_id IS NOT NULL) AS has_label, round(coalesce(s.spk_mean_samples, 0.0), 6) AS spk_mean_samples
FROM documents d
LEFT JOIN labels l ON l.doc_id = d.doc_id
LEFT JOIN (SELECT source, avg(n_chars) AS spk_mean_samples FROM documents GROUP BY source) s
       ON s.source = d.source
""")
def q_utt_assembly(spark, sf):
    man = _manifest(spark, sf)
    spk_feat = man.groupBy("spk").agg(F.avg("n_samples").alias("spk_mean_samples"))
    out = M.assemble_utterances(
        man, utt_features=[(_labels(spark, sf), {"quality": 0, "toxic": 0}, "has_label")],
        spk_features=[(spk_feat, {"spk_mean_samples": 0.0}, None)])
    return out.select("utt", "spk", "n_samples", F.length("text").alias("text_len"), "quality", "toxic",
                      "has_label", F.round("spk_mean_samples", 6).alias("spk_mean_samples"))


@register("completeness_report", """
SELECT doc_id AS utt, 'no_label' AS reason FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
UNION ALL
SELECT doc_id AS utt, 'no_text' AS reason FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM documents t WHERE t.doc_id = d.doc_id AND trim(t.text) <> '')
""")
def q_completeness(spark, sf):
    man = _manifest(spark, sf)
    texts = man.where(F.trim("text") != "").select("utt")
    return M.completeness_report(man, {"no_label": _labels(spark, sf), "no_text": texts})


@register("length_filter", f"""
SELECT doc_id AS utt, n_chars AS n_samples, len({WORDS_SQL})::BIGINT AS n_tokens
FROM documents
WHERE n_chars BETWEEN 100 AND 40960 AND len({WORDS_SQL}) BETWEEN 1 AND 200
""")
def q_length_filter(spark, sf):
    man = _manifest(spark, sf).withColumn("n_tokens", F.size(word_tokens("text")).cast("long"))
    return M.length_filter(man, "n_samples", "n_tokens", 100, 40960, 1, 200) \
        .select("utt", "n_samples", "n_tokens")


@register("spk2utt", """
SELECT source AS spk, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx, doc_id AS utt
FROM documents
""")
def q_spk2utt(spark, sf):
    return M.spk2utt(_manifest(spark, sf).select("utt", "spk")).select("spk", "idx", "utt")


@register("corpus_counts", """
SELECT count(*) AS n_utts, count(DISTINCT source) AS n_spks,
       round(count(*)::DOUBLE / count(DISTINCT source), 6) AS utts_per_spk
FROM documents
""")
def q_corpus_counts(spark, sf):
    out = M.corpus_counts(_manifest(spark, sf))
    return out.withColumn("utts_per_spk", F.round("utts_per_spk", 6))


@register("token_length_stats", f"""
SELECT min(n)::BIGINT AS min_len, max(n)::BIGINT AS max_len, round(avg(n), 6) AS mean_len, count(n) AS n
FROM (SELECT len({WORDS_SQL}) AS n FROM documents)
""")
def q_token_length_stats(spark, sf):
    d = T(spark, sf, "documents").select(F.size(word_tokens("text")).cast("long").alias("n_tokens"))
    return M.length_stats(d, "n_tokens").withColumn("mean_len", F.round("mean_len", 6))


@register("dedupe_last_wins", """
SELECT sha256(text) AS text_key, max(doc_id) AS utt,
       arg_max(source, doc_id) AS spk, count(*) AS n_copies
FROM documents GROUP BY sha256(text)
""")
def q_dedupe(spark, sf):
    d = T(spark, sf, "documents").select(F.sha2("text", 256).alias("text_key"),
                                         F.col("doc_id").alias("utt"), F.col("source").alias("spk"))
    return M.last_wins(d, "text_key", "utt", ["utt", "spk"])


@register("keyset_diff", """
SELECT coalesce(d.doc_id, l.doc_id) AS utt,
       CASE WHEN d.doc_id IS NULL THEN 'documents' ELSE 'labels' END AS missing_in
FROM (SELECT DISTINCT doc_id FROM documents) d
FULL OUTER JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id
WHERE d.doc_id IS NULL OR l.doc_id IS NULL
""")
def q_keyset_diff(spark, sf):
    out = M.keyset_diff({"documents": _manifest(spark, sf), "labels": _labels(spark, sf)})
    return out.select("utt", F.array_join("missing_in", ",").alias("missing_in"))


@register("paired_filter", """
SELECT count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS n_kept,
       count(*) FILTER (WHERE l.doc_id IS NULL) AS n_dropped
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id
""")
def q_paired_filter(spark, sf):
    kept, dropped = M.keep_paired(_manifest(spark, sf), _labels(spark, sf))
    flagged = kept.select(F.lit(1).alias("k")).unionByName(dropped.select(F.lit(0).alias("k")))
    return flagged.agg(F.sum("k").cast("long").alias("n_kept"),
                       F.sum(1 - F.col("k")).cast("long").alias("n_dropped"))


@register("shape_table", f"""
SELECT doc_id AS utt,
       ceil(n_chars * 1000.0 / (16000 * 10 * 1))::BIGINT AS frames,
       (floor(n_chars / 16000) * 100)::BIGINT AS index_len,
       (CASE WHEN contains(trim(text, ' ' || chr(10)), ' ') THEN len({WORDS_SQL})
             ELSE length(trim(text, ' ' || chr(10))) END)::BIGINT AS text_len
FROM documents
""")
def q_shape(spark, sf):
    man = _manifest(spark, sf)
    return man.select("utt",
                      M.frame_count(F.col("n_samples")).alias("frames"),
                      M.audio_index_length(F.col("n_samples")).alias("index_len"),
                      M.text_length(F.col("text")).alias("text_len"))
