"""Scoring queries.

* WER: reference = ``benchmark.text`` words; hypothesis = a fixed corruption
  (word i replaced by ``zzz`` when i % 5 == 2, then words with i % 7 == 6
  dropped).  With that corruption the optimal alignment counts are unique
  (sub = replaced, del = dropped, ins = 0), which gives a closed-form twin.
* CER: adjacent turns of a conversation (turn t = reference, next turn = hypothesis).
* Verification: trials = labels JOIN documents; target = quality, score = n_chars,
  stable order = doc_id (ties in score are real).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusvox.functions.text import word_tokens
from corpusvox.operators import scoring as S
from corpusvox.plans.registry import T, register
from corpusvox.plans.sequence import seq_lead

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"

WER_CLOSED_FORM = f"""
WITH w AS (SELECT item_id, len({WORDS}) AS n FROM benchmark),
c AS (SELECT item_id, n, n // 7 AS d,
             len(list_filter(range(n), lambda i: i % 5 = 2 AND i % 7 <> 6)) AS s FROM w)
"""


def corrupt(words):
    replaced = F.transform(words, lambda x, i: F.when(i % 5 == 2, F.lit("zzz")).otherwise(x))
    return F.filter(replaced, lambda x, i: i % 7 != 6)


def _wer_pairs(spark, sf):
    """The reference table and the hypothesis table are joined on the key."""
    b = T(spark, sf, "benchmark")
    ref = b.select(F.col("item_id").alias("key"), word_tokens("text").alias("words"))
    hyp = b.select(F.col("item_id").alias("key"), corrupt(word_tokens("text")).alias("words"))
    return S.join_ref_hyp(ref, hyp, "key").withColumnRenamed("key", "item_id")


@register("wer_detail", WER_CLOSED_FORM + """
SELECT item_id, n::INTEGER AS nwords, (n - d - s)::INTEGER AS cor, s::INTEGER AS sub, 0 AS ins,
       d::INTEGER AS del, (d + s)::INTEGER AS wrong FROM c
""")
def q_wer_detail(spark, sf):
    return S.wer_detail(_wer_pairs(spark, sf), "item_id", "ref", "hyp")


@register("wer_totals", WER_CLOSED_FORM + """
SELECT sum(n)::BIGINT AS wrd, sum(n - d - s)::BIGINT AS corr, 0::BIGINT AS ins, sum(d)::BIGINT AS del,
       sum(s)::BIGINT AS sub, count(*) AS snt, sum(d + s)::BIGINT AS wrong_words,
       count(*) FILTER (WHERE d + s > 0) AS wrong_sentences,
       round(sum(d + s) * 100.0 / sum(n), 2) AS err,
       round(count(*) FILTER (WHERE d + s > 0) * 100.0 / count(*), 2) AS s_err
FROM c
""")
def q_wer_totals(spark, sf):
    return S.wer_totals(S.wer_detail(_wer_pairs(spark, sf), "item_id", "ref", "hyp"))


def _turn_pairs(spark, sf):
    c = T(spark, sf, "conversations").select("conv_id", "turn", "text")
    nxt = seq_lead(c, ["conv_id"], ["turn"], ["text"], suffix="_next").drop("_seq_b")
    return nxt.where(F.col("text_next").isNotNull()) \
        .select("conv_id", "turn", F.col("text").alias("ref"), F.col("text_next").alias("hyp"))


CER_SQL = """
WITH chars AS (SELECT DISTINCT c FROM (SELECT unnest(string_split(text, '')) AS c FROM conversations) WHERE c <> ' '),
cmap AS (SELECT c, chr((32 + row_number() OVER (ORDER BY c))::INTEGER) AS b FROM chars),
enc0 AS (SELECT conv_id, turn, string_agg(m.b, '' ORDER BY t.pos) AS e
         FROM conversations, unnest(string_split(text, '')) WITH ORDINALITY AS t(c, pos)
         JOIN cmap m ON m.c = t.c GROUP BY conv_id, turn),
enc AS (SELECT c.conv_id, c.turn, coalesce(e.e, '') AS e,
               lead(coalesce(e.e, '')) OVER (PARTITION BY c.conv_id ORDER BY c.turn) AS nxt
        FROM conversations c LEFT JOIN enc0 e ON e.conv_id = c.conv_id AND e.turn = c.turn)
"""


@register("cer_detail", CER_SQL + """
SELECT conv_id, turn, levenshtein(nxt, e)::BIGINT AS dist, length(e)::BIGINT AS ref_len
FROM enc WHERE nxt IS NOT NULL
""")
def q_cer_detail(spark, sf):
    d = S.cer_detail(_turn_pairs(spark, sf), ["conv_id", "turn"], "ref", "hyp")
    return d.select("conv_id", "turn", F.col("dist").cast("long").alias("dist"),
                    F.col("ref_len").cast("long").alias("ref_len"))


@register("cer_corpus", CER_SQL + """
SELECT sum(levenshtein(nxt, e))::BIGINT AS dist, sum(length(e))::BIGINT AS ref_len,
       round(sum(levenshtein(nxt, e)) / sum(length(e)), 6) AS rate
FROM enc WHERE nxt IS NOT NULL
""")
def q_cer_corpus(spark, sf):
    r = S.corpus_rate(S.cer_detail(_turn_pairs(spark, sf), ["conv_id", "turn"], "ref", "hyp"))
    return r.withColumn("rate", F.round("rate", 6))


TRIALS_SQL = """
WITH t AS (SELECT d.doc_id AS pos, d.n_chars::DOUBLE AS score, l.quality AS label
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
tot AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM t),
r AS (SELECT pos, score, label,
             sum(label) OVER (ORDER BY score, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS fns,
             sum(1 - label) OVER (ORDER BY score, pos ROWS UNBOUNDED PRECEDING)::BIGINT AS tns
      FROM t),
rr AS (SELECT r.*, fns / tot.p AS fnr, 1 - tns / tot.n AS fpr FROM r, tot)
"""


def _trials(spark, sf):
    l = T(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    d = T(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return l.join(d, "doc_id").select(F.col("doc_id").alias("pos"), "score", "label")


@register("error_rates", TRIALS_SQL + """
SELECT pos, score, label, fns, tns, round(fnr, 6) AS fnr, round(fpr, 6) AS fpr FROM rr
""")
def q_error_rates(spark, sf):
    r = S.error_rates(_trials(spark, sf))
    return r.select("pos", "score", "label", "fns", "tns", F.round("fnr", 6).alias("fnr"),
                    F.round("fpr", 6).alias("fpr"))


@register("min_dcf", TRIALS_SQL + """
SELECT round(c / 0.01, 6) AS min_dcf, score AS threshold FROM (
  SELECT 1.0 * fnr * 0.01 + 1.0 * fpr * 0.99 AS c, score, pos FROM rr ORDER BY c, score, pos LIMIT 1)
""")
def q_min_dcf(spark, sf):
    m = S.min_dcf(S.error_rates(_trials(spark, sf)), p_target=0.01, c_miss=1.0, c_fa=1.0)
    return m.select(F.round("min_dcf", 6).alias("min_dcf"), "threshold")


@register("eer", """
WITH t AS (SELECT d.n_chars::DOUBLE AS score, l.quality AS label
           FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
tot AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM t),
per AS (SELECT score, sum(label) AS pos_n, sum(1 - label) AS neg_n FROM t GROUP BY score),
cum AS (SELECT score, sum(pos_n) OVER (ORDER BY score DESC) AS tp, sum(neg_n) OVER (ORDER BY score DESC) AS fp
        FROM per UNION ALL SELECT 'inf'::DOUBLE, 0, 0),
pts AS (SELECT score, 1 - tp / tot.p AS fnr, fp / tot.n AS fpr FROM cum, tot)
SELECT round((fnr + fpr) / 2, 6) AS eer, score AS threshold FROM pts
ORDER BY abs(fnr - fpr), score DESC LIMIT 1
""")
def q_eer(spark, sf):
    e = S.eer(_trials(spark, sf))
    return e.select(F.round("eer", 6).alias("eer"), "threshold")


@register("token_accuracy", """
SELECT sum(CASE WHEN l.toxic <> 1 AND (CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END) = l.quality THEN 1 ELSE 0 END)::BIGINT
         AS correct,
       sum(CASE WHEN l.toxic <> 1 THEN 1 ELSE 0 END)::BIGINT AS total,
       round(sum(CASE WHEN l.toxic <> 1 AND (CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END) = l.quality THEN 1 ELSE 0 END)
             / sum(CASE WHEN l.toxic <> 1 THEN 1 ELSE 0 END), 6) AS accuracy
FROM labels l JOIN documents d ON d.doc_id = l.doc_id
""")
def q_accuracy(spark, sf):
    l = T(spark, sf, "labels")
    d = T(spark, sf, "documents").select("doc_id", "n_chars")
    x = l.join(d, "doc_id").select(
        F.when(F.col("n_chars") > 2000, 1).otherwise(0).alias("pred"),
        F.when(F.col("toxic") == 1, -1).otherwise(F.col("quality")).alias("target"))
    return S.masked_accuracy(x, "pred", "target", ignore=-1).withColumn("accuracy", F.round("accuracy", 6))
