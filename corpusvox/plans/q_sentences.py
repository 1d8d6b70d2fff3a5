"""Sentence / transcript queries over ``conversations``.

Stand-in token stream: the words of a conversation's turns in (turn, position)
order.  A word's trailing ``.!`` gives punctuation id 3, ``?`` id 4, ``,`` id 2,
otherwise 1; the token text is the word without those marks.  Token k
(1-based in the conversation) spans [(k-1)*200, (k-1)*200+150] ms.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusvox.functions.text import word_tokens
from corpusvox.operators import segments as G
from corpusvox.plans.registry import T, register
from corpusvox.plans.sequence import seq_cumsum
from corpusvox.session import cut_lineage

TOK_SQL = """
w AS (SELECT conv_id, turn, t.word, t.pos FROM conversations,
      unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) WITH ORDINALITY AS t(word, pos)),
k AS (SELECT conv_id, word, row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos) AS k,
             CASE WHEN regexp_replace(word, '[.,?!]+$', '') = '' THEN word
                  ELSE regexp_replace(word, '[.,?!]+$', '') END AS token,
             CASE WHEN regexp_matches(word, '[.!]$') THEN 3 WHEN regexp_matches(word, '[?]$') THEN 4
                  WHEN regexp_matches(word, ',$') THEN 2 ELSE 1 END AS punc FROM w),
s0 AS (SELECT *, (sum(CASE WHEN punc > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)
                  - CASE WHEN punc > 1 THEN 1 ELSE 0 END)::BIGINT AS sid FROM k),
s1 AS (SELECT *, lag(sid) OVER (PARTITION BY conv_id ORDER BY k) AS sid_p,
              lag(token) OVER (PARTITION BY conv_id ORDER BY k) AS tok_p FROM s0),
s2 AS (SELECT *, CASE WHEN regexp_matches(token, '^[A-Za-z]') THEN ' '
                      WHEN sid_p = sid AND regexp_matches(tok_p, '[A-Za-z]$') THEN ' ' ELSE '' END
                 || token || CASE punc WHEN 2 THEN '，' WHEN 3 THEN '。' WHEN 4 THEN '？' WHEN 5 THEN '、' ELSE '' END
                 AS piece FROM s1),
sent AS (SELECT conv_id, sid, string_agg(piece, '' ORDER BY k) AS text, min(k) AS kmin, max(k) AS kmax,
                count(*) AS n_tokens FROM s2 GROUP BY conv_id, sid
         HAVING max(CASE WHEN punc > 1 THEN 1 ELSE 0 END) = 1),
sentences AS (SELECT conv_id, sid, text,
                     coalesce(lag((kmax - 1) * 200 + 150) OVER (PARTITION BY conv_id ORDER BY sid),
                              (kmin - 1) * 200)::BIGINT AS start,
                     ((kmax - 1) * 200 + 150)::BIGINT AS "end", n_tokens FROM sent)"""


def conv_tokens(spark, sf):
    c = T(spark, sf, "conversations", spread=True).select("conv_id", "turn", word_tokens("text").alias("w"))
    # token index k = tokens in earlier turns + position: a running sum over the
    # (small) per-turn table instead of a row number over every token
    turns = seq_cumsum(c.select("conv_id", "turn", F.size("w").cast("long").alias("n")), ["conv_id"], ["turn"],
                       {"_upto": F.col("n")}).drop("_seq_b")
    c = c.join(turns.select("conv_id", "turn", (F.col("_upto") - F.col("n")).alias("_off")), ["conv_id", "turn"])
    c = c.select("conv_id", "_off", F.posexplode("w").alias("pos", "word")) \
        .withColumn("k", F.col("_off") + F.col("pos") + 1)
    stripped = F.regexp_replace("word", r"[.,?!]+$", "")
    token = F.when(stripped == "", F.col("word")).otherwise(stripped)
    punc = F.when(F.col("word").rlike(r"[.!]$"), 3).when(F.col("word").rlike(r"[?]$"), 4) \
        .when(F.col("word").rlike(r",$"), 2).otherwise(1)
    return c.select("conv_id", "k", token.alias("token"), punc.alias("punc"),
                    ((F.col("k") - 1) * 200).alias("t_start"), ((F.col("k") - 1) * 200 + 150).alias("t_end"))


def sentences(spark, sf):
    # the token stream feeds several window passes: materialise it once in the
    # shared checkpoint folder instead of re-tokenising for every pass
    return G.sentences(cut_lineage(conv_tokens(spark, sf)), "conv_id", ["k"])


@register("sentences", "WITH " + TOK_SQL + " SELECT conv_id, sid, text, start, \"end\", n_tokens FROM sentences")
def q_sentences(spark, sf):
    return sentences(spark, sf).select("conv_id", "sid", "text", F.col("start").cast("long").alias("start"),
                                       F.col("end").cast("long").alias("end"), "n_tokens")


@register("combine_segments", """
SELECT conv_id, count(*) AS n_segments, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def q_combine(spark, sf):
    c = T(spark, sf, "conversations")
    return G.combine_segments(c, "conv_id", "turn").select("conv_id", "n_segments", "text")


FMT_SQL = """
ts_fmt AS (SELECT *, {col} // 3600000 AS h, ({col} % 3600000) // 60000 AS m, ({col} % 60000) // 1000 AS s,
                  {col} % 1000 AS ms FROM {src})"""


def _fmt_sql(ms, hours, marker):
    h = f"({ms}) // 3600000"
    body = (f"printf('%02d:%02d{marker}%03d', (({ms}) % 3600000) // 60000, (({ms}) % 60000) // 1000, "
            f"({ms}) % 1000)")
    if hours:
        return f"(printf('%02d:', {h}) || {body})"
    return f"(CASE WHEN {h} > 0 THEN printf('%02d:', {h}) ELSE '' END || {body})"


def _blocks(spark, sf, fmt):
    # the sentence table is small next to the tokens: checkpoint it so numbering
    # (W18) does not re-run the token pipeline for its bucket statistics
    s = G.number_segments(cut_lineage(sentences(spark, sf)), "conv_id", ["sid"], "idx")
    return G.transcript_blocks(s, fmt).select("conv_id", "idx", "block")


@register("srt_export", "WITH " + TOK_SQL + f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY sid) AS idx,
       row_number() OVER (PARTITION BY conv_id ORDER BY sid)::VARCHAR || chr(10)
       || {_fmt_sql('start', True, ',')} || ' --> ' || {_fmt_sql('"end"', True, ',')} || chr(10)
       || replace(trim(text), '-->', '->') || chr(10) AS block
FROM sentences""")
def q_srt(spark, sf):
    return _blocks(spark, sf, "srt")


@register("vtt_export", "WITH " + TOK_SQL + f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY sid) AS idx,
       {_fmt_sql('start', False, '.')} || ' --> ' || {_fmt_sql('"end"', False, '.')} || chr(10)
       || replace(trim(text), '-->', '->') || chr(10) AS block
FROM sentences""")
def q_vtt(spark, sf):
    return _blocks(spark, sf, "vtt")


@register("tsv_export", "WITH " + TOK_SQL + """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY sid) AS idx,
       start::VARCHAR || chr(9) || "end"::VARCHAR || chr(9) || replace(trim(text), chr(9), ' ') AS block
FROM sentences""")
def q_tsv(spark, sf):
    return _blocks(spark, sf, "tsv")


@register("txt_export", "WITH " + TOK_SQL + """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY sid) AS idx, trim(text) AS block FROM sentences""")
def q_txt(spark, sf):
    return _blocks(spark, sf, "txt")


@register("json_export", "WITH " + TOK_SQL + """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY sid) AS idx,
       to_json({'id': row_number() OVER (PARTITION BY conv_id ORDER BY sid), 'start': start, 'end': "end",
                'text': trim(text)})::VARCHAR AS block FROM sentences""")
def q_json(spark, sf):
    return _blocks(spark, sf, "json")
