"""Corpus-text queries over ``documents`` (one line per document, in doc_id order)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusvox.functions import text as X
from corpusvox.operators import vocabulary as V
from corpusvox.plans.registry import T, register

VOCAB_SIZE = 1000
ADD_SYMBOLS = (("<blank>", 0), ("<unk>", -1))

TOKS_SQL = """toks AS (
  SELECT doc_id, t.tok, t.pos
  FROM documents,
       unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) WITH ORDINALITY AS t(tok, pos))"""

VOCAB_SQL = TOKS_SQL + f""",
counts AS (
  SELECT tok, count(*) AS cnt, min({{'k': doc_id, 'p': pos}}) AS first FROM toks
  WHERE tok NOT IN ('<blank>', '<unk>') GROUP BY tok HAVING count(*) > 0),
ranked AS (
  SELECT tok, cnt, row_number() OVER (ORDER BY cnt DESC, first) - 1 AS r FROM counts
  QUALIFY r < {VOCAB_SIZE - 2}),
vocab AS (
  SELECT (r + 1)::INTEGER AS id, tok AS token, cnt FROM ranked
  UNION ALL SELECT 0, '<blank>', NULL
  UNION ALL SELECT (SELECT count(*) FROM ranked)::INTEGER + 1, '<unk>', NULL)"""


def doc_tokens(spark, sf):
    d = T(spark, sf, "documents", spread=True)  # whole-text tokenizing is the heavy step
    return V.explode_tokens(d, "doc_id", X.word_tokens("text"))


def vocabulary(spark, sf):
    return V.build_vocabulary(doc_tokens(spark, sf), "doc_id", cutoff=0,
                              vocabulary_size=VOCAB_SIZE, add_symbols=ADD_SYMBOLS)


@register("vocabulary", "WITH " + VOCAB_SQL + " SELECT id, token, cnt FROM vocab")
def q_vocabulary(spark, sf):
    return vocabulary(spark, sf)


@register("vocabulary_whole", "WITH " + VOCAB_SQL.replace(f"\n  QUALIFY r < {VOCAB_SIZE - 2}", "") + " SELECT id, token, cnt FROM vocab")
def q_vocabulary_whole(spark, sf):
    """A5 without a cut: every token, ranked without a single task or a driver list."""
    return V.build_vocabulary(doc_tokens(spark, sf), "doc_id", add_symbols=ADD_SYMBOLS)


@register("oov_rate", "WITH " + VOCAB_SQL + """
SELECT count(*) AS total, count(v.token) AS in_vocab,
       round((count(*) - count(v.token)) * 100.0 / count(*), 6) AS oov_rate
FROM toks LEFT JOIN (SELECT token FROM vocab WHERE cnt IS NOT NULL) v ON v.token = toks.tok
WHERE toks.tok NOT IN ('<blank>', '<unk>')
""")
def q_oov(spark, sf):
    # one counting pass shared by A5 and A6: the per-token table is small next to the tokens
    counts = V.token_counts(doc_tokens(spark, sf), "doc_id").cache()
    vocab = V.vocabulary_from_counts(counts, 0, VOCAB_SIZE, ADD_SYMBOLS)
    out = V.oov_from_counts(counts, vocab, [s for s, _ in ADD_SYMBOLS])
    return out.select(F.col("total").cast("long").alias("total"), F.col("in_vocab").cast("long").alias("in_vocab"),
                      F.round("oov_rate", 6).alias("oov_rate"))


@register("token_ids", "WITH " + VOCAB_SQL + """
SELECT toks.doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE v.id IS NULL) AS n_unk,
       sum(coalesce(v.id, (SELECT id FROM vocab WHERE token = '<unk>')))::BIGINT AS id_sum,
       sum(coalesce(v.id, (SELECT id FROM vocab WHERE token = '<unk>')) * toks.pos)::BIGINT AS id_pos_sum
FROM toks LEFT JOIN (SELECT token, id FROM vocab WHERE cnt IS NOT NULL) v ON v.token = toks.tok
GROUP BY toks.doc_id
""")
def q_token_ids(spark, sf):
    # tokens meet the (bounded, broadcast) vocabulary in a hash join; per-document
    # results are partial aggregates, so token rows never shuffle
    ids = V.tokens_to_ids(doc_tokens(spark, sf), "doc_id", vocabulary(spark, sf))
    return ids.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.count(F.when(F.col("is_unk"), 1)).alias("n_unk"),
        F.sum("id").cast("long").alias("id_sum"),
        # positional checksum: the ids stay attached to their token positions
        F.sum(F.col("id") * (F.col("pos") + 1)).cast("long").alias("id_pos_sum"))


@register("unigram_dist", "WITH " + VOCAB_SQL + f""",
ids AS (SELECT DISTINCT toks.doc_id, coalesce(v.id, (SELECT id FROM vocab WHERE token = '<unk>')) AS id
        FROM toks LEFT JOIN (SELECT token, id FROM vocab WHERE cnt IS NOT NULL) v ON v.token = toks.tok),
c AS (SELECT id, count(*)::DOUBLE AS c FROM ids WHERE id <> {VOCAB_SIZE - 1} GROUP BY id
      UNION ALL SELECT {VOCAB_SIZE - 1}, (SELECT count(DISTINCT doc_id) FROM toks)::DOUBLE),
full_c AS (SELECT r.id::INTEGER AS id,
                  CASE WHEN r.id = 0 THEN 0.0 WHEN coalesce(c.c, 0) = 0 THEN 1.0 ELSE c.c END AS c
           FROM range({VOCAB_SIZE}) r(id) LEFT JOIN c ON c.id = r.id)
SELECT id, round(c / sum(c) OVER () * 1000000, 6) AS ppm FROM full_c
""")
def q_unigram(spark, sf):
    ids = V.tokens_to_ids(doc_tokens(spark, sf), "doc_id", vocabulary(spark, sf))
    out = V.unigram_distribution(ids.select("doc_id", "id"), "doc_id", VOCAB_SIZE, blank=0)
    return out.select("id", F.round(F.col("prob") * 1000000, 6).alias("ppm"))


@register("char_tokens", """
SELECT doc_id, length(replace(text, ' ', ''))::BIGINT AS n_char_tokens,
       len(regexp_extract_all(text, '(there|the|de|[^ ])', 1))::BIGINT AS n_symbol_tokens,
       len(list_filter(regexp_extract_all(text, '(there|the|de|[^ ])', 1), lambda x: x NOT IN ('the', 'there', 'de')))::BIGINT
         AS n_without_symbols,
       len(regexp_extract_all(text, '([\\x21-\\x7e]+|[^\\x00-\\x7f])', 1))::BIGINT AS n_mixed_words
FROM documents
""")
def q_char_tokens(spark, sf):
    """characters, with listed symbols (the longest first) as one token each, kept or removed; F5 words."""
    d, symbols = T(spark, sf, "documents"), ["de", "the", "there"]
    return d.select("doc_id", F.size(X.char_tokens("text", ["<unk>", "<s>"])).cast("long").alias("n_char_tokens"),
                    F.size(X.char_tokens("text", symbols)).cast("long").alias("n_symbol_tokens"),
                    F.size(X.char_tokens("text", symbols, True)).cast("long").alias("n_without_symbols"),
                    F.size(X.mixed_script_words("text")).cast("long").alias("n_mixed_words"))


@register("repetition_gate", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS t FROM documents)
SELECT doc_id,
       (len(t) >= 10 AND len(list_filter(t[len(t) - 9:len(t)], lambda x: x = t[len(t)])) / 10.0 > 0.1)
         AS repeating
FROM w
""")
def q_repetition(spark, sf):
    d = T(spark, sf, "documents")
    return d.select("doc_id", X.repetition_flag(X.word_tokens("text")).alias("repeating"))


@register("compression_gate")
def q_compression(spark, sf):
    """F10 + P9 (rows-only: zlib is not in SQL)."""
    d = T(spark, sf, "documents").select("doc_id", X.compression_ratio("text").alias("compression_ratio"))
    fallback, _ = X.quality_gate(F.col("compression_ratio"), F.lit(0.0), F.lit(0.0))
    return d.withColumn("needs_fallback", fallback)


SEG_SQL = "WITH " + VOCAB_SQL + """,
seg AS (SELECT token AS word, list_filter(string_split(trim(regexp_replace(token, '(..)', '\\1 ', 'g')), ' '),
                                          lambda x: x <> '') AS pieces
        FROM vocab WHERE cnt IS NOT NULL),
w AS (SELECT doc_id, lower(tok) AS low FROM toks),
hit AS (SELECT w.doc_id, w.low, seg.pieces FROM w LEFT JOIN seg ON seg.word = w.low)
SELECT doc_id,
       sum(CASE WHEN pieces IS NOT NULL THEN len(pieces)
                WHEN regexp_matches(low, '^[\\x{4E00}-\\x{9FA5}0-9]+$') THEN length(low) ELSE 1 END)::BIGINT AS n_tokens,
       sum(CASE WHEN pieces IS NOT NULL THEN 0
                WHEN regexp_matches(low, '^[\\x{4E00}-\\x{9FA5}0-9]+$') THEN length(low) ELSE 1 END)::BIGINT AS n_unk
FROM hit GROUP BY doc_id"""


@register("seg_tokenize", SEG_SQL)
def q_seg(spark, sf):
    """J15 (+S15): segmentation dictionary = the vocabulary words split into 2-character pieces."""
    vocab = vocabulary(spark, sf).where(F.col("cnt").isNotNull())
    seg = vocab.select(F.col("token").alias("word"),
                       F.filter(F.split(F.trim(F.regexp_replace("token", "(..)", "$1 ")), " "), lambda x: x != "")
                       .alias("pieces"))
    out = V.seg_tokenize(doc_tokens(spark, sf), "doc_id", seg)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"),
                                     F.count(F.when(F.col("token") == "<unk>", 1)).alias("n_unk"))
