"""Queries of sources, word distances, prompts and extension hooks over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusvox.functions import text as X
from corpusvox.functions.edit import char_distance
from corpusvox.operators import extensions as Ex
from corpusvox.operators import prompts as P
from corpusvox.operators import scoring as S
from corpusvox.plans.q_io import _dir
from corpusvox.plans.registry import T, register
from corpusvox.sources import kaldi as K
from corpusvox.sources import sinks as Sk

WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda x: x <> '')"

SEGMENTS = """SELECT event_id::VARCHAR AS utt, user_id::VARCHAR AS rec, (event_id % 1000)::DOUBLE AS st,
       (event_id % 1000 + event_id % 7)::DOUBLE AS et FROM events"""


def _segments(spark, sf):
    """Event i is a segment from i % 1000 on, i % 7 long; written as a segments file and read back."""
    root = _dir(spark, "segments")
    i = F.col("event_id")
    T(spark, sf, "events").select(F.concat_ws(" ", i, "user_id", i % 1000, i % 1000 + i % 7)) \
        .write.mode("overwrite").text(root)
    return K.read_segments(spark, root)


@register("segments_by_utt", SEGMENTS)
def q_by_utt(spark, sf):
    """The layout by utterance."""
    return K.segments_by_utt(_segments(spark, sf)).select("utt", "rec", "st", "et")


@register("segments_by_rec", f"""
SELECT rec, count(*)::INTEGER AS n, string_agg(utt, ' ' ORDER BY st, et, utt) AS utts, sum(et - st) AS dur
FROM ({SEGMENTS}) GROUP BY rec""")
def q_by_rec(spark, sf):
    """The layout by recording, segments in order of start."""
    s = K.segments_by_rec(_segments(spark, sf))
    dur = F.aggregate("segments", F.lit(0.0), lambda acc, x: acc + x["et"] - x["st"])
    return s.select("rec", F.size("segments").alias("n"), F.array_join(F.col("segments.utt"), " ").alias("utts"),
                    dur.alias("dur"))


@register("reco2dur_roundtrip", "SELECT doc_id::VARCHAR AS rec, n_chars / 8.0 AS dur FROM documents")
def q_reco2dur(spark, sf):
    """A recording-duration file written and read back."""
    root = _dir(spark, "reco2dur")
    d = T(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 8.0).alias("dur"))
    Sk.write_keyed_text(d, "doc_id", "dur", root)
    return K.read_reco2dur(spark, root)


@register("audio_base64", "SELECT doc_id, to_base64(encode(text)) AS b64 FROM documents")
def q_base64(spark, sf):
    """Bytes (here a text's) as base64."""
    d = T(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return d.select("doc_id", F.replace(Sk.audio_base64("bytes"), F.lit("\r\n"), F.lit("")).alias("b64"))


@register("english_words", """
WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\\x21-\\x7e]+|[^\\x00-\\x7f]') AS w FROM documents)
SELECT doc_id, len(w)::INTEGER AS n_words,
       len(list_filter(w, lambda x: regexp_full_match(x, '[A-Za-z0-9'']+')))::INTEGER AS n_english FROM w""")
def q_english(spark, sf):
    """mixed-script words and how many of them are English."""
    d = T(spark, sf, "documents").select("doc_id", X.mixed_script_words("text").alias("w"))
    return d.select("doc_id", F.size("w").alias("n_words"), F.size(F.filter("w", X.is_english)).alias("n_english"))


PAIRS = """SELECT conv_id, turn, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS hyp
  FROM conversations"""


def _pairs(spark, sf):
    """A turn as the reference, the next one as the hypothesis."""
    c = T(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")  # a conversation has a few turns
    return c.select("conv_id", "turn", F.col("text").alias("ref"), F.lead("text").over(w).alias("hyp")) \
        .where(F.col("hyp").isNotNull() & F.col("ref").isNotNull())


def class_text_sql(name: str) -> str:
    """A letter for each word: its length class."""
    return (f"coalesce(list_aggregate(list_transform({WORDS.format(name)}, "
            f"lambda w: chr((65 + length(w) % 26)::INTEGER)), 'string_agg', ''), '')")


@register("word_distance", f"""
WITH p AS (SELECT conv_id, turn, {class_text_sql('ref')} AS r, {class_text_sql('hyp')} AS h FROM ({PAIRS})
           WHERE hyp IS NOT NULL AND ref IS NOT NULL)
SELECT conv_id, turn, length(r)::INTEGER AS ref_len, levenshtein(r, h)::BIGINT AS dist FROM p""")
def q_word_distance(spark, sf):
    """A8, word form: the word edit distance of each pair, words being their length class; few classes
    make for insertions, deletions and ties in every pair."""
    def classes(text):
        return F.array_join(F.transform(X.word_tokens(text), lambda w: F.char(F.length(w) % 26 + 65)), " ")
    p = _pairs(spark, sf).select("conv_id", "turn", classes("ref").alias("ref"), classes("hyp").alias("hyp"))
    d = S.wer_distance_detail(p, ["conv_id", "turn"], "ref", "hyp")
    return d.select("conv_id", "turn", "ref_len", F.col("dist").cast("long").alias("dist"))


IDS = "list_transform({}, lambda w: length(w) % 6 - 1)"


def collapsed_sql(name: str) -> str:
    ids = IDS.format(WORDS.format(name))
    return (f"list_filter(list_transform(range(1, len({ids}) + 1), lambda i: CASE WHEN i > 1 AND ({ids})[i] = ({ids})[i - 1] "
            f"THEN -1 ELSE ({ids})[i] END), lambda x: x > 0)")


def as_text_sql(name: str) -> str:
    return f"coalesce(list_aggregate(list_transform({name}, lambda x: chr(x::INTEGER + 64)), 'string_agg', ''), '')"


@register("ctc_distance", f"""
WITH p AS (SELECT conv_id, turn, {collapsed_sql('ref')} AS r, {collapsed_sql('hyp')} AS h FROM ({PAIRS})
           WHERE hyp IS NOT NULL AND ref IS NOT NULL)
SELECT conv_id, turn, len(r)::INTEGER AS ref_len, levenshtein({as_text_sql('r')}, {as_text_sql('h')})::INTEGER AS dist
FROM p WHERE len(r) > 0""")
def q_ctc_distance(spark, sf):
    """Ids (word length % 6 - 1, 0 the blank) collapsed, blanks and -1 dropped, empty references
    skipped, and the edit distance of what remains."""
    def ids(text):
        return F.transform(X.word_tokens(text), lambda w: F.length(w) % 6 - 1)

    def letters(x):
        return F.array_join(F.transform(x, lambda v: F.char(v + 64)), "")
    c = _pairs(spark, sf).select("conv_id", "turn", ids("ref").alias("ri"), ids("hyp").alias("hi"))
    c = c.select("conv_id", "turn", S.collapse_ctc(F.col("ri")).alias("r"), S.collapse_ctc(F.col("hi")).alias("h"))
    c = c.where(F.size("r") > 0).select("conv_id", "turn", F.size("r").alias("ref_len"), letters("r").alias("rt"),
                                        letters("h").alias("ht"))
    return c.select("conv_id", "turn", "ref_len", char_distance("ht", "rt").cast("int").alias("dist"))


@register("edit_prompt", """
SELECT conv_id, turn, '<s><|BOT|>system' || chr(10) || role || '<|EOT|><|BOT|>human' || chr(10) || 'say ' || turn::VARCHAR
       || chr(10) || trim(text, ' ') || chr(10) || '<|EOT|><|BOT|>assistant' || chr(10) AS prompt
FROM conversations WHERE text IS NOT NULL""")
def q_edit_prompt(spark, sf):
    """E2 as text: system prompt = the role, instruction = the turn number, audio tokens = the text."""
    c = T(spark, sf, "conversations").where(F.col("text").isNotNull())
    return c.select("conv_id", "turn", P.edit_prompt_text(
        F.col("role"), F.concat(F.lit("say "), F.col("turn").cast("string")), F.col("text")).alias("prompt"))


@register("language_map", """
WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang),
p AS (SELECT source, lang, round(n / sum(n) OVER (PARTITION BY source), 6) AS prob FROM c)
SELECT source, string_agg(lang || '=' || prob::VARCHAR, ' ' ORDER BY lang) AS probs,
       arg_max(lang, [prob, -ascii(lang)]) AS best FROM p GROUP BY source""")
def q_language_map(spark, sf):
    """The whole code -> probability map of each source, and its best code."""
    c = T(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("source")  # a row for each language of a source
    p = c.withColumn("prob", F.round(F.col("n") / F.sum("n").over(total), 6))
    m = p.groupBy("source").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lang", "prob")))).alias("m"))
    pairs = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    best = F.element_at(F.array_sort(F.map_entries("m"), lambda a, b: F.when(a["value"] > b["value"], -1).when(
        a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1)), 1)["key"]
    return m.select("source", F.array_join(pairs, " ").alias("probs"), best.alias("best"))


@Ex.register_op("tokenizer", "word")
def word_tokenizer(df, text, out):
    return df.withColumn(out, X.word_tokens(text))


@register("registered_tokenizer", f"""
SELECT doc_id, len({WORDS.format('text')})::INTEGER AS n, len(list_filter({WORDS.format('text')},
       lambda x: length(x) > 3))::INTEGER AS n_long FROM documents""")
def q_registered(spark, sf):
    """U1 + U2: a tokenizer looked up by name, as one step of a pipeline."""
    tokenize = Ex.lookup_op("tokenizer", "word")
    return Ex.pipeline(T(spark, sf, "documents").select("doc_id", "text"), [
        lambda df: tokenize(df, "text", "w"),
        lambda df: df.select("doc_id", F.size("w").alias("n"),
                             F.size(F.filter("w", lambda x: F.length(x) > 3)).alias("n_long"))])


@register("custom_tokenizer", """
SELECT doc_id, len(string_split(text, ','))::INTEGER AS n_parts, string_split(text, ',')[1] AS first_part FROM documents""")
def q_custom_tokenizer(spark, sf):
    """U4: a user's tokenizer function as an Arrow-batched UDF."""
    split = Ex.tokenizer_udf(lambda s: s.split(","))
    d = T(spark, sf, "documents").select("doc_id", split("text").alias("p"))
    return d.select("doc_id", F.size("p").alias("n_parts"), F.get("p", F.lit(0)).alias("first_part"))


@register("cmvn_text_roundtrip", """
WITH e AS (SELECT (t.dim - 1)::INTEGER AS dim, t.x::DOUBLE AS x FROM embeddings, unnest(embedding) WITH ORDINALITY AS t(x, dim))
SELECT dim, round(-avg(x), 6) AS shift, round(1.0 / sqrt(sum(x * x) / count(*) - avg(x) * avg(x)), 6) AS scale
FROM e GROUP BY dim""")
def q_cmvn_text(spark, sf):
    """K9 (affine text) -> S18: shift and scale written as a text file and read back."""
    from corpusvox.operators.features import global_cmvn
    root = _dir(spark, "cmvn-text")
    Sk.write_cmvn_text(global_cmvn(T(spark, sf, "embeddings"), "embedding"), root)
    back = K.read_cmvn_text(spark, root)
    return back.select("dim", F.round("shift", 6).alias("shift"), F.round("scale", 6).alias("scale"))


@register("feature_map_roundtrip", """
SELECT vec_id AS utt, CASE WHEN vec_id % 11 = 0 THEN 'no value' WHEN vec_id % 7 = 0 THEN 'dimension'
       WHEN vec_id % 5 = 0 THEN 'repeated key' ELSE 'ok' END AS state,
       CASE WHEN vec_id % 11 = 0 OR vec_id % 7 = 0 OR vec_id % 5 = 0 THEN NULL ELSE round(list_sum(embedding)::DOUBLE, 3) END AS total
FROM embeddings""")
def q_feature_map(spark, sf):
    """An utterance -> embedding table with missing, short and repeated entries, read with its checks."""
    from corpusvox.sources import manifest as Mf
    root = _dir(spark, "features")
    i = F.col("vec_id")
    e = T(spark, sf, "embeddings").select(i.alias("utt"), F.when(i % 11 != 0, F.when(
        i % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))).alias("vec"))
    again = e.where("utt % 5 = 0 AND utt % 11 <> 0 AND utt % 7 <> 0")
    e.unionByName(again).write.mode("overwrite").parquet(root)
    rows, rejects = Mf.read_feature_map(spark, root, "utt", "vec", 64)
    total = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return rows.select("utt", F.lit("ok").alias("state"), F.round(total, 3).alias("total")).unionByName(
        rejects.select("utt", F.col("reason").alias("state"), F.lit(None).cast("double").alias("total")))


@register("combine_results", f"""
WITH w AS (SELECT conv_id, turn, text, {WORDS.format('text')} AS w FROM conversations WHERE text IS NOT NULL),
x AS (SELECT conv_id, turn, i, word, turn * 60000 + (i - 1) * 200 AS beg, turn * 60000 + (i - 1) * 200 + 150 AS stop
      FROM w, unnest(w) WITH ORDINALITY AS t(word, i)),
l AS (SELECT conv_id, count(*)::INTEGER AS n_stamps, sum(beg)::BIGINT AS sum_beg, max(stop)::BIGINT AS last_end,
             md5(string_agg(word, '|' ORDER BY turn, i)) AS words_md5 FROM x GROUP BY conv_id),
t AS (SELECT conv_id, count(*)::INTEGER AS n_segments, md5(string_agg(text, ' ' ORDER BY turn)) AS text_md5 FROM w GROUP BY conv_id)
SELECT conv_id, n_segments, text_md5, n_stamps, sum_beg, last_end, words_md5 FROM t JOIN l USING (conv_id)""")
def q_combine_results(spark, sf):
    """Turns as segments a minute apart; texts, shifted word stamps and word lists combined."""
    from corpusvox.operators import segments as G
    c = T(spark, sf, "conversations").where(F.col("text").isNotNull()).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "text", (F.col("turn") * 60000).cast("long").alias("start"),
        X.word_tokens("text").alias("words"))
    stamps = F.transform("words", lambda w, i: F.struct((i * 200).cast("long").alias("beg"), (i * 200 + 150).cast("long").alias("end")))
    r = G.combine_results(c.withColumn("stamps", stamps), "conv_id", "turn", lists=["words"])
    return r.where(F.size("stamps") > 0).select(
        "conv_id", "n_segments", F.md5("text").alias("text_md5"), F.size("stamps").alias("n_stamps"),
        F.aggregate("stamps", F.lit(0).cast("long"), lambda acc, p: acc + p["beg"]).alias("sum_beg"),
        F.array_max(F.transform("stamps", lambda p: p["end"])).alias("last_end"),
        F.md5(F.array_join("words", "|")).alias("words_md5"))
