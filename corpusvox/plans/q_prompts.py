"""Prompt / edit-session queries.  Stand-ins: a conversation is an edit session,
turn = step; system turn = clone, user turn = paralinguistic edit (new text),
assistant turn = emotion edit (keeps the text).  Codec streams: per order, part
and supplier keys (mod 1024) in line order."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusvox.functions import codec as C
from corpusvox.functions.text import py_strip
from corpusvox.operators import prompts as P
from corpusvox.plans.registry import T, register

ROLES_SQL = """r AS (SELECT conv_id,
  arg_min(text, turn) FILTER (WHERE role = 'system') AS s, arg_min(text, turn) FILTER (WHERE role = 'user') AS h,
  arg_min(text, turn) FILTER (WHERE role = 'assistant') AS a FROM conversations GROUP BY conv_id)"""
CAL_TEXT_SQL = ("'system' || chr(10) || coalesce(s, '') || chr(10) || 'human' || chr(10) || coalesce(h, '') "
                "|| chr(10) || 'assistant' || chr(10) || coalesce(a, '')")


def _roles(spark, sf):
    c = T(spark, sf, "conversations")
    return P.session_roles(c, "conv_id", "turn", "role", "text")


@register("calibration_text", f"WITH {ROLES_SQL} SELECT conv_id, {CAL_TEXT_SQL} AS text FROM r")
def q_calibration_text(spark, sf):
    r = _roles(spark, sf)
    return r.select("conv_id", P.calibration_text("system", "user", "assistant").alias("text"))


@register("calibration_sample", f"""WITH {ROLES_SQL}
SELECT conv_id, {CAL_TEXT_SQL} AS text FROM r ORDER BY md5(conv_id::VARCHAR) LIMIT 50""")
def q_calibration_sample(spark, sf):
    """The first 50 sessions in a fixed hash order (the limit is the sampling feature)."""
    r = _roles(spark, sf)
    return r.orderBy(F.md5(F.col("conv_id").cast("string"))).limit(50) \
        .select("conv_id", P.calibration_text("system", "user", "assistant").alias("text"))


TYPES7 = ("clone", "emotion", "style", "vad", "denoise", "paralinguistic", "speed")


def _requests(spark, sf):
    c = T(spark, sf, "conversations")
    types = F.array(*[F.lit(t) for t in TYPES7])
    et = F.element_at(types, ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"))
    info = (F.when(et == "emotion", F.when(F.col("turn") % 2 == 0, "happy").otherwise("bored"))
            .when(et == "style", F.when(F.col("turn") % 3 == 0, "remove").otherwise("whisper"))
            .when(et == "speed", F.when(F.col("turn") % 2 == 0, "faster").otherwise("fast")))
    audio = F.when(F.col("role") != "system", F.format_string("audio/%d/%d.wav", "conv_id", "turn"))
    return c.select("conv_id", "turn", "text", et.alias("edit_type"), info.alias("edit_info"), audio.alias("audio"))


REQ_SQL = """q AS (SELECT conv_id, turn, text,
  ['clone','emotion','style','vad','denoise','paralinguistic','speed'][((conv_id + turn) % 7) + 1] AS edit_type, role
  FROM conversations),
q2 AS (SELECT *, CASE edit_type WHEN 'emotion' THEN CASE WHEN turn % 2 = 0 THEN 'happy' ELSE 'bored' END
                                WHEN 'style' THEN CASE WHEN turn % 3 = 0 THEN 'remove' ELSE 'whisper' END
                                WHEN 'speed' THEN CASE WHEN turn % 2 = 0 THEN 'faster' ELSE 'fast' END END AS edit_info,
              CASE WHEN role <> 'system' THEN 'audio/' || conv_id || '/' || turn || '.wav' END AS audio,
              regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS a FROM q)"""


@register("edit_requests", "WITH " + REQ_SQL + """
SELECT conv_id, turn, edit_type, edit_info,
  CASE WHEN edit_type IN ('emotion', 'style', 'speed') AND NOT (
            (edit_type = 'emotion' AND edit_info IN ('happy', 'remove'))
         OR (edit_type = 'style' AND edit_info IN ('remove', 'whisper'))
         OR (edit_type = 'speed' AND edit_info IN ('faster')))
       THEN 'unsupported option: ' || coalesce(edit_info, 'None')
       WHEN audio IS NULL OR trim(audio) = '' THEN 'audio is required'
       WHEN edit_type NOT IN ('denoise', 'vad') AND (text IS NULL OR trim(text) = '') THEN 'text is required'
  END AS error,
  CASE WHEN edit_type IN ('emotion', 'speed') AND edit_info = 'remove'
         THEN 'Remove any emotion in the following audio and the reference text is: ' || a || chr(10)
       WHEN edit_type IN ('emotion', 'speed')
         THEN 'Make the following audio more ' || edit_info || '. The text corresponding to the audio is: ' || a || chr(10)
       WHEN edit_type = 'style' AND edit_info = 'remove'
         THEN 'Remove any speaking styles in the following audio and the reference text is: ' || a || chr(10)
       WHEN edit_type = 'style'
         THEN 'Make the following audio more ' || edit_info || ' style. The text corresponding to the audio is: ' || a || chr(10)
       WHEN edit_type = 'denoise' THEN 'Remove any noise from the given audio while preserving the voice content clearly. Ensure that the speech quality remains intact with minimal distortion, and eliminate all noise from the audio.' || chr(10)
       WHEN edit_type = 'vad' THEN 'Remove any silent portions from the given audio while preserving the voice content clearly. Ensure that the speech quality remains intact with minimal distortion, and eliminate all silence from the audio.' || chr(10)
       WHEN edit_type = 'paralinguistic' THEN 'Add some non-verbal sounds to make the audio more natural, the new text is : ' || text || chr(10) || '  The text corresponding to the audio is: ' || a || chr(10)
  END AS instruction
FROM q2""")
def q_edit_requests(spark, sf):
    r = P.validate_requests(_requests(spark, sf))
    return r.select("conv_id", "turn", "edit_type", "edit_info", "error",
                    P.edit_instruction("text", "edit_type", "edit_info", "text").alias("instruction"))


def _chain(spark, sf):
    c = T(spark, sf, "conversations")
    et = F.when(F.col("role") == "system", "clone").when(F.col("role") == "user", "paralinguistic") \
        .otherwise("emotion")
    steps = c.select("conv_id", "turn", "text", et.alias("edit_type"), F.lit(None).cast("string").alias("edit_info"))
    return P.edit_chain(steps, "conv_id", "turn", "edit_type", "text")


CHAIN_SQL = """
e AS (SELECT conv_id, turn, text, CASE role WHEN 'system' THEN 'clone' WHEN 'user' THEN 'paralinguistic'
                                  ELSE 'emotion' END AS edit_type FROM conversations),
e1 AS (SELECT *, sum((edit_type = 'clone')::INTEGER) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
                 AS epoch,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM e),
e2 AS (SELECT *, last_value(CASE WHEN edit_type IN ('clone', 'paralinguistic') OR first THEN text END IGNORE NULLS)
                 OVER (PARTITION BY conv_id, epoch ORDER BY turn ROWS UNBOUNDED PRECEDING) AS target_text FROM e1),
chain AS (SELECT conv_id, turn, epoch::BIGINT AS epoch, edit_type,
                 coalesce(lag(target_text) OVER (PARTITION BY conv_id, epoch ORDER BY turn), text) AS source_text,
                 target_text FROM e2)"""


@register("edit_chain", "WITH " + CHAIN_SQL + " SELECT * FROM chain")
def q_edit_chain(spark, sf):
    return _chain(spark, sf).select("conv_id", "turn", "epoch", "edit_type", "source_text", "target_text")


@register("history_messages", "WITH " + CHAIN_SQL + """
SELECT conv_id, turn, 0 AS msg, 'user' AS role, '任务类型：' || edit_type || chr(10) || '文本：' || source_text AS content
FROM chain
UNION ALL SELECT conv_id, turn, 1, 'user', '[input audio]' FROM chain
UNION ALL SELECT conv_id, turn, 2, 'assistant', '输出音频：' || chr(10) || '文本：' || target_text FROM chain
UNION ALL SELECT conv_id, turn, 3, 'assistant', '[output audio]' FROM chain""")
def q_history(spark, sf):
    return P.history_messages(_chain(spark, sf), "conv_id", "turn")


NAMED = "CASE turn % 3 WHEN 0 THEN '（' || role || '）' || text WHEN 1 THEN '(' || conv_id || ') ' || text ELSE text END"


@register("instruction_names", f"""
SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN role WHEN 1 THEN conv_id::VARCHAR ELSE '' END AS name
FROM conversations""")
def q_instruction_names(spark, sf):
    """two of three turns are given a name in front, full-width or plain."""
    c = T(spark, sf, "conversations").withColumn("named", F.expr(NAMED))
    return c.select("conv_id", "turn", P.instruction_name("named").alias("name"))


@register("voice_ids", f"WITH {ROLES_SQL} SELECT conv_id, 'clone_' || sha256(coalesce(h, ''))[1:16] AS voice_id FROM r")
def q_voice_ids(spark, sf):
    r = _roles(spark, sf)
    return r.select("conv_id", P.voice_id(F.coalesce("user", F.lit(""))).alias("voice_id"))


@register("clone_prompts", f"""WITH {ROLES_SQL}
SELECT conv_id, md5('Generate audio with the following timbre, prosody and speaking style' || chr(10) || chr(10)
  || '[speaker_start]' || chr(10) || 'speaker name: ' || conv_id::VARCHAR || chr(10) || 'speaker prompt text: ' || chr(10)
  || coalesce(h, 'None') || chr(10) || 'speaker audio tokens: ' || chr(10) || '<audio_1>' || chr(10) || '[speaker_end]'
  || chr(10)) AS prompt_md5 FROM r""")
def q_clone_prompts(spark, sf):
    r = _roles(spark, sf)
    p = P.clone_system_prompt(F.col("conv_id").cast("string"), F.col("user"), F.lit("<audio_1>"))
    return r.select("conv_id", F.md5(p).alias("prompt_md5"))


CODEC_SQL = """
s AS (SELECT l_orderkey, list(l_partkey % 1024 ORDER BY l_linenumber, l_partkey, l_suppkey) AS v2,
             list(l_suppkey % 1024 ORDER BY l_linenumber, l_partkey, l_suppkey) AS v6 FROM lineitem GROUP BY l_orderkey),
g AS (SELECT *, least(len(v6) // 3, len(v2) // 2) AS ng FROM s),
m AS (SELECT *, CASE WHEN ng > 0 THEN flatten(list_transform(range(ng), lambda i: list_concat(
                   list_transform(v2[i * 2 + 1:i * 2 + 2], lambda x: x + 65536),
                   list_transform(v6[i * 3 + 1:i * 3 + 3], lambda x: x + 66560)))) ELSE []::BIGINT[] END AS mix,
             CASE WHEN ng > 0 THEN flatten(list_transform(range(ng), lambda i: list_concat(
                   v2[i * 2 + 1:i * 2 + 2], list_transform(v6[i * 3 + 1:i * 3 + 3], lambda x: x + 1024))))
                  ELSE []::BIGINT[] END AS mix0 FROM g),
f AS (SELECT *, (5 - len(mix) % 5) % 5 AS p FROM m),
f2 AS (SELECT *, list_concat(mix, [0, 0, 0, 1024, 1024, 1024][6 - p + 1:6]) AS fullm FROM f)"""


@register("codec_tokens", "WITH " + CODEC_SQL + """
SELECT l_orderkey, len(mix)::INTEGER AS n_mix,
       coalesce(list_sum(list_transform(mix, lambda x, k: x * k)), 0)::BIGINT AS mix_checksum,
       length(array_to_string(list_transform(mix0, lambda x: '<audio_' || x::VARCHAR || '>'), ''))::INTEGER AS str_len,
       coalesce(list_sum(list_transform(mix0, lambda x: x + 65536)), 0)::BIGINT AS parsed_sum,
       CASE WHEN len(fullm) > 0 THEN (coalesce(list_sum(list_filter(fullm, lambda x, i: (i - 1) % 5 < 2)), 0)
                                     + 1024 * (len(fullm) // 5))::BIGINT END AS a_sum,
       CASE WHEN len(fullm) > 0 THEN (coalesce(list_sum(list_filter(fullm, lambda x, i: (i - 1) % 5 >= 2)), 0)
                                     + 3 * (len(fullm) // 5))::BIGINT END AS b_sum
FROM f2""")
def q_codec(spark, sf):
    li = T(spark, sf, "lineitem")
    s = li.groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey",
                                             (F.col("l_partkey") % 1024).alias("v")))).alias("_a"),
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey",
                                             (F.col("l_suppkey") % 1024).alias("v")))).alias("_b"))
    s = s.select("l_orderkey", F.transform("_a", lambda x: x["v"]).alias("v2"),
                 F.transform("_b", lambda x: x["v"]).alias("v6"))
    mix = C.interleave_streams("v2", "v6")
    s = s.select("l_orderkey", mix.alias("mix"), C.render_audio_tokens("v2", "v6").alias("tok"))
    s = s.select("l_orderkey", "mix", "tok", C.parse_audio_tokens("tok").alias("parsed"),
                 C.deinterleave("mix").alias("pairs"))
    add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return s.select(
        "l_orderkey", F.size("mix").alias("n_mix"),
        add(F.transform("mix", lambda x, i: x * (i + 1))).alias("mix_checksum"),
        F.length("tok").alias("str_len"), add(F.col("parsed")).alias("parsed_sum"),
        add(F.transform("pairs", lambda p: p["a"])).alias("a_sum"),
        add(F.transform("pairs", lambda p: p["b"])).alias("b_sum"))
