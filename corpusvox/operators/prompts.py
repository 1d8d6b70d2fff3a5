"""Prompt and edit-session datasets.

Sessions are keyed tables ordered by step; chains that read the previous
step's output are lag / forward-fill expressions through ``plans.sequence``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvox.functions.text import py_strip
from corpusvox.plans.sequence import B, range_buckets, seq_cumsum, seq_ffill, seq_lag

# Supported edit types and their options.
EDIT_OPTIONS: dict[str, tuple[str, ...]] = {
    "clone": (),
    "emotion": ("happy", "angry", "sad", "humour", "confusion", "disgusted", "empathy", "embarrass", "fear",
                "surprised", "excited", "depressed", "coldness", "admiration", "remove"),
    "style": ("serious", "arrogant", "child", "older", "girl", "pure", "sister", "sweet", "ethereal", "whisper",
              "gentle", "recite", "generous", "act_coy", "warm", "shy", "comfort", "authority", "chat", "radio",
              "soulful", "story", "vivid", "program", "news", "advertising", "roar", "murmur", "shout", "deeply",
              "loudly", "remove", "exaggerated"),
    "vad": (),
    "denoise": (),
    "paralinguistic": (),
    "speed": ("faster", "slower", "more faster", "more slower"),
}

# Instruction templates by edit type ({a} = audio text, {i} = option, {t} = new text).
INSTRUCTIONS = {
    "remove_emotion": "Remove any emotion in the following audio and the reference text is: {a}\n",
    "emotion": "Make the following audio more {i}. The text corresponding to the audio is: {a}\n",
    "remove_style": "Remove any speaking styles in the following audio and the reference text is: {a}\n",
    "style": "Make the following audio more {i} style. The text corresponding to the audio is: {a}\n",
    "denoise": ("Remove any noise from the given audio while preserving the voice content clearly. Ensure that "
                "the speech quality remains intact with minimal distortion, and eliminate all noise from the "
                "audio.\n"),
    "vad": ("Remove any silent portions from the given audio while preserving the voice content clearly. Ensure "
            "that the speech quality remains intact with minimal distortion, and eliminate all silence from the "
            "audio.\n"),
    "paralinguistic": ("Add some non-verbal sounds to make the audio more natural, the new text is : {t}\n"
                       "  The text corresponding to the audio is: {a}\n"),
}

# History message labels ("task type", "text", "output audio").
HISTORY_LABELS = ("任务类型：", "文本：", "输出音频：")

# Clone system prompt template.
CLONE_SYSTEM_TEMPLATE = ("Generate audio with the following timbre, prosody and speaking style\n\n"
                         "[speaker_start]\nspeaker name: {speaker}\nspeaker prompt text: \n{prompt_text}\n"
                         "speaker audio tokens: \n{prompt_wav_tokens}\n[speaker_end]\n")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fill(template: str, **cols: Column) -> Column:
    """Render a template with {name} holes from columns (literal text elsewhere)."""
    parts, rest = [], template
    while rest:
        i = rest.find("{")
        if i < 0:
            parts.append(F.lit(rest))
            break
        j = rest.index("}", i)
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(cols[rest[i + 1:j]].cast("string"), F.lit("None")))
        rest = rest[j + 1:]
    return F.concat(*parts)


def calibration_text(system, human, assistant) -> Column:
    """E1: 'system\\n{s}\\nhuman\\n{h}\\nassistant\\n{a}'; missing parts are empty;
    an array-valued assistant part renders as '[a, b, ...]'."""
    def part(x):
        return F.coalesce(_c(x).cast("string"), F.lit(""))  # an array casts to '[a, b, ...]'
    return F.concat(F.lit("system\n"), part(system), F.lit("\nhuman\n"), part(human),
                    F.lit("\nassistant\n"), part(assistant))


def session_roles(turns: DataFrame, session: str, step: str, role: str, text: str,
                  roles: Sequence[str] = ("system", "user", "assistant")) -> DataFrame:
    """Pivot a session's first turn of each role into columns (partial aggregates)."""
    return turns.groupBy(session).agg(*[
        F.min_by(F.when(F.col(role) == r, F.col(text)), F.when(F.col(role) == r, F.col(step))).alias(r)
        for r in roles])


def edit_instruction(audio_text, edit_type, edit_info, text) -> Column:
    """instruction prefix by edit type (NULL for an unsupported type)."""
    a = F.coalesce(py_strip(_c(audio_text)), F.lit(""))
    t, i, info = _c(edit_type), _c(edit_info), _c(text)
    return (F.when(t.isin("emotion", "speed") & (i == "remove"), _fill(INSTRUCTIONS["remove_emotion"], a=a))
            .when(t.isin("emotion", "speed"), _fill(INSTRUCTIONS["emotion"], a=a, i=i))
            .when((t == "style") & (i == "remove"), _fill(INSTRUCTIONS["remove_style"], a=a))
            .when(t == "style", _fill(INSTRUCTIONS["style"], a=a, i=i))
            .when(t == "denoise", F.lit(INSTRUCTIONS["denoise"]))
            .when(t == "vad", F.lit(INSTRUCTIONS["vad"]))
            .when(t == "paralinguistic", _fill(INSTRUCTIONS["paralinguistic"], a=a, t=info)))


def instruction_name(text) -> Column:
    """name inside a leading (...) or full-width （...） group, else ''."""
    g = F.regexp_extract(_c(text), r"(?s)^([（(][^()（）]*[）)]).*$", 1)
    return F.regexp_replace(g, r"^[()（）]+|[()（）]+$", "")


def voice_id(text, audio_bytes: Column | None = None) -> Column:
    """'clone_' + first 16 hex digits of SHA-256(text bytes || audio sample bytes)."""
    data = F.encode(_c(text), "UTF-8")
    if audio_bytes is not None:
        data = F.concat(data, audio_bytes)
    return F.concat(F.lit("clone_"), F.substring(F.sha2(data, 256), 1, 16))


def taxonomy(spark) -> DataFrame:
    """The (edit_type, option) table; types without options have option NULL."""
    rows = [(t, o) for t, opts in EDIT_OPTIONS.items() for o in (opts or (None,))]
    return spark.createDataFrame(rows, "edit_type string, option string")


def validate_requests(req: DataFrame, edit_type: str = "edit_type", edit_info: str = "edit_info",
                      audio: str = "audio", text: str = "text", cli_rules: bool = True) -> DataFrame:
    """P5 + P6: add ``error`` (NULL when valid).  Unknown type or option fails;
    audio is always required; the CLI rules also need text except for
    denoise/vad.  The option check is a left-anti join against the small,
    fixed taxonomy table (broadcast)."""
    tax = taxonomy(req.sparkSession)
    types = F.broadcast(tax.select(F.col("edit_type").alias("_t")).distinct().withColumn("_type_ok", F.lit(True)))
    opts = F.broadcast(tax.where(F.col("option").isNotNull()).select(
        F.col("edit_type").alias("_t"), F.col("option").alias("_o")).withColumn("_opt_ok", F.lit(True)))
    has_opts = F.broadcast(tax.groupBy(F.col("edit_type").alias("_t")).agg(
        F.max(F.col("option").isNotNull()).alias("_needs_opt")))
    x = req.join(types, req[edit_type] == types["_t"], "left").drop("_t")
    x = x.join(has_opts, x[edit_type] == has_opts["_t"], "left").drop("_t")
    x = x.join(opts, (x[edit_type] == opts["_t"]) & (x[edit_info] == opts["_o"]), "left").drop("_t", "_o")
    err = (F.when(F.col("_type_ok").isNull(), F.concat(F.lit("unsupported edit_type: "), F.col(edit_type)))
           .when(F.col("_needs_opt") & F.col("_opt_ok").isNull(),
                 F.concat(F.lit("unsupported option: "), F.coalesce(F.col(edit_info), F.lit("None"))))
           .when(F.col(audio).isNull() | (F.trim(F.col(audio)) == ""), F.lit("audio is required")))
    if cli_rules:
        err = err.when(~F.col(edit_type).isin("denoise", "vad") & (F.col(text).isNull() | (F.trim(F.col(text)) == "")),
                       F.lit("text is required"))
    return x.withColumn("error", err).drop("_type_ok", "_needs_opt", "_opt_ok")


def edit_chain(steps: DataFrame, session: str, step: str, edit_type: str, text: str) -> DataFrame:
    """A clone starts a new history epoch; inside an epoch the source of a
    step is the previous step's target; paralinguistic edits (and clones, and
    the session's first step) set a new text, other edits keep the text."""
    # One bucketing serves all passes.  The first row of an epoch always sets the text, so filling
    # forward along the session never reaches back over an epoch's start.
    x = range_buckets(steps, [session], [step])
    x = seq_cumsum(x.withColumn("_clone", (F.col(edit_type) == "clone").cast("long")), [session], [step],
                   {"epoch": F.col("_clone"), "_rn": F.lit(1).cast("long")})
    starts = (F.col("_rn") == 1) | F.coalesce(F.col(edit_type) == "clone", F.lit(False))
    sets_text = starts | F.coalesce(F.col(edit_type) == "paralinguistic", F.lit(False))
    x = seq_ffill(x.withColumn("_val", F.when(sets_text, F.struct(F.col(text).alias("t")))), [session], [step],
                  "_val", "_filled").withColumn("target_text", F.col("_filled")["t"])
    x = seq_lag(x, [session], [step], ["target_text"], suffix="_prev").drop(B)
    source = F.when(starts, F.col(text)).otherwise(F.coalesce(F.col("target_text_prev"), F.col(text)))
    return x.withColumn("source_text", source).drop("_clone", "_val", "_filled", "_rn", "target_text_prev")


def history_messages(chain: DataFrame, session: str, step: str, edit_type: str = "edit_type",
                     edit_info: str = "edit_info") -> DataFrame:
    """E5: four display messages per step: task line, input audio, output line, output audio."""
    type_str = F.when(F.col(edit_info).isNotNull(), F.concat_ws("-", F.col(edit_type), F.col(edit_info))) \
        .otherwise(F.col(edit_type))
    task, text_l, out_l = HISTORY_LABELS
    msgs = F.array(
        F.struct(F.lit(0).alias("msg"), F.lit("user").alias("role"),
                 F.concat(F.lit(task), type_str, F.lit("\n" + text_l), F.col("source_text")).alias("content")),
        F.struct(F.lit(1).alias("msg"), F.lit("user").alias("role"), F.lit("[input audio]").alias("content")),
        F.struct(F.lit(2).alias("msg"), F.lit("assistant").alias("role"),
                 F.concat(F.lit(out_l + "\n" + text_l), F.col("target_text")).alias("content")),
        F.struct(F.lit(3).alias("msg"), F.lit("assistant").alias("role"), F.lit("[output audio]").alias("content")))
    return chain.select(session, step, F.explode(msgs).alias("m")).select(session, step, "m.msg", "m.role",
                                                                         "m.content")


def clone_system_prompt(speaker, prompt_text, wav_tokens) -> Column:
    """The clone system prompt from the speaker template."""
    return _fill(CLONE_SYSTEM_TEMPLATE, speaker=_c(speaker), prompt_text=_c(prompt_text),
                 prompt_wav_tokens=_c(wav_tokens))


def edit_prompt_text(sys_prompt, instruct_prefix, audio_tokens) -> Column:
    """E2 as text: role blocks 'system\\n…', 'human\\n{instruction}\\n{audio}\\n', 'assistant\\n'
    (token ids 1/4/3 mark start, block open and block close once tokenized)."""
    return F.concat(F.lit("<s><|BOT|>system\n"), _c(sys_prompt), F.lit("<|EOT|><|BOT|>human\n"),
                    _c(instruct_prefix), F.lit("\n"), F.trim(_c(audio_tokens)),
                    F.lit("\n<|EOT|><|BOT|>assistant\n"))

