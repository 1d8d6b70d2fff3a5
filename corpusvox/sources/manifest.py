"""Manifest, index and media scans."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusvox.sources.kaldi import read_lines

MANIFEST_JSON = T.StructType([T.StructField(n, T.StringType()) for n in
                              ("audio_path", "wav", "path", "text", "transcript", "speaker_id", "spk",
                               "utt_id", "utt")])


def _nz(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def read_manifest_jsonl(spark: SparkSession, path: str, default_speaker: str = "default_speaker"
                        ) -> tuple[DataFrame, DataFrame]:
    """JSONL manifest with alias fallback (audio_path|wav|path, text|transcript,
    speaker_id|spk|default, utt_id|utt|utt_%06d of the line index); empty strings
    count as missing.  Returns (rows, bad lines) -- bad JSON or missing audio/text."""
    lines = read_lines(spark, path, with_index=True).where(F.trim("line") != "")
    j = lines.select("line", "line_no", F.from_json("line", MANIFEST_JSON, {"mode": "PERMISSIVE"}).alias("j"),
                     F.get_json_object("line", "$").isNotNull().alias("_valid"))
    j = j.select("line", "line_no", "_valid", "j.*")
    out = j.select(
        "line_no", "_valid", "line",
        F.coalesce(_nz("utt_id"), _nz("utt"), F.format_string("utt_%06d", F.col("line_no"))).alias("utt"),
        F.coalesce(_nz("audio_path"), _nz("wav"), _nz("path")).alias("wav"),
        F.coalesce(_nz("text"), _nz("transcript")).alias("text"),
        F.coalesce(_nz("speaker_id"), _nz("spk"), F.lit(default_speaker)).alias("spk"))
    ok = F.col("_valid") & F.col("wav").isNotNull() & F.col("text").isNotNull()
    return out.where(ok).drop("_valid", "line"), out.where(~ok).select("line_no", "line")


INDEX_SCHEMA = T.StructType([T.StructField("key", T.StringType()), T.StructField("prompt", T.StringType()),
                             T.StructField("source", T.StringType()), T.StructField("target", T.StringType()),
                             T.StructField("source_len", T.IntegerType()),
                             T.StructField("target_len", T.IntegerType())])


def read_index_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Index records with defaults prompt '<ASR>', source_len 1, target_len 0."""
    x = spark.read.schema(INDEX_SCHEMA).json(path)
    return x.select("key", F.coalesce("prompt", F.lit("<ASR>")).alias("prompt"), "source", "target",
                    F.coalesce("source_len", F.lit(1)).alias("source_len"),
                    F.coalesce("target_len", F.lit(0)).alias("target_len"))


def read_inputs(spark: SparkSession, path: str, data_type: str = "source") -> DataFrame:
    """Resolve an input file by extension: .jsonl -> {key, source}; .scp/.txt ->
    'key data' or 'data' lines.  A missing key is a deterministic hash of
    (file, line) instead of a random string."""
    if path.endswith(".jsonl"):
        lines = read_lines(spark, path, with_index=True)
        j = lines.select("line_no", F.get_json_object("line", "$.key").alias("key"),
                         F.get_json_object("line", f"$.{data_type}").alias("data"))
    else:
        lines = read_lines(spark, path, with_index=True).where(F.trim("line") != "")
        parts = F.split(F.trim("line"), r"\s+", 2)
        j = lines.select("line_no", F.when(F.size(parts) == 2, parts[0]).alias("key"),
                         F.when(F.size(parts) == 2, parts[1]).otherwise(parts[0]).alias("data"))
    gen = F.concat(F.lit("rand_key_"), F.substring(F.sha2(F.concat_ws(":", F.lit(path), F.col("line_no")), 256), 1, 13))
    return j.select(F.coalesce("key", gen).alias("key"), "data", "line_no")


def _bare(path: Column) -> Column:
    """A path without its scheme, for comparison."""
    return F.regexp_replace(F.trim(path), r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def read_parquet_list(spark: SparkSession, list_path: str, schema: T.StructType | str | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """A text file names Parquet files; unreadable or missing ones are skipped.

    Returns (rows, rejects): rejects lists the named files that gave no row.  Only the distinct
    folders of the list come to the driver; the files are matched by a join on their path."""
    listed = read_lines(spark, list_path).where(F.trim("line") != "").select(
        F.col("line").alias("path"), _bare(F.col("line")).alias("_bare")).distinct()
    folder = F.regexp_replace(F.trim("path"), "/[^/]*$", "")
    folders = [r[1] for r in listed.groupBy(_bare(folder)).agg(F.max(folder)).collect()]
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    # without a schema all footers are read for it, as any single file may be a broken one
    reader = reader.schema(schema) if schema else reader.option("mergeSchema", "true")
    files = (reader.parquet(*folders).withColumn("_path", _bare(F.col("_metadata.file_path"))))
    named = listed.select("_bare")
    rows = files.join(named, F.col("_path") == F.col("_bare"), "left_semi").drop("_path")
    seen = files.select("_path").distinct()
    rejects = listed.join(seen, F.col("_bare") == F.col("_path"), "left_anti").select("path")
    return rows, rejects


def read_feature_map(spark: SparkSession, path: str, key: str, value: str, dim: int | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """A precomputed feature table (utt -> embedding, spk -> embedding, utt -> tokens) as Parquet.

    Returns (rows, rejects): a row needs a key and a value, of ``dim`` items where that is given, and
    a key that no other valid row has; rejects (key, reason) lists the others, a repeated key once."""
    x = spark.read.parquet(path).select(F.col(key), F.col(value))
    wrong = F.lit(False) if dim is None else F.size(value) != dim
    reason = F.when(F.col(key).isNull(), "no key").when(F.col(value).isNull(), "no value").when(wrong, "dimension")
    x = x.withColumn("_reason", reason)
    good, bad = x.where(F.col("_reason").isNull()), x.where(F.col("_reason").isNotNull())
    twice = good.groupBy(key).count().where(F.col("count") > 1).select(key)
    rejects = bad.select(key, F.col("_reason").alias("reason")).unionByName(
        twice.select(key, F.lit("repeated key").alias("reason")))
    return good.drop("_reason").join(twice, key, "left_anti"), rejects


def read_by_extension(spark: SparkSession, path: str) -> DataFrame:
    """Json / jsonl / csv / parquet file or a directory of parquet."""
    p = path.lower()
    if p.endswith((".json", ".jsonl")):
        return spark.read.json(path)
    if p.endswith(".csv"):
        return spark.read.option("header", "true").csv(path)
    return spark.read.parquet(path)


def scan_audio_dir(spark: SparkSession, root: str, ext: str = "wav", default_speaker: str = "default_speaker"
                   ) -> DataFrame:
    """Recursive listing (file contents are not read).  Nested files: speaker =
    first directory under root, utt = speaker_stem; flat files: speaker = stem
    part before the first '_' (else default), utt = stem.  Colliding utt: the
    last path in sort order wins."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", f"*.{ext}").load(root).select("path"))
    rel = F.regexp_replace("path", "^.*?" + root.rstrip("/").split("://")[-1] + "/", "")
    parts = F.split(rel, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    nested = F.size(parts) > 1
    spk = F.when(nested, parts[0]).when(F.instr(stem, "_") > 0, F.substring_index(stem, "_", 1)) \
        .otherwise(F.lit(default_speaker))
    utt = F.when(nested, F.concat(parts[0], F.lit("_"), stem)).otherwise(stem)
    x = files.select(F.col("path").alias("wav"), utt.alias("utt"), spk.alias("spk"), stem.alias("stem"),
                     F.regexp_replace("path", r"/[^/]*$", "").alias("dir"))
    return x.groupBy("utt").agg(F.max_by(F.struct("wav", "spk", "stem", "dir"), "wav").alias("r")) \
        .select("utt", "r.*")


# Sidecar transcript extensions in priority order.
SIDECAR_EXTS = (".txt", ".lab", ".trans", ".text")


def attach_sidecar_text(audio: DataFrame, spark: SparkSession, root: str) -> DataFrame:
    """Transcript from a file next to the audio with the same stem, by extension
    priority; audio without any transcript is dropped."""
    globs = ",".join(f"*{e}" for e in SIDECAR_EXTS)
    t = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
         .option("pathGlobFilter", "{" + globs + "}").load(root).select("path", "content"))
    ext = F.regexp_extract("path", r"(\.[^./]*)$", 1)
    rank = F.array_position(F.array(*[F.lit(e) for e in SIDECAR_EXTS]), ext)
    t = t.select(F.regexp_replace("path", r"/[^/]*$", "").alias("dir"),
                 F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("stem"),
                 rank.alias("rank"), F.trim(F.decode("content", "UTF-8")).alias("text"))
    best = t.withColumn("_r", F.row_number().over(Window.partitionBy("dir", "stem").orderBy("rank"))) \
        .where("_r = 1").drop("_r", "rank")
    return audio.join(best, ["dir", "stem"], "inner")


EDIT_PAIR = T.StructType([T.StructField(n, T.StringType()) for n in
                          ("prompt_audio_path", "prompt_text", "target_text", "target_audio_path", "edit_type",
                           "speaker_id")])


def read_edit_pairs(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Paired edit records; both audio paths must be present and (when a file
    listing is given) exist -- a semi join against the listing."""
    x = spark.read.schema(EDIT_PAIR).json(path).where(
        F.col("prompt_audio_path").isNotNull() & F.col("target_audio_path").isNotNull())
    if existing is not None:
        paths = existing.select(F.col("path").alias("_p"))
        x = x.join(paths, x["prompt_audio_path"] == paths["_p"], "left_semi")
        x = x.join(paths, x["target_audio_path"] == paths["_p"], "left_semi")
    return x


@F.pandas_udf(T.ArrayType(T.FloatType()))
def pcm16_to_float(b: pd.Series) -> pd.Series:
    """Little-endian PCM16 bytes -> float samples in [-1, 1)."""
    return b.map(lambda x: None if x is None else (np.frombuffer(x[: len(x) // 2 * 2], dtype="<i2")
                                                   .astype(np.float32) / 32768.0))
