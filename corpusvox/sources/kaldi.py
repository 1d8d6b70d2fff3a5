"""Line-oriented corpus files (S1-S6, S14-S17, S19) read as DataFrames.

Every reader is ``spark.read.text`` plus column expressions.  The file line number (needed for
"last line wins" and for line-indexed vocabularies) is made of the file's place in path order,
the block a line was read from, and its place in that block; see ``read_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusvox.functions.text import WS_CLASS, WS_RUN, py_strip

_SPLIT_ONCE = f"^{WS_CLASS}*(\\S+){WS_CLASS}+(.*?){WS_CLASS}*$"


def read_lines(spark: SparkSession, path: str | list[str], with_index: bool = False) -> DataFrame:
    """(line[, line_no]) -- line_no is the 0-based position over the files in path order.

    Spark packs files into tasks by size, so task order is not path order.  A read block (a
    part of one file) is never divided among tasks, and ids rise along it; one row per block
    (first id and line count, ordered by file and offset) gives each block its first line
    number.  Lines themselves are neither shuffled nor sorted."""
    df = spark.read.text(path).withColumnRenamed("value", "line")
    if not with_index:
        return df
    placed = df.select("line", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_id"))
    blocks = placed.groupBy("_file", "_at").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)  # one row per read block
    blocks = blocks.select("_file", "_at", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(blocks), ["_file", "_at"]).select(
        "line", (F.col("_before") + F.col("_id") - F.col("_first")).alias("line_no"))


def split_once(lines: DataFrame, key: str = "utt", value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Strip, skip blank lines, split once on whitespace; lines without a value
    go to the second (rejects) DataFrame."""
    x = lines.where(py_strip("line") != "")
    m = F.regexp_extract("line", _SPLIT_ONCE, 1)
    v = F.regexp_extract("line", _SPLIT_ONCE, 2)
    ok = F.col("line").rlike(_SPLIT_ONCE) & (v != "")
    keep = [c for c in x.columns if c != "line"]
    good = x.where(ok).select(m.alias(key), v.alias(value), *keep)
    bad = x.where(~ok).select("line", *keep)
    return good, bad


def read_keyed_text(spark: SparkSession, path: str, key: str = "utt", value: str = "value",
                    last_wins: bool = True) -> DataFrame:
    """S1 wav.scp / text: key -> rest of line; a duplicate key keeps its last line."""
    good, _ = split_once(read_lines(spark, path, with_index=last_wins), key, value)
    if not last_wins:
        return good
    return good.groupBy(key).agg(F.max_by(value, "line_no").alias(value))


def read_utt2spk(spark: SparkSession, path: str) -> DataFrame:
    """Exactly two whitespace-separated fields, else skipped; last line wins."""
    x = read_lines(spark, path, with_index=True)
    parts = F.filter(F.split(py_strip("line"), WS_RUN), lambda p: p != "")
    x = x.select(parts.alias("p"), "line_no").where(F.size("p") == 2)
    return x.groupBy(F.col("p")[0].alias("utt")).agg(F.max_by(F.col("p")[1], "line_no").alias("spk"))


def read_key_list(spark: SparkSession, path: str, key: str = "spk", values: str = "utts") -> DataFrame:
    """Key followed by a list of values (spk2utt, segmentation dictionary)."""
    parts = F.filter(F.split(py_strip("line"), WS_RUN), lambda p: p != "")
    x = read_lines(spark, path).select(parts.alias("p")).where(F.size("p") >= 1)
    return x.select(F.col("p")[0].alias(key), F.slice("p", 2, F.size("p")).alias(values))


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """Utt rec start end (seconds)."""
    parts = F.filter(F.split(py_strip("line"), WS_RUN), lambda p: p != "")
    x = read_lines(spark, path).select(parts.alias("p")).where(F.size("p") == 4)
    return x.select(F.col("p")[0].alias("utt"), F.col("p")[1].alias("rec"),
                    F.col("p")[2].cast("double").alias("st"), F.col("p")[3].cast("double").alias("et"))


def segments_by_utt(segments: DataFrame) -> DataFrame:
    """S4 by utterance: utt -> (rec, st, et); of a repeated utt the last start wins."""
    return segments.groupBy("utt").agg(F.max_by(F.struct("rec", "st", "et"), F.struct("st", "et", "rec")).alias("s")) \
        .select("utt", "s.rec", "s.st", "s.et")


def segments_by_rec(segments: DataFrame) -> DataFrame:
    """S4 by recording: rec -> its segments (utt, st, et) in order of start.  The row is the
    recording's segment list, as the format has it; ``read_segments`` is the long form."""
    return segments.groupBy("rec").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("st", "et", "utt"))),
        lambda s: F.struct(s["utt"].alias("utt"), s["st"].alias("st"), s["et"].alias("et"))).alias("segments"))


def read_reco2dur(spark: SparkSession, path: str) -> DataFrame:
    """Rec -> duration (seconds)."""
    good, _ = split_once(read_lines(spark, path), "rec", "dur")
    return good.select("rec", F.col("dur").cast("double").alias("dur"))


def read_scp(spark: SparkSession, path: str, value_type: str = "str", kv_sep: str | None = None) -> DataFrame:
    """Generic scp with an optional key separator; ``list`` values split on whitespace."""
    x = read_lines(spark, path).where(py_strip("line") != "")
    if kv_sep is None:
        good, _ = split_once(x, "key", "value")
    else:
        line = py_strip("line")
        good = x.select(F.substring_index(line, kv_sep, 1).alias("key"),
                        F.expr(f"substr(line, length(substring_index(line, '{kv_sep}', 1)) + {len(kv_sep) + 1})")
                        .alias("value"))
    if value_type == "list":
        good = good.withColumn("value", F.filter(F.split(py_strip("value"), WS_RUN), lambda p: p != ""))
    return good


def read_vocabulary(spark: SparkSession, path: str, unk: str = "<unk>") -> DataFrame:
    """One token per line, id = line number; a duplicate token or a missing
    unk symbol is an error (checked with two small aggregates)."""
    x = read_lines(spark, path, with_index=True).select(F.col("line_no").cast("int").alias("id"),
                                                        F.regexp_replace("line", r"[\r\n]+$", "").alias("token"))
    dups = x.groupBy("token").count().where(F.col("count") > 1).limit(1).collect()
    if dups:
        raise ValueError(f"duplicate symbol in vocabulary: {dups[0]['token']!r}")
    if not x.where(F.col("token") == unk).limit(1).collect():
        raise ValueError(f"{unk!r} is not in the vocabulary")
    return x


def read_hotwords(spark: SparkSession, source: str, is_file: bool = True) -> DataFrame:
    """Hotwords from a file (one per line) or a whitespace-separated string,
    with the sentinel '<s>' appended last."""
    if is_file:
        words = read_lines(spark, source, with_index=True).select(py_strip("line").alias("word"), "line_no") \
            .where(F.col("word") != "")
    else:
        words = spark.createDataFrame([(w, i) for i, w in enumerate(source.split())], "word string, line_no long")
    sentinel = spark.createDataFrame([("<s>", 2 ** 62)], "word string, line_no long")
    return words.unionByName(sentinel)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """S17 trials: 'utt1 utt2 target|nontarget' -> label 1/0 (last field decides)."""
    parts = F.filter(F.split(py_strip("line"), WS_RUN), lambda p: p != "")
    x = read_lines(spark, path, with_index=True).select(parts.alias("p"), "line_no").where(F.size("p") >= 3)
    return x.select(F.col("p")[0].alias("utt1"), F.col("p")[1].alias("utt2"),
                    (F.element_at("p", -1) == "target").cast("int").alias("label"), "line_no")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """S17 scores: 'utt1 utt2 score' (score = last field)."""
    parts = F.filter(F.split(py_strip("line"), WS_RUN), lambda p: p != "")
    x = read_lines(spark, path, with_index=True).select(parts.alias("p"), "line_no").where(F.size("p") >= 3)
    return x.select(F.col("p")[0].alias("utt1"), F.col("p")[1].alias("utt2"),
                    F.element_at("p", -1).cast("double").alias("score"), "line_no")


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """Key, feature path, label path."""
    parts = F.filter(F.split(py_strip("line"), WS_RUN), lambda p: p != "")
    x = read_lines(spark, path).select(parts.alias("p")).where(F.size("p") == 3)
    return x.select(F.col("p")[0].alias("key"), F.col("p")[1].alias("feat"), F.col("p")[2].alias("label"))


def read_cmvn_text(spark: SparkSession, path: str) -> DataFrame:
    """(dim, shift, scale) from the '<AddShift>' / '<Rescale>' blocks of an affine text file."""
    whole = spark.read.text(path, wholetext=True).select(F.col("value").alias("t"))
    num = r"\[([^\]]*)\]"
    shift = F.regexp_extract("t", r"<AddShift>[^\[]*" + num, 1)
    scale = F.regexp_extract("t", r"<Rescale>[^\[]*" + num, 1)
    vals = lambda s: F.transform(F.filter(F.split(F.trim(s), WS_RUN), lambda p: p != ""),
                                 lambda p: p.cast("double"))
    x = whole.select(vals(shift).alias("shift"), vals(scale).alias("scale"))
    return x.select(F.posexplode(F.arrays_zip("shift", "scale")).alias("dim", "z")) \
        .select("dim", F.col("z.shift").alias("shift"), F.col("z.scale").alias("scale"))
