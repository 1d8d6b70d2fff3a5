"""Writers (K1-K4, K7, K9-K12).  Every sink is a DataFrame write; row order
inside files comes from a range-partitioned sort, not from the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusvox.functions.text import WS_RUN, py_strip
from corpusvox.plans.sequence import B as BUCKET
from corpusvox.plans.sequence import seq_row_number
from corpusvox.session import cut_lineage


def _one_line(c) -> F.Column:
    """Flatten whitespace runs (including newlines) to single spaces for line files."""
    return py_strip(F.regexp_replace(c, WS_RUN, " "))


def write_keyed_text(df: DataFrame, key: str, value: str, path: str, partitions: int | None = None) -> None:
    """K1 file: 'key value' lines, globally sorted by key (range partitioned)."""
    out = df.select(F.concat_ws(" ", F.col(key).cast("string"), _one_line(F.col(value).cast("string")))
                    .alias("value"), F.col(key).cast("string").alias("_k"))
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    out.repartitionByRange(n, "_k").sortWithinPartitions("_k").select("value") \
        .write.mode("overwrite").text(path)


def write_kaldi_dir(utts: DataFrame, path: str, wav: str = "wav", text: str = "text", spk: str = "spk") -> None:
    """K1: wav.scp, text, utt2spk sorted by utt; spk2utt lines with sorted utts.

    A spk2utt line is one row per speaker by the file format; the utterance lists
    are built with a sorted collect per speaker."""
    write_keyed_text(utts, "utt", wav, f"{path}/wav.scp")
    write_keyed_text(utts, "utt", text, f"{path}/text")
    write_keyed_text(utts, "utt", spk, f"{path}/utt2spk")
    s2u = utts.groupBy(spk).agg(F.array_join(F.array_sort(F.collect_list(F.col("utt").cast("string"))), " ")
                                .alias("utts"))
    write_keyed_text(s2u, spk, "utts", f"{path}/spk2utt")


def _numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Add a 1-based global row number by ``order``: a range sort over many tasks, checkpointed so that
    no task can be sorted anew, and each task's count for the next one's offset.  Ties are spread by
    their place in the input."""
    keys = [*order, "_tie"]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut_lineage(df.withColumn("_tie", F.monotonically_increasing_id())
                       .repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_tie"))
    rows = rows.withColumn("_part", F.spark_partition_id())
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row a task: no more than that meets in the window
    offsets = rows.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    in_part = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return (rows.withColumn(name, in_part).join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col(name) + F.col("_before") + 1).drop("_part", "_before"))


def write_shards(df: DataFrame, key: str, path: str, rows_per_shard: int = 1000,
                 ties: Sequence[str] = ()) -> DataFrame:
    """K2: Parquet shards of exactly ``rows_per_shard`` rows in the order of (key, ties), the last
    one with the remainder; returns the shard list (shard, path, rows, first_key, last_key).

    One sorted numbering gives each row its shard; it runs over many tasks whatever the size estimate
    says, which counts compressed bytes.  Whole shards are dealt to the tasks by their number, which
    asks for no sample of the rows and so runs the numbering once.  A task gets its shards in order,
    so the writer's row limit cuts its files at the shards' bounds; no path goes through the driver.
    The files are read once for the list, of which a row a file is kept."""
    spark = df.sparkSession
    order = [key, *ties]
    rows = _numbered(df, order, "_rn")
    rows = rows.withColumn("_shard", F.floor((F.col("_rn") - 1) / rows_per_shard))
    n = spark.sparkContext.defaultParallelism
    (rows.repartitionById(n, (F.col("_shard") % n).cast("int")).sortWithinPartitions("_rn").drop("_rn", "_shard")
     .write.mode("overwrite").option("maxRecordsPerFile", rows_per_shard).option("compression", "snappy").parquet(path))
    least = F.struct(*[F.col(c) for c in order])
    files = (spark.read.parquet(path).select(F.col("_metadata.file_path").alias("path"), *order)
             .groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.min(least).alias("_first"), F.max(least).alias("_last")))
    # only the last shard is short; among files of equal rows only it can be
    files = cut_lineage(files.withColumn("_missing", rows_per_shard - F.col("rows")))
    listed = seq_row_number(files, [], ["_first", "_last", "_missing", "path"], "_n").drop(BUCKET)
    return listed.select((F.col("_n") - 1).alias("shard"), "path", "rows", F.col("_first")[key].alias("first_key"),
                         F.col("_last")[key].alias("last_key"))


def write_list(shards: DataFrame, path: str) -> None:
    """The data.list: one shard path per line, in shard order over the files of ``path``."""
    n = shards.sparkSession.sparkContext.defaultParallelism
    shards.select(F.col("path").alias("value"), "shard").repartitionByRange(n, "shard").sortWithinPartitions("shard") \
        .select("value").write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """K3: JSON lines."""
    df.write.mode("overwrite").json(path)


def keyed_writer_checks(df: DataFrame, file_col: str = "file", key: str = "key") -> tuple[DataFrame, DataFrame]:
    """K4 checks: duplicate (file, key) pairs, and keys missing from some files."""
    dups = df.groupBy(file_col, key).count().where(F.col("count") > 1)
    n_files = df.select(file_col).distinct().count()
    uneven = df.select(file_col, key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n_files")) \
        .where(F.col("n_files") < n_files)
    return dups, uneven


def write_keyed_files(df: DataFrame, path: str, file_col: str = "file", key: str = "key",
                      value: str = "value") -> None:
    """K4: one text file per ``file_col`` value, 'key value' lines."""
    df.select(file_col, F.concat_ws(" ", F.col(key).cast("string"), F.col(value).cast("string")).alias("value")) \
        .write.mode("overwrite").partitionBy(file_col).text(path)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    """K7: one token per line in id order."""
    vocab.orderBy("id").select("token").coalesce(1).write.mode("overwrite").text(path)


def write_cmvn(stats: DataFrame, path: str) -> None:
    """K9: the global statistics as one JSON document (sums, frames, shift, scale)."""
    one = stats.orderBy("dim").agg(
        F.collect_list(F.struct("dim", "sum_x", "sum_x2", "shift", "scale")).alias("dims"),
        F.first("frames").alias("total_frames"))
    one = one.select(F.transform(F.array_sort("dims"), lambda d: d["sum_x"]).alias("mean_stats"),
                     F.transform(F.array_sort("dims"), lambda d: d["sum_x2"]).alias("var_stats"),
                     "total_frames")
    one.coalesce(1).write.mode("overwrite").json(path)


def write_cmvn_text(stats: DataFrame, path: str) -> None:
    """K9, affine form: the shift and scale vectors as '<AddShift>' and '<Rescale>' blocks of one
    text row (its size is the feature dimension's)."""
    rows = stats.agg(F.array_sort(F.collect_list(F.struct("dim", "shift", "scale"))).alias("r"))

    def block(tag: str, field: str):
        n = F.size("r").cast("string")
        values = F.array_join(F.transform("r", lambda x: x[field].cast("string")), " ")
        return F.concat(F.lit(f"<{tag}> "), n, F.lit(" "), n, F.lit("\n<LearnRateCoef> 0 [ "), values, F.lit(" ]\n"))
    rows.select(F.concat(F.lit("<Nnet>\n"), block("AddShift", "shift"), block("Rescale", "scale"), F.lit("</Nnet>"))
                .alias("value")).write.mode("overwrite").text(path)


def write_wer_report(detail: DataFrame, totals: DataFrame, path: str) -> None:
    """Per-utterance detail and the totals row."""
    detail.write.mode("overwrite").parquet(f"{path}/detail")
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals")


def audio_base64(col) -> F.Column:
    """Audio bytes as base64 text."""
    return F.base64(F.col(col) if isinstance(col, str) else col)


def write_nbest(df: DataFrame, path: str, fields: Mapping[str, str], key: str = "key",
                rank: str = "rank") -> None:
    """K12: '{n}best_recog/{field}' files of 'key value' lines."""
    long = None
    for name, col in fields.items():
        part = df.select(F.concat(F.col(rank).cast("string"), F.lit("best_recog")).alias("nbest"),
                         F.lit(name).alias("field"),
                         F.concat_ws(" ", F.col(key).cast("string"), F.col(col).cast("string")).alias("value"))
        long = part if long is None else long.unionByName(part)
    long.write.mode("overwrite").partitionBy("nbest", "field").text(path)
