"""The registered queries of the training-data operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusvox import tables
from corpusvox.llm import sql
from corpusvox.llm.common import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, twin: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if twin:
            ORACLE[name] = twin
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return tables.load(prepare(spark), sf_dir, name).select(*columns)


@register("op1_quality_divergence", sql.OP1)
def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.divergence import quality_verdicts

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    out = quality_verdicts(docs)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                      "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"),
                      F.round("word_distance", 6).alias("word_distance"))


#: The model of SentencePiece pieces; any other file of that kind may be given instead.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@register("op2_wu_manber_decontamination", sql.OP2)
def op2_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@register("op4_feistel_shards")
def op4_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.shards import assign_shards

    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.octet_length(data) + 8).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    return assign_shards(rows, ["doc_id", "text_crc32", "size"], 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register("op5_gumbel_segmentations")
def op5_gumbel_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.segmentations import load_vocabulary, sample_segmentations

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    drawn = sample_segmentations(docs, load_vocabulary(PIECES)).select("doc_id", F.posexplode("samples"))
    return drawn.select("doc_id", F.col("pos").alias("sample"), F.size("col.ids").alias("n_ids"), "col.ids",
                        "col.log_prob", "col.perturbed", "col.inclusion")


@register("op6_word_first_language")
def op6_word_first_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.language import identify

    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@register("op7_offset_preserving_pii")
def op7_offset_preserving_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.pii import KINDS, find_pii

    found = find_pii(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("pii", lambda x: ~x["added"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def n_of(kind):
        return F.size(F.filter(base, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[n_of(k) for k in KINDS],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"),
        F.size(F.filter("pii", lambda x: x["added"])).cast("long").alias("n_added"))


@register("op8_trie_simhash")
def op8_trie_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def repeats(spark: SparkSession, sf_dir: str, unit: str, **limits: int) -> DataFrame:
    from corpusvox.llm.repeats import repeated_units

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return repeated_units(docs, unit=unit, **limits).select("doc_id", "start", "end", "first_doc_id", "first_start")


@register("op3_line_hash_dedup", sql.OP3)
def op3_line_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, sf_dir, "passage")


@register("every_line_dedup", sql.units_sql("\\n"))
def every_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, sf_dir, "line", min_chars=1)


@register("every_paragraph_dedup", sql.units_sql("\\n[^\\S\\n]*\\n\\s*"))
def every_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, sf_dir, "paragraph", min_chars=1)


@register("op10_association_urls", sql.OP10)
def op10_association_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.url_rules import judge_urls, path_of

    pages = table(spark, sf_dir, "pages", "page_id", "url")
    doc = F.regexp_extract(path_of(F.col("url")), "([0-9]+)[^0-9]*$", 1)
    bad = F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").groupBy("doc_id").agg(bad)
    labelled = pages.select("url", doc.try_cast("long").alias("doc_id")).join(
        labels.where("blocked IS NOT NULL"), "doc_id").select("url", "blocked")
    return judge_urls(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


@register("op9_ordinal_quality")
def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.language import held_out
    from corpusvox.llm.ordinal import fit, grade_texts

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    ratings = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").where(
        ~held_out(F.col("doc_id"))).select("doc_id", grade.alias("grade"))
    return grade_texts(docs, fit(ratings, docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.round("expected_grade", 9).alias("expected_grade"),
        F.round("tail_prob", 9).alias("tail_prob"), "kept")


@register("op13_phrase_collocations", sql.OP13)
def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


@register("op12_norm_of_sum_codes", sql.OP12)
def op12_norm_of_sum_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpusvox.llm.vector_codes import quantise, with_group_error

    coded, books = quantise(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return with_group_error(coded).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.digest() if books else "").alias("codebooks_sha256"))


@register("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from corpusvox.llm.byte_bpe import encode, load_vocabulary

    vocabulary = load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = encode(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
