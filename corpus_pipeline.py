"""A training-data pipeline over ``documents``: each stage calls one operator of ``corpusvox.llm``.

Stages get the whole result of the stage before and return all of ``documents``' columns, but
for the last one, which returns token ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusvox import tables
from corpusvox.llm import decontaminate, language, pii, segmentations, simhash
from corpusvox.llm.common import free_name, prepare
from corpusvox.llm.queries import PIECES
from corpusvox.session import cut_lineage

#: A text whose best language has less than this share of the likelihood is rejected.
LEAST_LANGUAGE_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the predicted language as ``lang``; texts without one, or of none clearly, go."""
    prepare(spark)
    names = docs.columns
    found = language.identify(docs)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col(c) for c in names])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of SimHash near-duplicates."""
    prepare(spark)
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of a benchmark item."""
    prepare(spark)
    found = decontaminate.find_contamination(docs, tables.load(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write each e-mail address, IP address, card and phone number as its kind, and count the characters anew."""
    prepare(spark)
    found = pii.find_pii(docs, mask=True)
    out = {"text": F.col("masked"), "n_chars": F.length("masked").cast("long")}
    return found.select(*[out[c].alias(c) if c in out else F.col(c) for c in docs.columns])


def sample_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The best perturbed segmentation of each text as token ids, with its log probability."""
    prepare(spark)
    column = free_name(docs, "drawn")
    drawn = segmentations.sample_segmentations(docs, segmentations.load_vocabulary(PIECES), k=2)
    first = drawn.withColumn(column, F.get("samples", F.lit(0)))
    return first.select("doc_id", "lang", "source", F.col(column)["ids"].alias("ids"),
                        F.size(F.col(column)["ids"]).alias("n_ids"), F.col(column)["log_prob"].alias("log_prob"),
                        F.col(column)["inclusion"].alias("inclusion"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("sentencepiece", sample_tokens),
]

#: SQL cannot express these stages; tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents of ``sf_dir`` on; each but the last is checkpointed."""
    docs = tables.load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
