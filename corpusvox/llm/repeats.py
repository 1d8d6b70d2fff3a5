"""Substring dedup by hashing lines, paragraphs and runs of sentences.

Texts are cut into units, each unit is normalised (NFC, lower case, white space runs made one
blank) and hashed to 128 bits.  Digests are grouped globally; the occurrence with the least rank
(document id, text hash, offset) stays, every other one is removed and reported with its offsets
in the original text.  The units of a text are

* ``line``: its lines;
* ``paragraph``: what lies between blank lines;
* ``passage``: its lines, its paragraphs of several lines, and runs of sentences.  A sentence
  ends at a line end or at a blank after ``.``, ``!`` or ``?``; a run begins at any sentence and
  takes further ones until it has ``min_chars`` characters.  So a passage that repeats inside
  longer lines, or as many short lines, is found wherever it begins at a sentence.

Units of fewer than ``min_chars`` normalised characters are left alone: short ones coincide by
chance.  With ``min_chars=1`` every unit that is not blank counts, whatever its length or script.

The work has two steps, so that only repeats become rows.  First each task counts 64-bit hashes
of its units and writes them as packed arrays by hash range; those that occur twice or more fill
a Bloom filter of bounded size.  Then units that pass the filter are exploded, and grouped and
joined by their whole digest; a false positive of the filter is a group of one and falls away.
Groups are reduced with partial aggregation, written out (one row a repeated digest) and joined
back by an equi-join, whose hot digests (a line that a third of all documents share) Spark's skew
join splits.

Defined results: a null text has no units; a null id ranks last; rows equal in id and text are
one document and fare alike; an empty table gives an empty result; offsets are code points,
end exclusive; units of one text may overlap, and ``without_repeats`` removes their union; extra
columns pass through it, and ``removed`` replaces a column of that name.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from corpusvox.llm.collocations import HELD, buckets_of, filter_bits, frequent_fingerprints, passing, summed
from corpusvox.llm.common import free_name, quoted, rows_udf, shuffle_partitions
from corpusvox.session import cut_lineage

UNIT = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()),
                   StructField("digest", BinaryType())])
UNITS = StructType([StructField("units", ArrayType(UNIT))])
CUT = StructType([StructField("text", StringType())])
LINE, PARAGRAPH = re.compile(r"\n"), re.compile(r"\n[^\S\n]*\n\s*")
SENTENCE_END = re.compile(r"([.!?])[ \t]")
KINDS = ("line", "paragraph", "passage")
#: What is removed with a unit: the separator after it.
AFTER = {"line": LINE, "paragraph": PARAGRAPH, "passage": LINE}
MIN_CHARS = 90


def normalised(unit: str) -> str:
    return " ".join(unicodedata.normalize("NFC", unit).lower().split())


def parts_of(text: str, separator: re.Pattern) -> Iterator[tuple[int, int]]:
    at = 0
    for m in separator.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def spans_of(text: str, unit: str, min_chars: int) -> dict[tuple[int, int], str]:
    """(start, end) of each unit of ``min_chars`` characters or more, with its normalised text."""
    out: dict[tuple[int, int], str] = {}
    if unit != "passage":
        for a, b in parts_of(text, LINE if unit == "line" else PARAGRAPH):
            plain = normalised(text[a:b])
            if len(plain) >= max(1, min_chars):
                out[a, b] = plain
        return out
    for a, b in parts_of(text, LINE):
        if b - a >= min_chars:
            plain = normalised(text[a:b])
            if len(plain) >= max(1, min_chars):
                out[a, b] = plain
    for a, b in parts_of(text, PARAGRAPH):
        if b - a >= min_chars and "\n" in text[a:b]:
            plain = normalised(text[a:b])
            if len(plain) >= max(1, min_chars):
                out[a, b] = plain
    at, sentences = 0, []
    for s in SENTENCE_END.sub("\\1\n", text).split("\n"):
        plain = normalised(s)
        if plain:
            sentences.append((at, at + len(s), plain))
        at += len(s) + 1
    for i, (a, b, plain) in enumerate(sentences):
        j, size = i, len(plain)
        while size < min_chars and j + 1 < len(sentences):
            j += 1
            size += 1 + len(sentences[j][2])
        if size >= min_chars:
            out[a, sentences[j][1]] = plain if i == j else " ".join([x[2] for x in sentences[i:j + 1]])
    return out


def digest_of(plain: str) -> bytes:
    return xxhash.xxh3_128_digest(plain.encode("utf-8", "replace"))


def units_of(text: str | None, unit: str = "passage", min_chars: int = MIN_CHARS) -> list[dict]:
    """The units of a text with offsets and digests, in order."""
    return [{"start": a, "end": b, "digest": digest_of(plain)}
            for (a, b), plain in sorted(spans_of(text, unit, min_chars).items())] if text else []


def hash_counts(docs: DataFrame, unit: str, min_chars: int, n_buckets: int) -> DataFrame:
    """(bucket, h, n): each task's 64-bit unit hashes and their counts, packed by hash range."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def written() -> Iterator[pa.RecordBatch]:
            h, n = summed(*map(np.concatenate, zip(*held, strict=True)))
            for bucket, s in buckets_of(h, n_buckets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket]), pa.array([h[s].tobytes()]), pa.array([n[s].tobytes()])], names=["bucket", "h", "n"])

        for b in batches:
            found = [digest_of(plain)[:8] for t in b.column(0).to_pylist() if t
                     for plain in spans_of(t, unit, min_chars).values()]
            h = np.frombuffer(b"".join(found), np.uint64)
            held.append(summed(h, np.ones(len(h), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                yield from written()
                held, size = [], 0
        if size:
            yield from written()
    return docs.mapInArrow(count, "bucket long, h binary, n binary")


def unit_column(text: Column, unit: str, min_chars: int, shared) -> Column:
    """The units of a text whose hashes pass the filter ``shared``."""
    def make(unit=unit, min_chars=min_chars, shared=shared):
        def some(texts: list) -> list[tuple]:
            units = [units_of(t, unit, min_chars) for t in texts]
            h = np.frombuffer(b"".join([u["digest"][:8] for us in units for u in us]), np.uint64)
            may = np.zeros(len(h), bool)
            may[passing(h, shared.value)] = True
            kept = iter(may.tolist())
            return [([u for u in us if next(kept)],) for us in units]
        return some
    return rows_udf(make, UNITS)(text)["units"]


def repeated_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "passage",
                   min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each removed unit: (doc_id, hash, start, end, digest, first_doc_id, first_start)."""
    if unit not in KINDS:
        raise ValueError(f"unit must be one of {KINDS}")
    spark, t = docs.sparkSession, F.col(quoted(text))
    packed = hash_counts(docs.select(t.alias("text")), unit, min_chars, 2 * shuffle_partitions(spark))
    repeated = cut_lineage(frequent_fingerprints(packed, 2))
    shared = spark.sparkContext.broadcast(filter_bits(repeated, repeated.count()))
    found = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.xxhash64(t).alias("hash"),
                        unit_column(t, unit, min_chars, shared).alias("units"))
    units = cut_lineage(found.select("doc_id", "hash", F.explode("units").alias("u")).select(
        "doc_id", "hash", "u.start", "u.end", "u.digest"))
    shared.unpersist()
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "start")
    first = cut_lineage(units.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select(
        "digest", "first"))
    return units.join(first, "digest").where(rank != F.col("first")).select(
        "doc_id", "hash", "start", "end", F.lower(F.hex("digest")).alias("digest"),
        F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"))


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "passage",
                    min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated units cut out of the text, and ``removed``: the union of their (start, end).

    A span is cut with the separator after it; removed is empty where nothing was cut."""
    spans = (repeated_units(docs, doc_id, text, unit, min_chars).select("doc_id", "hash", "start", "end").distinct()
             .groupBy("doc_id", "hash").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed")))
    names = {c: free_name(docs, f"_cut_{c}") for c in spans.columns}
    spans = spans.select(*[F.col(c).alias(n) for c, n in names.items()])
    key = free_name(docs, "_text_hash")
    rows = docs.withColumn(key, F.xxhash64(F.col(quoted(text)))).join(
        spans, F.col(quoted(doc_id)).eqNullSafe(F.col(names["doc_id"])) & (F.col(key) == F.col(names["hash"])), "left")
    separator = AFTER[unit]
    out_type = StructType([*CUT.fields, StructField("removed", ArrayType(StructType(UNIT.fields[:2])))])

    def make():
        def cut(t: str | None, removed: list | None) -> tuple:
            if t is None or not removed:
                return t, []
            spans: list[dict] = []
            for r in removed:
                if spans and r["start"] <= spans[-1]["end"]:
                    spans[-1]["end"] = max(spans[-1]["end"], r["end"])
                else:
                    spans.append({"start": r["start"], "end": r["end"]})
            out, at = [], 0
            for r in spans:
                out.append(t[at:r["start"]])
                after = separator.match(t, r["end"])
                at = after.end() if after else r["end"]
            return "".join(out) + t[at:], spans
        return lambda texts, removed: [cut(*x) for x in zip(texts, removed, strict=True)]

    cut = rows_udf(make, out_type, n_args=2)(F.col(quoted(text)), F.col(names["removed"]))
    tmp = free_name(rows, "_new_text")
    out = rows.withColumn(tmp, cut).drop(*names.values(), key)
    kept = [F.col(quoted(tmp))["text"].alias(c) if c == text else F.col(quoted(c))
            for c in docs.columns if c.lower() != "removed"]
    return out.select(*kept, F.col(quoted(tmp))["removed"].alias("removed"))
