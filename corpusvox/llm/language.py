"""Language identification by words first, character n-grams for the rest.

A word that the training texts know scores by its log frequency in each language (a fixed
penalty where a language lacks it).  An unseen word falls back to its longest character
n-grams that are known, then to shorter ones; its score is their mean.  A text's score per
language is the mean over its words; the best language wins, ties go to the first by name.

The model is fitted on a sample of labelled rows that is bounded by ``max_rows`` (in
expectation, dealt evenly over the labels by a hash of the id and the text) and keeps
``max_words`` words and ``max_grams`` n-grams over all languages, the most frequent of each;
so it has a size that does not grow with the input and may be broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every
text when nothing was learned; null labels are not learned from; repeated rows each get a
row; columns of the input that carry a result's name are replaced, other extra columns pass
through.  The score is the share of the best language, in (0, 1], when the per-word mean
likelihoods are normalised over the languages.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from corpusvox.llm.common import prepare, quoted, rows_udf, with_fields

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
RESULT = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType())])


@dataclass(frozen=True)
class Limits:
    """Bounds of the sample and of the model."""
    max_rows: int = 20_000
    max_labels: int = 500
    max_words: int = 120_000
    max_grams: int = 80_000
    longest: int = 5
    penalty: float = 7.0


@dataclass(frozen=True)
class Model:
    """log10 frequencies: a row of ``words`` or ``grams`` for each entry, a column for each language."""
    languages: list[str]
    word_row: dict[str, int]
    gram_row: dict[str, int]
    table: np.ndarray
    longest: int


def held_out(doc_id: Column) -> Column:
    """The quarter of the ids that is never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def counted_words(batches):
    """mapInArrow: (label, text) batches to (label, word, n), counted batch by batch."""
    for batch in batches:
        counts: Counter = Counter()
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts.update((label, w) for w in WORD.findall(text.lower()))
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({
            "label": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()),
            "n": pa.array([counts[k] for k in keys], pa.int64())})


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id",
        limits: Limits = Limits()) -> Model:
    """Learn from the rows of ``labelled`` with a label and a text."""
    rows = labelled.select(F.col(quoted(lang)).alias("label"), F.col(quoted(text)).alias("text"),
                           F.col(quoted(key)).alias("key")).where("label IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(limits.max_labels).collect()
    if not sizes:
        return Model([], {}, {}, np.zeros((0, 0), np.float32), limits.longest)
    languages = sorted(r["label"] for r in sizes)
    share = limits.max_rows / len(sizes)
    rates = F.create_map(*[x for r in sizes for x in (F.lit(r["label"]), F.lit(min(1.0, share / r["count"])))])
    u = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(F.col("label").isin(languages)).where(u < F.try_element_at(rates, F.col("label")))
    words = (sample.select("label", "text").mapInArrow(counted_words, "label string, word string, n long")
             .groupBy("label", "word").agg(F.sum("n").alias("n")))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    def grams_of(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(padded) - (k - 1))
        return F.when(F.length(padded) >= k, F.transform(starts, lambda i: F.substring(padded, i, F.lit(k)))).otherwise(
            F.array().cast("array<string>"))
    grams = F.flatten(F.array(*[grams_of(k) for k in range(1, limits.longest + 1)]))
    pieces = (words.select("label", "n", F.explode(grams).alias("word")).where(F.trim("word") != "").groupBy("label", "word")
              .agg(F.sum("n").alias("n")))

    def top(counts: DataFrame, most: int) -> list[tuple[str, str, int]]:
        by_rank = Window.partitionBy("label").orderBy(F.desc("n"), "word")
        kept = (counts.withColumn("r", F.row_number().over(by_rank))
                .where(F.col("r") <= max(1, most // len(languages))).select("label", "word", "n").toArrow())
        return list(zip(*[c.to_pylist() for c in kept.columns], strict=True))

    column = {x: i for i, x in enumerate(languages)}
    rows_, row_of = [], []
    for entries, by_length in ((top(words, limits.max_words), False), (top(pieces, limits.max_grams), True)):
        totals: Counter = Counter()
        for label, entry, n in entries:
            totals[label, len(entry) if by_length else 0] += n
        index: dict[str, int] = {}
        for label, entry, n in sorted(entries, key=lambda e: (e[1], e[0])):
            at = index.get(entry)
            if at is None:
                at = index[entry] = len(rows_)
                rows_.append([-limits.penalty] * len(languages))
            rows_[at][column[label]] = max(-limits.penalty, float(np.log10(
                n / totals[label, len(entry) if by_length else 0])))
        row_of.append(index)
    return Model(languages, row_of[0], row_of[1], np.array(rows_, dtype=np.float32).reshape(len(rows_), -1),
                 limits.longest)


def predictor(model: Model):
    """f(text) -> (language, score)."""
    words, grams, table, longest = model.word_row.get, model.gram_row.get, model.table, model.longest

    def predict(text: str | None) -> tuple[str, float]:
        if text is None or not model.languages:
            return UNKNOWN, 0.0
        tokens = WORD.findall(text.lower())
        rows, weights, n = [], [], 0
        plain = []
        for w in tokens:
            at = words(w)
            if at is not None:
                plain.append(at)
                continue
            padded = f" {w} "
            for k in range(min(longest, len(padded)), 0, -1):
                found = [g for g in [grams(padded[i:i + k]) for i in range(len(padded) - k + 1)] if g is not None]
                if found:
                    rows += found
                    weights += [1.0 / len(found)] * len(found)
                    n += 1
                    break
        n += len(plain)
        if not any(any(c.isalpha() for c in w) for w in tokens):
            return UNKNOWN, 0.0
        if not n:  # letters, but of no known script
            return model.languages[0], 1.0 / len(model.languages)
        total = np.zeros(len(model.languages))
        if plain:
            total += table[plain].sum(axis=0, dtype=np.float64)
        if rows:
            total += np.asarray(weights) @ table[rows].astype(np.float64)
        mean = total / n
        best = int(np.argmax(mean))
        return model.languages[best], float(1.0 / (10.0 ** (mean - mean[best])).sum())
    return predict


def predict_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only the text is looked at."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def make(shared=shared):
        predict = predictor(shared.value)
        return lambda texts: [predict(t) for t in texts]
    return with_fields(docs, rows_udf(make, RESULT)(F.col(quoted(text))), ["lang_pred", "score"])


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
             limits: Limits = Limits()) -> DataFrame:
    """Learn from the rows that are not held out, predict every row: held_out, lang_pred, score."""
    out = held_out(F.col(quoted(doc_id)))
    model = fit(docs.where(~out), lang, text, doc_id, limits)
    return predict_language(docs.withColumn("held_out", out), model, text)
