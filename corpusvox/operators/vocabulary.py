"""Vocabulary building, OOV rate, token -> id, unigram label distribution.

Token counting is an ``explode`` + ``groupBy`` with map-side partial
aggregation, so a very frequent token costs one partial row per task, not a
hot reducer.  First appearance is the least (doc, pos), also partial.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from corpusvox.plans.sequence import seq_row_number

#: More than the positions of a row.
POSITIONS = 1 << 31
# Largest vocabulary that is broadcast or embedded in a plan.
MAX_LOOKUP_ENTRIES = 200_000


def explode_tokens(df: DataFrame, key: str, tokens: Column | str) -> DataFrame:
    """(key, pos, token) long form; pos is 0-based inside the row."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    return df.select(key, F.posexplode(t).alias("pos", "token"))


def token_counts(long: DataFrame, key: str) -> DataFrame:
    """(token, cnt, first=struct(k, p)): the count of each token and its first (row, pos).

    Rows with whole-number keys take one aggregation by token: (row, pos) is one decimal, so the
    buffers are primitives, tasks combine all their tokens first and only distinct tokens are
    shuffled.  Other keys take two aggregations, by (row, token) and by token."""
    if isinstance(long.schema[key].dataType, IntegralType):
        place = F.col(key).cast("decimal(20,0)") * F.lit(POSITIONS).cast("decimal(10,0)") + F.col("pos")
        agg = long.groupBy("token").agg(F.count(F.lit(1)).alias("cnt"), F.min(place.cast("decimal(38,0)")).alias("at"))
        p = F.pmod(F.col("at"), F.lit(POSITIONS))
        k, p = ((F.col("at") - p) / POSITIONS).cast(long.schema[key].dataType), p.cast("int")
        return agg.select("token", "cnt", F.struct(k.alias("k"), p.alias("p")).alias("first"))
    per_row = long.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("p"))
    agg = per_row.groupBy("token").agg(F.sum("n").alias("cnt"), F.min(key).alias("k"),
                                       F.min_by("p", F.col(key)).alias("p"))
    return agg.select("token", "cnt", F.struct(F.col("k"), F.col("p")).alias("first"))


def _symbol_slots(add_symbols: Sequence[tuple[str, int]], n_words: int | None):
    """Final positions of the added symbols after sequential list inserts.

    Negative indexes count from the end of the list at insert time, which
    depends on the number of words; ``n_words`` must then be known."""
    placed: list[tuple[str, int]] = []
    length = n_words or 0
    for sym, idx in add_symbols:
        if idx < 0:
            if n_words is None:
                raise ValueError("negative symbol index needs the vocabulary size")
            idx = length + 1 + idx
        idx = max(0, min(idx, length))
        placed = [(s, p + 1 if p >= idx else p) for s, p in placed]
        placed.append((sym, idx))
        length += 1
    return placed


def build_vocabulary(long: DataFrame, key: str, cutoff: int = 0, vocabulary_size: int = 0,
                     add_symbols: Sequence[tuple[str, int]] = (("<blank>", 0), ("<unk>", -1))
                     ) -> DataFrame:
    """A5: (id, token, cnt).  Count tokens, drop added symbols, keep cnt > cutoff,
    order by cnt desc then first appearance, cut to ``vocabulary_size - n_added``,
    insert the added symbols (cnt NULL) at their indexes."""
    return vocabulary_from_counts(token_counts(long, key), cutoff, vocabulary_size, add_symbols)


def vocabulary_from_counts(counts: DataFrame, cutoff: int = 0, vocabulary_size: int = 0,
                           add_symbols: Sequence[tuple[str, int]] = (("<blank>", 0), ("<unk>", -1))
                           ) -> DataFrame:
    """A5 from a ``token_counts`` table (lets A5 and A6 share one counting pass)."""
    symbols = [s for s, _ in add_symbols]
    counts = counts.where(~F.col("token").isin(*symbols) if symbols else F.lit(True))
    counts = counts.where(F.col("cnt") > cutoff)
    ordered = counts.select("token", "cnt", (-F.col("cnt")).alias("neg_cnt"),
                            F.col("first.k").alias("first_key"), F.col("first.p").alias("first_pos"))
    order = ["neg_cnt", "first_key", "first_pos"]
    if vocabulary_size and vocabulary_size > 0:
        if vocabulary_size < len(add_symbols):
            raise ValueError(f"vocabulary_size is too small: {vocabulary_size}")
        keep = vocabulary_size - len(add_symbols)
        # the vocabulary is a top-k of bounded size: one distributed pass (partial
        # counts + TakeOrderedAndProject), then the <= keep winners come to the driver
        top = ordered.orderBy(*order).limit(keep).collect()
        ranked = counts.sparkSession.createDataFrame(
            [(i, r["token"], r["cnt"]) for i, r in enumerate(top)], "rank long, token string, cnt long")
        n_words = len(top)
    else:
        ranked = seq_row_number(ordered, [], order, "rank").drop("_seq_b") \
            .withColumn("rank", F.col("rank") - 1)
        n_words = None
    if n_words is None and any(i < 0 for _, i in add_symbols):
        n_words = ranked.count()
    slots = _symbol_slots(add_symbols, n_words)
    pos = sorted(p for _, p in slots)
    # free slots before symbol j: pos_j - j; a word of rank r sits after symbol j iff pos_j - j <= r
    shifts = F.array(*[F.lit(p - j) for j, p in enumerate(pos)]) if pos else F.array().cast("array<int>")
    words = ranked.select(
        (F.col("rank") + F.size(F.filter(shifts, lambda x: x <= F.col("rank")))).cast("int").alias("id"),
        "token", "cnt")
    if not slots:
        return words
    spark = counts.sparkSession
    syms = spark.createDataFrame([(p, s) for s, p in slots], "id int, token string") \
        .withColumn("cnt", F.lit(None).cast("long"))
    return words.unionByName(syms)


def oov_from_counts(counts: DataFrame, vocab: DataFrame,
                    add_symbols: Sequence[str] = ("<blank>", "<unk>")) -> DataFrame:
    """A6 from a ``token_counts`` table: (total, in_vocab, oov_rate %)."""
    c = counts.where(~F.col("token").isin(*add_symbols)) if add_symbols else counts
    iv = vocab.where(F.col("cnt").isNotNull()).select("token").withColumn("iv", F.lit(1))
    if iv.count() <= MAX_LOOKUP_ENTRIES:
        iv = F.broadcast(iv)
    return c.join(iv, "token", "left").agg(
        F.sum("cnt").cast("long").alias("total"),
        F.sum(F.when(F.col("iv") == 1, F.col("cnt")).otherwise(0)).cast("long").alias("in_vocab")) \
        .withColumn("oov_rate", F.try_divide((F.col("total") - F.col("in_vocab")) * 100.0, F.col("total")))


def tokens_to_ids(long: DataFrame, key: str, vocab: DataFrame, unk: str = "<unk>") -> DataFrame:
    """J12 in long form: (key, pos, token, id, is_unk); unknown tokens get the id of ``unk``.

    The vocabulary side is small and AQE broadcasts it at run time; the id of
    ``unk`` is one looked-up row."""
    row = vocab.where(F.col("token") == unk).select("id").first()
    if row is None:
        raise ValueError(f"{unk!r} is not in the vocabulary")
    side = vocab.where(F.col("cnt").isNotNull() | (F.col("token") != unk)).select("token", "id")
    # broadcast only a vocabulary whose size is checked; a larger one takes the shuffle join
    if side.count() <= MAX_LOOKUP_ENTRIES:
        side = F.broadcast(side)
    ids = long.join(side, "token", "left")
    return ids.select(key, "pos", "token", F.col("id").isNull().alias("is_unk"),
                      F.coalesce("id", F.lit(int(row["id"]))).alias("id"))


def unigram_distribution(ids_long: DataFrame, key: str, odim: int, blank: int = 0) -> DataFrame:
    """Each distinct id counts once per utterance, eos (odim-1) counts the
    number of utterances, zeros floored to 1, blank zeroed, then normalised.

    Output (id, prob) for every id in [0, odim)."""
    spark = ids_long.sparkSession
    per_utt = ids_long.select(key, "id").distinct()
    counts = per_utt.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("c"))
    n_utts = ids_long.select(key).distinct().agg(F.count(F.lit(1)).cast("double").alias("c")) \
        .withColumn("id", F.lit(odim - 1))
    all_ids = spark.range(odim).select(F.col("id").cast("int").alias("id"))
    c = all_ids.join(counts.where(F.col("id") != odim - 1).unionByName(n_utts.select("id", "c")), "id", "left")
    c = c.withColumn("c", F.when(F.col("id") == blank, 0.0)
                     .when(F.coalesce("c", F.lit(0.0)) == 0.0, 1.0).otherwise(F.col("c")))
    return c.withColumn("prob", F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(1)))).select("id", "prob")


def seg_tokenize(long: DataFrame, key: str, seg_dict: DataFrame, unk: str = "<unk>") -> DataFrame:
    """Dictionary segmentation.  A lower-cased word found in the dictionary
    becomes its pieces; a word made only of CJK ideographs or digits is looked up
    character by character (missing characters -> unk); anything else -> unk.

    ``long`` is (key, pos, token); ``seg_dict`` is (word, pieces ARRAY<STRING>).
    Output (key, pos, sub, token) -- joins, no per-row dictionary in Python."""
    d = seg_dict.select(F.col("word").alias("_w"), F.col("pieces").alias("_p"))
    w = long.select(key, "pos", F.lower("token").alias("_low"))
    hit = w.join(d, w["_low"] == d["_w"], "left")
    by_char = F.col("_p").isNull() & F.col("_low").rlike(r"^[一-龥0-9]+$")
    whole = hit.where(~by_char).select(key, "pos", F.posexplode(F.coalesce("_p", F.array(F.lit(unk)))).alias("sub", "token"))
    cjk = hit.where(by_char).select(key, "pos", "_low")
    chars = cjk.select(key, "pos", F.posexplode(F.regexp_extract_all("_low", F.lit("(.)"), 1)).alias("ci", "_c"))
    per_char = chars.join(d, chars["_c"] == d["_w"], "left").select(
        key, "pos", "ci", F.coalesce("_p", F.array(F.lit(unk))).alias("_pp"))
    per_char = per_char.select(key, "pos", "ci", F.posexplode("_pp").alias("cj", "token")) \
        .select(key, "pos", (F.col("ci").cast("long") * (1 << 31) + F.col("cj")).alias("sub"), "token")
    return whole.unionByName(per_char)
