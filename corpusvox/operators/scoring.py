"""Recognition, verification and classification scoring.

Per-pair work is a column expression (or a pandas UDF for word alignment);
corpus totals are distributive sums.  ROC / DET curves need prefix sums over
the score order: they run through ``plans.sequence`` (range buckets plus a
small per-bucket carry) so no step is a single-task global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvox.functions.edit import char_distance, word_alignment
from corpusvox.functions.text import word_tokens
from corpusvox.functions.text import bound
from corpusvox.plans.sequence import seq_cumsum


# ---------------------------------------------------------------- WER / CER

def wer_detail(pairs: DataFrame, key: str, ref_words: str, hyp_words: str) -> DataFrame:
    """F3 per pair: key, nwords, cor, sub, ins, del, wrong (J4: pairs are the inner join)."""
    a = word_alignment(F.col(hyp_words), F.col(ref_words))
    return pairs.select(key, F.size(ref_words).alias("nwords"), a.alias("_a")).select(
        key, "nwords", "_a.cor", "_a.sub", "_a.ins", "_a.del", "_a.wrong")


def join_ref_hyp(ref: DataFrame, hyp: DataFrame, key: str = "key") -> DataFrame:
    """Only keys present on both sides are scored (columns ref, hyp)."""
    return ref.select(key, F.col("words").alias("ref")).join(
        hyp.select(key, F.col("words").alias("hyp")), key, "inner")


def wer_totals(detail: DataFrame) -> DataFrame:
    """Wrd, Corr, Ins, Del, Sub, Snt, wrong words/sentences, Err and S.Err (2 decimals).

    Err/S.Err are NULL when there is nothing to score (the reference divides by zero)."""
    t = detail.agg(
        F.sum("nwords").cast("long").alias("wrd"), F.sum("cor").cast("long").alias("corr"),
        F.sum("ins").cast("long").alias("ins"), F.sum("del").cast("long").alias("del"),
        F.sum("sub").cast("long").alias("sub"), F.count(F.lit(1)).alias("snt"),
        F.sum("wrong").cast("long").alias("wrong_words"),
        F.count(F.when(F.col("wrong") > 0, 1)).alias("wrong_sentences"))
    return t.withColumn("err", F.round(F.try_divide(F.col("wrong_words") * 100.0, F.col("wrd")), 2)) \
            .withColumn("s_err", F.round(F.try_divide(F.col("wrong_sentences") * 100.0, F.col("snt")), 2))


def cer_detail(pairs: DataFrame, key, ref: str, hyp: str) -> DataFrame:
    """A8 per pair: character distance with spaces removed, and reference length."""
    keys = [key] if isinstance(key, str) else list(key)
    return pairs.select(*keys, char_distance(hyp, ref).alias("dist"),
                        F.length(F.replace(F.col(ref), F.lit(" "), F.lit(""))).alias("ref_len"))


def wer_distance_detail(pairs: DataFrame, key, ref: str, hyp: str) -> DataFrame:
    """A8 word form: whitespace-split word edit distance (via alignment counts)."""
    keys = [key] if isinstance(key, str) else list(key)
    a = word_alignment(word_tokens(hyp), word_tokens(ref))
    return pairs.select(*keys, a["wrong"].alias("dist"), F.size(word_tokens(ref)).alias("ref_len"))


def corpus_rate(detail: DataFrame) -> DataFrame:
    """Sum of distances / sum of reference lengths (NULL when the references are empty)."""
    return detail.agg(F.sum("dist").cast("long").alias("dist"), F.sum("ref_len").cast("long").alias("ref_len")) \
        .withColumn("rate", F.try_divide(F.col("dist").cast("double"), F.col("ref_len")))


def collapse_ctc(ids: Column, blank: int = 0, space: int | None = None) -> Column:
    """Collapse runs of equal ids, then drop -1, blank and space ids."""
    kept = bound(ids, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.element_at(a, F.greatest(i, F.lit(1))))))
    drop = [-1, blank] + ([space] if space is not None else [])
    return F.filter(kept, lambda v: ~v.isin(*drop))


# ----------------------------------------------------- verification scoring

def error_rates(trials: DataFrame, score: str = "score", label: str = "label", pos: str = "pos") -> DataFrame:
    """For each trial in ascending (score, pos) order, cumulative false
    negatives / true negatives -> fnr, fpr (no tie collapsing)."""
    totals = trials.agg(F.sum(label).alias("p"), F.count(F.lit(1)).alias("n")).first()
    positives, negatives = int(totals["p"] or 0), int(totals["n"] or 0) - int(totals["p"] or 0)
    cum = seq_cumsum(trials, [], [score, pos], {
        "fns": F.col(label).cast("long"), "tns": (1 - F.col(label)).cast("long")}).drop("_seq_b")
    return cum.withColumn("fnr", F.try_divide(F.col("fns").cast("double"), F.lit(positives))) \
              .withColumn("fpr", 1 - F.try_divide(F.col("tns").cast("double"), F.lit(negatives)))


def min_dcf(rates: DataFrame, score: str = "score", pos: str = "pos", p_target: float = 0.01,
            c_miss: float = 1.0, c_fa: float = 1.0) -> DataFrame:
    """Minimum normalised detection cost and its threshold (first minimum wins)."""
    if c_fa <= 0 or c_miss <= 0:
        raise ValueError("c_fa and c_miss must be greater than 0")
    if not 0 < p_target < 1:
        raise ValueError("p_target must be in (0, 1)")
    c_det = c_miss * F.col("fnr") * p_target + c_fa * F.col("fpr") * (1 - p_target)
    c_def = min(c_miss * p_target, c_fa * (1 - p_target))
    r = rates.withColumn("_c", c_det)
    # minimum on the hash path, then the first row (score, pos) among the few at the minimum
    m = r.agg(F.min("_c")).first()[0]
    best = r.where(F.col("_c") == F.lit(m)).agg(F.min(F.struct(F.col(score).alias("t"), F.col(pos))).alias("b"))
    return best.select((F.lit(m) / c_def).alias("min_dcf"), F.col("b.t").alias("threshold"))


def eer(trials: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """ROC over all distinct thresholds (plus +inf); at the point minimising
    |fnr - fpr| (highest threshold on ties) return mean(fnr, fpr) and the threshold.

    The reference's ROC helper also drops collinear points; we keep all points."""
    per = trials.groupBy(score).agg(F.sum(label).cast("long").alias("pos_n"),
                                    F.sum(1 - F.col(label)).cast("long").alias("neg_n"))
    totals = per.agg(F.sum("pos_n").alias("p"), F.sum("neg_n").alias("n")).first()
    positives, negatives = int(totals["p"] or 0), int(totals["n"] or 0)
    per = per.withColumn("_neg_score", -F.col(score))
    cum = seq_cumsum(per, [], ["_neg_score"], {"tp": F.col("pos_n"), "fp": F.col("neg_n")}).drop("_seq_b")
    spark = trials.sparkSession
    inf = spark.createDataFrame([(float("inf"), 0, 0)], f"{score} double, tp long, fp long")
    pts = cum.select(F.col(score).cast("double").alias(score), "tp", "fp").unionByName(inf)
    pts = pts.withColumn("fnr", 1 - F.try_divide(F.col("tp").cast("double"), F.lit(positives))) \
             .withColumn("fpr", F.try_divide(F.col("fp").cast("double"), F.lit(negatives)))
    pts = pts.withColumn("_d", F.abs(F.col("fnr") - F.col("fpr")))
    m = pts.agg(F.min("_d")).first()[0]
    b = pts.where(F.col("_d") == F.lit(m)).agg(
        F.max(F.struct(F.col(score).alias("t"), "fnr", "fpr")).alias("b"))  # highest threshold on ties
    return b.select(((F.col("b.fnr") + F.col("b.fpr")) / 2).alias("eer"), F.col("b.t").alias("threshold"))


def masked_accuracy(df: DataFrame, pred: str, target: str, ignore=-1) -> DataFrame:
    """A10: matches / positions where target != ignore."""
    valid = F.col(target) != F.lit(ignore)
    return df.agg(F.sum(F.when(valid & (F.col(pred) == F.col(target)), 1).otherwise(0)).cast("long").alias("correct"),
                  F.sum(F.when(valid, 1).otherwise(0)).cast("long").alias("total")) \
        .withColumn("accuracy", F.try_divide(F.col("correct").cast("double"), F.col("total")))


def weighted_mean(value: str, weight: str) -> Column:
    """A18/A26 aggregate: sum(v*n)/sum(n) (token-weighted loss, running meters); NULL over no weight."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))


def ratio_of_sums(num: Column, den: Column) -> Column:
    """A17 aggregate: e.g. real-time factor = sum(compute seconds) / sum(speech seconds)."""
    return F.try_divide(F.sum(num), F.sum(den))
