"""Quality rules by distribution divergence.

Every text is compared with the reference of its language label: a histogram of character
classes and a histogram of the language's most common words, both counted over all
documents.  The distance is the Jensen-Shannon distance (square root of the divergence, base
2, so 0 to 1).  A text under the minimum length of a histogram is not judged by it.

Defined results: a null text counts as empty; a null label is a label of its own; an empty
table gives an empty result; repeated rows each get their own result row; columns of the
input that carry a result's name are replaced, other extra columns pass through.
Built-in functions only: the word arrays stay inside their row, so nothing but word counts
and the reference rows is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusvox.llm.common import BROADCAST_ROWS, bind, free_name, quoted, with_fields
from corpusvox.session import cut_lineage

#: Character classes in the order in which they are taken out of a text; "other" is what remains.
CLASSES = [("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("digit", "[0-9]+"), ("symbol", "[#*$%&|<>]+"),
           ("ascii", r"[\x00-\x7F]+"), ("letter", r"\p{L}+")]
CLASS_NAMES = ["space"] + [n for n, _ in CLASSES] + ["other"]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
JUDGED = ["class_distance", "word_distance", "kept"]


@dataclass(frozen=True)
class Limits:
    """Guards and thresholds of the rules.

    ``max_word_distance`` must be under the distance of a text without any common word, which
    the share q of the common words in the reference bounds: 0.36 for the 24 % of 30 words."""
    common_words: int = 30
    min_class_chars: int = 200
    max_class_distance: float = 0.25
    min_words: int = 60
    max_word_distance: float = 0.35
    base_min_words: int = 10
    base_repeat_percent: int = 20


def spaced(text: Column) -> Column:
    """The text with every separator ``[\\x20\\x09-\\x0D]`` written as a space; empty for a null."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def word_hashes(blank: Column) -> Column:
    """64-bit hashes of the words of a ``spaced`` text; words are compared by hash from here on."""
    words = F.filter(F.split(blank, " ", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def class_counts(blank: Column) -> Column:
    """array<long> with the number of characters of each of CLASS_NAMES in a ``spaced`` text."""
    def step(rest: Column, i: int, sizes: list[Column]) -> Column:
        if i == len(CLASSES):
            return F.array(*sizes, F.length(rest).cast("long"))
        return bind(F.regexp_replace(rest, CLASSES[i][1], ""), lambda less: step(
            less, i + 1, [*sizes, (F.length(rest) - F.length(less)).cast("long")]))
    return bind(blank, lambda t: bind(F.replace(t, F.lit(" "), F.lit("")), lambda solid: step(
        solid, 0, [(F.length(t) - F.length(solid)).cast("long")])))


def repeated_words(words: Column, size: int = 5) -> Column:
    """Words inside ``size``-word windows that occur twice or more in the same text.

    Windows of word hashes are compared by a 64-bit hash; only a text with equal hashes sorts them to find
    the positions, and each run of marked windows is counted once from its sorted starts."""
    def marked(hashes: Column) -> Column:
        def starts_of(s: Column) -> Column:
            near = F.transform(s, lambda x, i: F.when(
                (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))
            return F.array_sort(F.filter(near, lambda p: p.isNotNull()))

        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = bind(ordered, starts_of)
        return bind(starts, lambda p: F.aggregate(
            F.transform(p, lambda at, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - at, F.lit(size)))),
            F.lit(0).cast("long"), lambda acc, x: acc + x))

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - size),
                             lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        return F.when(F.size(w) <= size, F.lit(0).cast("long")).otherwise(bind(hashes, lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(marked(h))))
    return bind(words, counted)


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1),
                     lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    return bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def entropy_term(p: Column, m: Column) -> Column:
    return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))


def class_distance(counts: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of two count arrays of equal length; null if one sums to zero."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    def distance(a: Column, b: Column, na: Column, nb: Column) -> Column:
        terms = [(lambda p, q: entropy_term(p, (p + q) / 2) + entropy_term(q, (p + q) / 2))(
            F.get(a, F.lit(i)) / na, F.get(b, F.lit(i)) / nb) for i in range(len(CLASS_NAMES))]
        return F.sqrt(F.greatest(sum(terms[1:], terms[0]) / 2, F.lit(0.0)))

    return F.when((total(counts) > 0) & (total(ref) > 0), distance(counts, ref, total(counts), total(ref)))


def word_distance(words: Column, ref_words: Column, ref_shares: Column) -> Column:
    """Jensen-Shannon distance of a text's histogram over the reference's common words and "rest".

    The bins of the words are sorted and counted run by run; a common word that the text lacks
    adds half of its reference share."""
    def of_runs(bins: Column, n: Column) -> Column:
        ends = F.filter(F.transform(bins, lambda b, i: F.when(
            F.coalesce(F.get(bins, i + 1), F.lit(-1)) != b, F.struct(b.alias("b"), (i + 1).alias("e")))),
            lambda x: x.isNotNull())

        def summed(runs: Column) -> Column:
            def gain(r: Column, i: Column) -> Column:
                p = (r["e"] - F.coalesce(F.get(runs, i - 1)["e"], F.lit(0))) / n
                q = F.get(ref_shares, r["b"] - 1)
                return entropy_term(p, (p + q) / 2) + entropy_term(q, (p + q) / 2) - q

            common = F.aggregate(F.transform(runs, gain), F.lit(0.0), lambda acc, x: acc + x)
            all_q = F.aggregate(ref_shares, F.lit(0.0), lambda acc, x: acc + x)
            p0, q0 = 1 - F.size(bins) / n, F.greatest(1 - all_q, F.lit(0.0))
            rest = entropy_term(p0, (p0 + q0) / 2) + entropy_term(q0, (p0 + q0) / 2)
            return F.sqrt(F.greatest((common + all_q + rest) / 2, F.lit(0.0)))
        return bind(ends, summed)

    bins = F.array_sort(F.filter(F.transform(words, lambda w: F.array_position(ref_words, w)), lambda b: b > 0))
    return F.when(F.size(words) > 0, bind(bins, lambda b: of_runs(b, F.size(words).cast("double"))))


def language_references(df: DataFrame, text: str = "text", lang: str = "lang",
                        limits: Limits = Limits()) -> DataFrame:
    """One row per label: (label, ref_classes, ref_words, ref_shares), counted over all rows.

    ref_words: hashes of the most common words, ``common_words`` at most; words that tie with
    the first one beyond that number are left out, so the choice needs no order among ties."""
    rows = df.select(F.coalesce(F.col(quoted(lang)), F.lit("")).alias("label"),
                     spaced(F.col(quoted(text))).alias("t"))
    counts = rows.select("label", class_counts(F.col("t")).alias("c"))
    classes = counts.groupBy("label").agg(
        F.array(*[F.sum(F.get("c", F.lit(i))).cast("double") for i in range(len(CLASS_NAMES))]).alias("ref_classes"))
    vocabulary = (rows.select("label", F.explode(word_hashes(F.col("t"))).alias("w"))
                  .groupBy("label", "w").agg(F.count("*").alias("n")))
    k = limits.common_words
    ranked = vocabulary.withColumn("r", F.row_number().over(
        Window.partitionBy("label").orderBy(F.desc("n"), F.asc("w"))))
    top = (ranked.where(F.col("r") <= k + 1).groupBy("label")
           .agg(F.array_sort(F.collect_list(F.struct("r", "w", "n"))).alias("top"))
           .select("label", F.filter("top", lambda x: x["n"] > F.coalesce(
               F.get("top", F.lit(k))["n"], F.lit(0))).alias("top")))
    totals = vocabulary.groupBy("label").agg(F.sum("n").cast("double").alias("total"))
    shares = top.join(totals, "label").select(
        "label", F.col("top.w").alias("ref_words"),
        F.transform("top", lambda x: x["n"] / F.col("total")).alias("ref_shares"))
    return classes.join(shares, "label", "left")


def quality_verdicts(df: DataFrame, text: str = "text", lang: str = "lang",
                     limits: Limits = Limits()) -> DataFrame:
    """``df`` with BASE and JUDGED columns.

    base_failed: too few words, or too many of them in repeated windows.  kept: not
    base_failed, and no judged distance over its threshold."""
    refs = cut_lineage(language_references(df, text, lang, limits))
    if refs.count() <= BROADCAST_ROWS:
        refs = F.broadcast(refs)
    key = free_name(df, "_own_label")
    rows = df.withColumn(key, F.coalesce(F.col(quoted(lang)), F.lit("")))
    names = {c: free_name(df, f"_{c}") for c in refs.columns}
    refs = refs.select(*[F.col(c).alias(n) for c, n in names.items()])
    joined = rows.join(refs, F.col(quoted(key)) == F.col(names["label"]), "left")
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    lim = limits

    def measured(blank: Column, words: Column, classes: Column) -> Column:
        n = F.size(words).cast("long")
        chars = F.length(blank).cast("long")
        far = F.when(chars >= lim.min_class_chars, class_distance(classes, F.col(names["ref_classes"])))
        odd = F.when(n >= lim.min_words,
                     word_distance(words, F.col(names["ref_words"]), F.col(names["ref_shares"])))
        return F.struct(
            n.alias("n_words"), (chars - F.get(classes, F.lit(CLASS_NAMES.index("space")))).alias("word_chars"),
            F.get(classes, F.lit(CLASS_NAMES.index("symbol"))).alias("n_symbols"),
            duplicate_lines(t).alias("n_dup_lines"), repeated_words(words).alias("n_repeat_words"),
            far.alias("class_distance"), odd.alias("word_distance"))

    first = bind(spaced(t), lambda s: bind(word_hashes(s), lambda w: bind(
        class_counts(s), lambda c: measured(s, w, c))))
    out = with_fields(joined, first, [n for n in BASE if n != "base_failed"] + JUDGED[:2])
    failed = (F.col("n_words") < lim.base_min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(lim.base_repeat_percent) * F.col("n_words"))
    near = ((F.coalesce("class_distance", F.lit(0.0)) <= lim.max_class_distance)
            & (F.coalesce("word_distance", F.lit(0.0)) <= lim.max_word_distance))
    return (out.withColumn("base_failed", failed).withColumn("kept", ~failed & near)
            .drop(key, *names.values()))
