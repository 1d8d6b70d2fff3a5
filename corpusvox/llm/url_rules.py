"""URL filtering: listed host/path rules first, mined association rules for the rest.

Spark's FP-growth mines the tokens of labelled URLs together with their label.  A rule
"these tokens -> blocked" is kept if its support and its confidence reach their minimum.  The
kept rules are matched through an inverted index from token to rule: a URL's rule tokens look
up the index, and a rule whose tokens were all met holds.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
listed rule and has no tokens, so it is allowed; nothing is mined from URLs without a label;
repeated rows each get a row; columns of the input that carry a result's name are replaced,
other extra columns pass through.  Built-in functions and Spark ML only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusvox.llm.common import BROADCAST_ROWS, free_name, quoted, with_fields
from corpusvox.session import cut_lineage

#: (verdict, host, path); the longest that fits wins.
LISTED = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
          ("allow", "org", "/fr/")]
#: Stands for "blocked" among a URL's tokens; tokens have no blanks.
BLOCKED = "label blocked"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Limits:
    """Minimum support (a share of the labelled URLs, and a number of them) and confidence."""
    min_support: float = 0.002
    min_urls: int = 5
    min_confidence: float = 0.5


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Up to the first ``/``, ``?`` or ``#`` after the scheme, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest listed rule that fits; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(LISTED, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """The distinct runs of letters and digits after the scheme, lower-cased (A-Z only)."""
    low = F.translate(F.coalesce(after_scheme(url), F.lit("")), UPPER, LOWER)
    return F.array_distinct(F.filter(F.split(low, "[^a-z0-9]+", -1), lambda t: t != ""))


def mine_rules(labelled: DataFrame, url: str = "url", blocked: str = "blocked",
               limits: Limits = Limits()) -> DataFrame:
    """(rule_id, tokens, n_tokens, support, confidence) of the rules that reach both minima.

    ``labelled`` has a URL and a boolean.  The support of a rule is the share of labelled URLs
    that are blocked and have its tokens."""
    items = cut_lineage(labelled.select(F.when(F.col(quoted(blocked)), F.array_append(
        tokens_of(F.col(quoted(url))), F.lit(BLOCKED))).otherwise(tokens_of(F.col(quoted(url)))).alias("items")))
    n = items.count()
    schema = "rule_id long, tokens array<string>, n_tokens int, support double, confidence double"
    if not n:
        return labelled.sparkSession.createDataFrame([], schema)
    least = max(limits.min_support, (limits.min_urls - 0.5) / n)
    if least > 1.0:
        return labelled.sparkSession.createDataFrame([], schema)
    mined = FPGrowth(itemsCol="items", minSupport=least, minConfidence=limits.min_confidence).fit(items)
    sets = cut_lineage(mined.freqItemsets.select(
        F.array_contains("items", BLOCKED).alias("is_rule"),
        F.array_sort(F.array_remove("items", BLOCKED)).alias("tokens"), "freq"))
    both = sets.where("is_rule AND size(tokens) > 0").select("tokens", F.col("freq").alias("hit"))
    alone = sets.where("NOT is_rule").select("tokens", F.col("freq").alias("seen"))
    rules = both.join(alone, "tokens").withColumn("confidence", F.col("hit") / F.col("seen"))
    return rules.where(F.col("confidence") >= limits.min_confidence).select(
        F.xxhash64("tokens").alias("rule_id"), "tokens", F.size("tokens").alias("n_tokens"),
        (F.col("hit") / F.lit(n)).alias("support"), "confidence")


def bounded(small: DataFrame) -> DataFrame:
    """Broadcast a checkpointed table if it is small, else leave it to a shuffle join."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def judge_urls(pages: DataFrame, labelled: DataFrame, url: str = "url", labelled_url: str = "url",
               blocked: str = "blocked", limits: Limits = Limits()) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Verdicts of mined rules are worked out once for each distinct set of rule tokens, so what is
    exploded and grouped does not grow with the pages that share a host."""
    rules = cut_lineage(mine_rules(labelled, labelled_url, blocked, limits))
    index = cut_lineage(rules.select("rule_id", "n_tokens", F.explode("tokens").alias("token")))
    # A token of a rule occurs in min_support of the labelled URLs at least, so there are few of them.
    known = F.array(*[F.lit(r[0]) for r in index.select("token").distinct().orderBy("token").collect()]).cast(
        "array<string>")
    u = F.col(quoted(url))
    key = free_name(pages, "_rule_tokens")
    joined = F.array_join(F.array_sort(F.array_intersect(tokens_of(u), known)), " ")
    rows = pages.withColumn(key, F.coalesce(joined, F.lit("")))
    sets = rows.select(F.col(key).alias("met")).distinct()
    hits = (sets.select("met", F.explode(F.split("met", " ")).alias("token")).join(bounded(index), "token")
            .groupBy("met", "rule_id", "n_tokens").agg(F.count("*").alias("n")).where("n = n_tokens"))
    caught = free_name(pages, "_caught")
    held = cut_lineage(hits.select(F.col("met").alias(caught)).distinct())
    rows = rows.join(bounded(held), F.col(key) == F.col(caught), "left")
    rule, listed = listed_rule(F.col("host"), F.col("path"))
    parts = F.struct(host_of(u).alias("host"), path_of(u).alias("path"))
    out = with_fields(rows, parts, ["host", "path"]).withColumn("rule", rule).withColumn(
        "verdict", F.coalesce(listed, F.when(F.col(caught).isNotNull(), F.lit("block")).otherwise(F.lit("allow"))))
    return out.drop(key, caught)
