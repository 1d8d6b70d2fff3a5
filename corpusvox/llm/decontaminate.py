"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ``size`` consecutive item words (a shorter item is one window).
Windows of equal length form one table set: the block shift table tells how far the search
may jump after a block of two words, the suffix-hash buckets hold the windows that end with
a block, split by their first word, and a direct comparison confirms an occurrence.

Defined results: a null text has no words; an item without words has no window; a null item
id is written as an empty string; repeated items count once; repeated documents each get a
row; an empty benchmark hits nothing; columns of the input that carry a result's name are
replaced, other extra columns pass through.

The documents are not shuffled.  The windows go to the executors in broadcast blocks of
``block_windows`` at most (in expectation); several blocks are searched one after the other
over the same rows, so a larger benchmark costs passes, not memory.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from corpusvox.llm.common import quoted, rows_udf, with_fields

WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
SPAN = StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])
HITS = StructType([StructField("n_words", LongType()), StructField("n_hit", LongType()),
                   StructField("items", ArrayType(StringType())), StructField("spans", ArrayType(SPAN))])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class WuManber:
    """Search tables for patterns of one length over word numbers (0: not a pattern word)."""

    def __init__(self, length: int, n_ids: int) -> None:
        self.length, self.block, self.base = length, min(2, length), n_ids + 1
        self.far = length - self.block + 1
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[list[int], set[str]]]]] = {}

    def add(self, pattern: list[int], item: str) -> None:
        for end in range(self.block, self.length + 1):
            key = self.key(pattern, end - 1)
            self.shift[key] = min(self.shift.get(key, self.far), self.length - end)
        same_prefix = self.buckets.setdefault(self.key(pattern, self.length - 1), {}).setdefault(pattern[0], [])
        for known, items in same_prefix:
            if known == pattern:
                items.add(item)
                return
        same_prefix.append((pattern, {item}))

    def key(self, ids: list[int], at: int) -> int:
        return ids[at] if self.block == 1 else ids[at - 1] * self.base + ids[at]

    def search(self, ids: list[int], spans: list[tuple[int, int]], found: set[str]) -> None:
        m, one, base, far, shift = self.length, self.block == 1, self.base, self.far, self.shift
        at, n = m - 1, len(ids)
        while at < n:
            key = ids[at] if one else ids[at - 1] * base + ids[at]
            jump = shift.get(key, far)
            if jump:
                at += jump
                continue
            start = at - m + 1
            for pattern, items in self.buckets[key].get(ids[start], ()):
                if ids[start:at + 1] == pattern:
                    spans.append((start, at + 1))
                    found |= items
                    break
            at += 1


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans made one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def tables_of(windows: list[tuple[str, list[str]]]) -> tuple[dict[bytes, int], list[WuManber]]:
    """Word numbers from 1 on, and one table set for each window length."""
    ids: dict[bytes, int] = {}
    for _, words in windows:
        for w in words:
            ids.setdefault(w.encode(), len(ids) + 1)
    by_length: dict[int, WuManber] = {}
    for item, words in windows:
        table = by_length.setdefault(len(words), WuManber(len(words), len(ids)))
        table.add([ids[w.encode()] for w in words], item)
    return ids, list(by_length.values())


def word_array(text: Column) -> Column:
    """The lower-cased (A-Z only) words of a text as Spark sees them."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", -1), lambda w: w != "")


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = 10) -> DataFrame:
    """(item, window) for each distinct window of each item."""
    words = benchmark.select(F.coalesce(F.col(quoted(item)).cast("string"), F.lit("")).alias("item"),
                             word_array(F.col(quoted(text))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    return words.select("item", F.explode(F.transform(
        starts, lambda i: F.slice("w", i, size))).alias("window")).distinct()


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                       item_text: str = "text", size: int = 10, block_windows: int = 250_000) -> DataFrame:
    """``docs`` with n_words, n_hit (words inside an occurrence), n_items, items (sorted ids),
    spans (united word spans) and contaminated."""
    sc = docs.sparkSession.sparkContext
    windows = item_windows(benchmark, item, item_text, size)
    n_blocks = max(1, -(-windows.count() // block_windows))
    names = [f.name for f in HITS.fields]
    out = docs
    for block in range(n_blocks):
        part = windows if n_blocks == 1 else windows.where(
            F.pmod(F.xxhash64("window"), F.lit(n_blocks)) == block)
        shared = sc.broadcast([(r["item"], list(r["window"])) for r in part.collect()])

        def make(shared=shared):
            ids, tables = tables_of(shared.value)

            def one(data: bytes | None, before: dict | None) -> tuple:
                words = WORD_BYTES.findall(data.lower()) if data else []
                numbers = [ids.get(w, 0) for w in words]
                spans = [(s["start"], s["end"]) for s in before["spans"]] if before else []
                found = set(before["items"]) if before else set()
                for t in tables:
                    t.search(numbers, spans, found)
                spans = united(spans)
                return (len(words), sum(b - a for a, b in spans), sorted(found),
                        [{"start": a, "end": b} for a, b in spans])
            return lambda data, before: [one(*x) for x in zip(data, before, strict=True)]

        earlier = F.struct(*[F.col(n) for n in names]) if block else F.lit(None).cast(HITS)
        find = rows_udf(make, HITS, n_args=2)
        out = with_fields(out, find(F.col(quoted(text)).cast("binary"), earlier), names)
    return (out.withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", F.col("n_hit") > 0))
