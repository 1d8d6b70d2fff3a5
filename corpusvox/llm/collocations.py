"""Phrase collocation mining with Rabin-Karp fingerprints.

Texts are lower-cased (A-Z only), split into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into
words ``[^\\x20\\x09]+``.  A numpy prefix polynomial over the bytes gives every word its hash
and a second one over the word hashes gives every n-gram its 64-bit fingerprint, in one
multiplication each.  The work runs in levels:

1. Level n counts the fingerprints of the n-grams whose two (n-1)-grams may be frequent.
   Each task sums its own first and writes them as arrays, one row for each range of hash
   values; a range is merged in one place, and sums of ``min_count`` or more are frequent.
   There are two ranges for each shuffle partition.
2. The frequent fingerprints of a level become a Bloom filter for the next one.  The filter
   has at most ``MAX_BITS`` bits however many there are, so what is broadcast is bounded; a
   false positive costs a counted fingerprint and changes no result, and there are no false
   negatives.
3. The last pass reads the texts again.  Each task takes the n-grams that pass the filters,
   compares their words one by one with the representative of their fingerprint (colliding
   n-grams get entries of their own) and materialises each distinct phrase once, with its
   count and a pointer (document, word) to an occurrence.  The counts are then summed by
   language and *text*, so a collision can neither join nor split phrases.

``f`` of every part of a frequent phrase is at least that of the phrase, so the parts' counts
are in the same table: scores are equi-joins, exact in decimal arithmetic.  A join key that many
phrases share (a common first word) is split by AQE's skew join.

Defined results: a null text is empty; a null lang is ``und`` and shares the group of rows
that say ``und``; ids may be null or repeated (they only serve the pointers); repeated rows
count each time; an empty table gives no phrases.  Only the three named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusvox.llm.common import BROADCAST_ROWS, quoted, shuffle_partitions
from corpusvox.session import cut_lineage

#: Bytes of text hashed at once; a piece is never cut, so a longer piece makes a longer chunk.
CHUNK_BYTES = 4 << 20
#: Fingerprints or phrases a task holds before it writes them out.
HELD = 2_000_000
#: Bits of a filter at most (8 MiB).
MAX_BITS = 1 << 26
PROBES = 5
#: Stands for a null id in arrays.
NO_ID = np.iinfo(np.int64).min

#: Byte classes: 1 parts words, 2 parts pieces.
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER = bytes(range(256)).lower()
BLANKS = bytes(32 if k else i for i, k in enumerate(KIND.tolist()))
PIECE_END = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")

BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
LOW = np.uint64(0xFFFFFFFF)
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Powers:
    """base**i and base**-i modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.up, self.down = base, powers(base, 0), powers(base, 0)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = powers(self.base, n), powers(pow(self.base, -1, 1 << 64), n)
        return self.up[:n], self.down[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


class Words:
    """The words of a chunk: byte spans, pieces, documents, and prefix polynomials."""

    def __init__(self, data: bytes, starts: np.ndarray, seeds: np.ndarray, bytes_: Powers, words: Powers) -> None:
        """``starts``: where each document of the chunk begins; ``seeds``: a number for its language."""
        self.data = data.translate(LOWER)
        raw = np.frombuffer(self.data, np.uint8)
        kind = KIND[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = kind == 0
        edges = np.diff(inside)
        self.at, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.n = len(self.at)
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[self.at]
        self.doc = np.searchsorted(starts, self.at, "right") - 1
        self.seed = seeds[self.doc]
        up, down = bytes_.upto(len(raw) + 1)
        sums = prefix_sums((raw.astype(np.uint64) + np.uint64(1)) * up[:-1])
        self.hash = mixed((sums[self.end] - sums[self.at]) * down[self.at])
        self.up, self.down = words.upto(self.n + 1)
        self.sums = prefix_sums(self.hash * self.up[:-1])

    def grams(self, n: int) -> np.ndarray:
        """Fingerprints of the n-grams that start at words 0 .. self.n - n."""
        k = max(0, self.n - n + 1)
        h = (self.sums[n:n + k] - self.sums[:k]) * self.down[:k]
        return mixed(h + self.seed[:k] + np.uint64(n))

    def whole(self, n: int) -> np.ndarray:
        """Starts of the n-grams that lie inside one piece."""
        k = max(0, self.n - n + 1)
        return np.flatnonzero(self.piece[:k] == self.piece[n - 1:n - 1 + k])

    def starts(self, n: int, bits: np.ndarray | None) -> np.ndarray:
        """Starts of the n-grams in one piece whose first and last n - 1 words pass the filter ``bits``."""
        here = self.whole(n)
        if bits is None:
            return here
        may = np.zeros(self.n + 1, bool)
        may[passing(self.grams(n - 1), bits)] = True
        return here[may[here] & may[here + 1]]


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(Words, language of each document, ids, first word of each document) for chunks of a task's texts.

    A text longer than a chunk is cut after a piece, so no n-gram is lost."""
    byte_powers, word_powers = Powers(BYTE_BASE), Powers(WORD_BASE)
    numbers: dict[str, np.uint64] = {}
    held: list[bytes] = []
    of: list[tuple[int | None, str, int]] = []
    size = 0

    def seed(lang: str) -> np.uint64:
        if lang not in numbers:
            data = np.frombuffer(lang.encode() + b"\x01", np.uint8).astype(np.uint64)
            total = np.sum((data + np.uint64(1)) * powers(BYTE_BASE, len(data)), dtype=np.uint64)
            numbers[lang] = mixed(np.array([total], np.uint64))[0]
        return numbers[lang]

    def made() -> tuple:
        data = b"\n".join(held)
        starts = np.cumsum([0] + [len(x) + 1 for x in held[:-1]])
        words = Words(data, starts, np.array([seed(lang) for _, lang, _ in of], np.uint64), byte_powers, word_powers)
        first = np.searchsorted(words.doc, np.arange(len(held)))
        offsets = np.array([before for *_, before in of])
        return words, [lang for _, lang, _ in of], [i for i, *_ in of], first - offsets

    for batch in batches:
        ids = batch.column(2).to_pylist()
        for text, lang, doc in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ids, strict=True):
            before, at = 0, 0
            while text and at < len(text):
                stop = len(text)
                if stop - at > CHUNK_BYTES:
                    stop = piece_end(text, at + CHUNK_BYTES)
                part = text if stop - at == len(text) else text[at:stop]
                held.append(part)
                of.append((doc, lang, before))
                size += len(part) + 1
                at = stop
                if size >= CHUNK_BYTES:
                    out = made()
                    before += out[0].n - int(np.searchsorted(out[0].doc, len(held) - 1)) if at < len(text) else 0
                    yield out
                    held, of, size = [], [], 0
    if held:
        yield made()


def piece_end(text: bytes, at: int) -> int:
    """The end of the piece that holds byte ``at``, its separator included."""
    found = PIECE_END.search(text, at)
    return found.end() if found else len(text)


def passing(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Indices of the fingerprints that may be in the filter ``bits`` (64-bit words, a power of two of them)."""
    at = np.arange(len(h))
    for i in range(PROBES):
        some = h[at]
        place = ((some >> np.uint64(32)) + np.uint64(i) * ((some & LOW) | np.uint64(1))) & np.uint64(len(bits) * 64 - 1)
        at = at[(bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
    return at


def changes(h: np.ndarray) -> np.ndarray:
    """Where sorted values begin anew."""
    out = np.ones(len(h), bool)
    out[1:] = h[1:] != h[:-1]
    return out


def summed(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``h``, ascending, with the sums of ``n``."""
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(changes(h))
    return h[first], np.add.reduceat(n[order], first) if len(h) else n


#: A task's sums for one range of fingerprints: whole arrays in a row, so that rows stay few.
PACKED = "bucket long, h binary, n binary"
COUNTED = "h long, n long"
TOTALS = "lang string, n long"


def buckets_of(h: np.ndarray, n_buckets: int) -> list[tuple[int, slice]]:
    """The non-empty ranges of sorted fingerprints, cut into ``n_buckets`` equal ranges of hash values."""
    width = (1 << 64) // n_buckets + 1
    cuts = np.searchsorted(h, np.array([i * width for i in range(1, n_buckets)], np.uint64))
    ends = [0, *cuts.tolist(), len(h)]
    return [(i, slice(a, b)) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]


def fingerprint_counts(docs: DataFrame, n: int, before, n_buckets: int) -> DataFrame:
    """(bucket, h, n): each task's fingerprints of length ``n`` and their counts.

    ``before`` is the broadcast filter of length n - 1 (none for single words)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = before.value if before else None
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def written(h, c) -> Iterator[pa.RecordBatch]:
            for bucket, s in buckets_of(h, n_buckets):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket]), pa.array([h[s].tobytes()]), pa.array([c[s].tobytes()])], names=["bucket", "h", "n"])

        for words, *_ in chunks_of(batches):
            h = words.grams(n)[words.starts(n, bits)]
            held.append(summed(h, np.ones(len(h), np.int64)))
            size += len(held[-1][0])
            if size > HELD:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
                if size > HELD // 2:
                    yield from written(*held[0])
                    held, size = [], 0
        if held:
            yield from written(*summed(*map(np.concatenate, zip(*held, strict=True))))
    return docs.mapInArrow(count, PACKED)


def frequent_fingerprints(packed: DataFrame, min_count: int) -> DataFrame:
    """(h, n): the fingerprints whose counts sum to ``min_count`` or more."""
    def merge(rows: pa.Table) -> pa.Table:
        h, n = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("h", np.uint64), ("n", np.int64)))
        h, n = summed(h, n)
        kept = n >= min_count
        return pa.table({"h": h[kept].view(np.int64), "n": n[kept]})
    return packed.groupBy("bucket").applyInArrow(merge, COUNTED)


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, n): all words of each language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[lang] = totals.get(lang, 0) + (len(text.translate(BLANKS).split()) if text else 0)
        yield pa.RecordBatch.from_pydict({"lang": list(totals), "n": list(totals.values())},
                                         schema=pa.schema([("lang", pa.string()), ("n", pa.int64())]))
    return docs.mapInArrow(count, TOTALS).groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")


def filter_bits(h: DataFrame, n_rows: int) -> np.ndarray:
    """A Bloom filter over the longs of ``h``, set in Spark; only its words reach the driver."""
    n_bits = 1 << 12
    while n_bits < min(12 * n_rows, MAX_BITS):
        n_bits *= 2
    low, step = F.shiftrightunsigned("h", 32), F.col("h").bitwiseAND((1 << 32) - 1).bitwiseOR(1)
    places = F.array(*[(low + F.lit(i) * step).bitwiseAND(n_bits - 1) for i in range(PROBES)])
    mask = F.expr("shiftleft(1L, cast(place % 64 as int))")
    words = (h.select(F.explode(places).alias("place")).select(F.shiftright("place", 6).alias("at"), mask.alias("m"))
             .groupBy("at").agg(F.bit_or("m").alias("m")).toArrow())
    bits = np.zeros(n_bits // 64, np.uint64)
    bits[words.column("at").to_numpy()] = words.column("m").to_numpy().view(np.uint64)
    return bits


class Lexicon:
    """Exact numbers of a task's words: a word hash is trusted only after its bytes were compared."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.words: list[bytes] = []

    def number(self, w: bytes) -> int:
        i = self.ids.get(w)
        if i is None:
            i = self.ids[w] = len(self.words)
            self.words.append(w)
        return i

    def numbers(self, words: Words, picked: np.ndarray) -> np.ndarray:
        """A number for each of the ``picked`` words (-1 for the others)."""
        out = np.full(words.n, -1, np.int64)
        at, end, data = words.at, words.end, words.data
        order = picked[np.argsort(words.hash[picked], kind="stable")]
        h = words.hash[order]
        first = changes(h)
        heads = order[first]
        known = np.array([self.number(data[a:b]) for a, b in zip(at[heads].tolist(), end[heads].tolist(), strict=True)],
                         np.int64)
        group = np.cumsum(first) - 1
        rep, out[order] = heads[group], known[group]
        size = end[order] - at[order]
        wrong = size != end[rep] - at[rep]
        raw = np.frombuffer(data, np.uint8)
        live = np.flatnonzero(~wrong)
        for j in range(64):
            live = live[size[live] > j]
            if not len(live):
                break
            wrong[live] |= raw[at[order[live]] + j] != raw[at[rep[live]] + j]
        for i in np.flatnonzero(wrong | (size > 64)).tolist():
            w = order[i]
            out[w] = self.number(data[at[w]:end[w]])
        return out


PACKED_PHRASES = "bucket long, lang array<string>, phrase array<string>, size array<int>, a array<long>, doc array<long>, word array<long>"
PHRASES = "lang string, size int, phrase string, a long, doc long, word long"
COLUMNS = ("lang", "phrase", "size", "a", "doc", "word")


def exact_counts(docs: DataFrame, filters: list, n_buckets: int) -> DataFrame:
    """(bucket, lists): for each task the n-grams that pass the filters, compared word by word, each
    with its count and a pointer (document, word) to an occurrence."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [f.value for f in filters]
        longest = len(bits)
        lexicon, numbers = Lexicon(), {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def written(h, c, keys, doc, word) -> Iterator[pa.RecordBatch]:
            names = list(numbers)
            for bucket, s in buckets_of(h, n_buckets):
                rows = keys[s]
                text = [b" ".join([lexicon.words[i] for i in r if i >= 0]).decode("utf-8", "replace")
                        for r in rows[:, 1:].tolist()]
                values = {"lang": [names[i] for i in rows[:, 0].tolist()], "phrase": text,
                          "size": (rows[:, 1:] >= 0).sum(axis=1).astype(np.int32), "a": c[s],
                          "doc": pa.array(doc[s], mask=doc[s] == NO_ID), "word": word[s]}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([bucket]), *[listed(values[k]) for k in COLUMNS]], names=["bucket", *COLUMNS])

        for words, langs, ids, first in chunks_of(batches):
            lang = np.array([numbers.setdefault(x, len(numbers)) for x in langs], np.int64)
            docs_of = np.array([NO_ID if i is None else i for i in ids], np.int64)
            number = lexicon.numbers(words, passing(words.grams(1), bits[0]))
            for n in range(1, longest + 1):
                here = words.whole(n)
                h = words.grams(n)[here]
                ok = passing(h, bits[n - 1])
                ok = ok[np.all([number[here[ok] + j] >= 0 for j in range(n)], axis=0)]
                here, h = here[ok], h[ok]
                keys = np.full((len(here), longest + 1), -1, np.int32)
                doc = words.doc[here]
                keys[:, 0] = lang[doc]
                for j in range(n):
                    keys[:, j + 1] = number[here + j]
                held.append(distinct(h, np.ones(len(h), np.int64), keys, docs_of[doc], here - first[doc]))
                size += len(held[-1][0])
            if size > HELD:
                held = [distinct(*map(np.concatenate, zip(*held, strict=True)))]
                size = len(held[0][0])
            if size > HELD // 2 or len(lexicon.words) > HELD // 4:
                yield from written(*distinct(*map(np.concatenate, zip(*held, strict=True))))
                held, size, lexicon = [], 0, Lexicon()
        if held:
            yield from written(*distinct(*map(np.concatenate, zip(*held, strict=True))))
    return docs.mapInArrow(count, PACKED_PHRASES)


def listed(values) -> pa.Array:
    flat = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)


def frequent_phrases(packed: DataFrame, min_count: int) -> DataFrame:
    """Counts summed by language and text; equal texts have equal fingerprints and so one bucket."""
    def merge(rows: pa.Table) -> pa.Table:
        flat = pa.table({c: pa.concat_arrays([x.flatten() for x in rows.column(c).chunks]) for c in COLUMNS})
        flat = flat.sort_by([("lang", "ascending"), ("phrase", "ascending"), ("doc", "ascending"), ("word", "ascending")])
        sums = flat.group_by(["lang", "phrase"], use_threads=False).aggregate(
            [("a", "sum"), ("size", "first"), ("doc", "first"), ("word", "first")])
        sums = sums.filter(pc.greater_equal(sums.column("a_sum"), min_count))
        return pa.table({"lang": sums.column("lang"), "size": sums.column("size_first"), "phrase": sums.column("phrase"),
                         "a": sums.column("a_sum"), "doc": sums.column("doc_first"), "word": sums.column("word_first")})
    return packed.groupBy("bucket").applyInArrow(merge, PHRASES)


def distinct(h: np.ndarray, n: np.ndarray, keys: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums of ``n`` by ``keys``: grouped by fingerprint, and each row's key compared with its group's first.

    ``rest`` keeps the first row's values."""
    if not len(h):
        return h, n, keys, *rest
    order = np.argsort(h, kind="stable")
    h, n, keys = h[order], n[order], keys[order]
    first = changes(h)
    at = np.flatnonzero(first)
    if not (keys == keys[at][np.cumsum(first) - 1]).all():  # fingerprints collide: order by the keys themselves
        again = np.lexsort([*keys.T[::-1], h])
        h, n, keys, order = h[again], n[again], keys[again], order[again]
        first[1:] = (h[1:] != h[:-1]) | (keys[1:] != keys[:-1]).any(axis=1)
        at = np.flatnonzero(first)
    return h[at], np.add.reduceat(n, at), keys[at], *[x[order[at]] for x in rest]


def score_of(a: Column, n: Column, l: Column, r: Column) -> Column:
    """floor(1000 * a * n / (l * r)), exact for counts under 10**17."""
    a, n, l, r = (c.cast("decimal(18,0)") for c in (a, n, l, r))
    return F.call_function("div", (a * n * F.lit(1000)).cast("decimal(38,0)"), (l * r).cast("decimal(38,0)"))


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                  max_words: int = 5, min_count: int = 100) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a, doc, word) of every phrase of 1 to ``max_words`` words that occurs
    ``min_count`` times or more, with a pointer to an occurrence; and (lang, n) of all words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(quoted(text)).cast("binary").alias("text"),
                       F.coalesce(F.col(quoted(lang)).cast("string"), F.lit("und")).alias("lang"),
                       F.col(quoted(doc_id)).cast("long").alias("doc"))
    n_buckets = 2 * shuffle_partitions(spark)
    filters = []
    for n in range(1, max_words + 1):
        packed = fingerprint_counts(rows, n, filters[-1] if filters else None, n_buckets)
        frequent = cut_lineage(frequent_fingerprints(packed, min_count))
        filters.append(spark.sparkContext.broadcast(filter_bits(frequent, frequent.count())))
    phrases = cut_lineage(frequent_phrases(exact_counts(rows, filters, n_buckets), min_count))
    for f in filters:
        f.unpersist()
    return phrases, word_totals(rows)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                 max_words: int = 5, min_count: int = 100, top: int = 2000, covered_percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 words or more of each lang.

    The score of a phrase is that of its lowest-scoring cut, the first of equals.  A phrase that
    lies inside a longer frequent one with at least ``covered_percent`` of its count is dropped."""
    phrases, totals = phrase_counts(docs, text, lang, doc_id, max_words, min_count)
    totals = cut_lineage(totals)
    found = phrases.where("size >= 2")
    words = F.split("phrase", " ", -1)
    cuts = found.withColumn("w", words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    parts = phrases.where(F.col("size") < max_words)
    cuts = (cuts.join(parts.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
            .join(parts.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"])
            .join(F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals, "lang"))
    cuts = cuts.withColumn("score", score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")))
    place = F.col("score") * 8 + F.col("k") if max_words <= 8 else F.col("score") * max_words + F.col("k")
    scored = cuts.withColumn("place", place).groupBy("lang", "phrase", "a", "n").agg(
        F.min_by("l", "place").alias("l"), F.min_by("r", "place").alias("r"), F.min("score").alias("score"))
    inner = found.where("size > 2").withColumn("w", words)
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    covers = inner.select("lang", F.explode(spans).alias("phrase"), "a").groupBy("lang", "phrase").agg(
        F.max("a").alias("longer"))
    left = scored.join(covers, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * covered_percent))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    deal = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(docs.sparkSession)))
    some = left.withColumn("deal", deal).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*best))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(
        F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
