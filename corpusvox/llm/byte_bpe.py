"""Byte-level BPE encoding and decoding by recursive DuckDB queries inside each partition's task.

A text is cut by the tokenizer's pattern; each match (a word, here) is encoded on its own.  A
word that is a token is that token.  Any other starts as one token per byte: rows (word,
position, token) that a recursive query joins with the merge table, every (left, right) pair of
tokens whose bytes together are a token.  Each step contracts the leftmost of a word's pairs of
least rank; a word without a pair is done.  Long words contract all pairs of the least rank at
once, from the left up to the first one whose contraction makes a pair of a lesser rank: that
is what one contraction at a time would do, in fewer steps.  Decoding joins token rows with
the vocabulary and concatenates the bytes in an aggregate ordered by position.

Words recur, so each distinct word is encoded and decoded once; a Python worker keeps its
database and up to about ``KEPT_WORDS`` words from task to task (they depend on nothing but the
vocabulary).  Documents are put together from their words' tokens and bytes.  Texts
are taken in groups of ``GROUP_BYTES`` and words in slices of ``SLICE_BYTES``, so memory is
bounded by these and by the longest text.  Nothing is shuffled.  The vocabulary and its merge
table, whose size is that of the vocabulary file, are broadcast.

Character classes follow the tiktoken library, whose Unicode tables may be older than those of
the ``regex`` module: the characters on which they differ are found by asking tiktoken, and
stand-ins of the right class are cut in their place.

Defined results: a null text encodes to no tokens and decodes to no bytes, like an empty one;
null ids decode to no bytes, and null or unknown ids inside a list are left out; repeated rows
each get a row; an empty table gives an empty result; special tokens are ordinary text; columns
named like a result are replaced, other columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from corpusvox.llm.common import free_name, quoted

GROUP_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
KEPT_WORDS = 900_000
#: Words of more bytes contract all pairs of the least rank in one step.
LONG = 64

#: A character of each class of the pattern: letter, number, white space, other.
STAND_INS = {"L": "é", "N": "½", "S": " ", "O": ""}


class Vocabulary(NamedTuple):
    tokens: list[bytes]
    ids: list[int]
    pattern: str
    stand_ins: dict[int, str]


def load_vocabulary(path: str, pattern: str) -> Vocabulary:
    """The tokens of a tiktoken rank file, and the characters to stand in for."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return Vocabulary([base64.b64decode(t) for t, _ in pairs], [int(i) for _, i in pairs], pattern, differing())


def differing() -> dict[int, str]:
    """Characters that tiktoken and the regex module put into different classes, with stand-ins."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    bytes_only = {bytes([i]): i for i in range(256)}
    theirs, ours = dict.fromkeys(every, "O"), dict.fromkeys(every, "O")
    for name, sign in (("L", r"\p{L}"), ("N", r"\p{N}"), ("S", r"\s")):
        found = tiktoken.Encoding(name, pat_str=f"{sign}+", mergeable_ranks=bytes_only, special_tokens={})
        theirs.update(dict.fromkeys(bytes(found.encode_ordinary(every)).decode(), name))
        ours.update(dict.fromkeys("".join(regex.findall(f"{sign}+", every)), name))
    return {ord(c): STAND_INS[theirs[c]] for c in every if theirs[c] != ours[c]}


def merge_table(vocabulary: Vocabulary) -> np.ndarray:
    """(left, right, merged) of every cut of a token into two tokens."""
    rank = dict(zip(vocabulary.tokens, vocabulary.ids, strict=True))
    rows = [(rank[t[:i]], rank[t[i:]], r) for t, r in rank.items() for i in range(1, len(t))
            if t[:i] in rank and t[i:] in rank]
    return np.array(rows, np.int32).reshape(-1, 3)


#: One contraction a word and step: the least (rank, position) of each word.
ONE_AT_A_TIME = """
WITH RECURSIVE t(wid, pos, id) USING KEY (wid, pos) AS (
  SELECT wid, pos, id FROM bytes_in
  UNION ALL
  SELECT wid, pos, CASE WHEN best & 4294967295 = pos THEN (best >> 32)::INTEGER
                        WHEN best & 4294967295 = before THEN NULL ELSE id END
  FROM (SELECT p.*, min((m.merged::BIGINT << 32) | p.pos) OVER (PARTITION BY p.wid) AS best
        FROM (SELECT wid, pos, id, lead(id) OVER o AS after_id, lag(pos) OVER o AS before
              FROM t WHERE id IS NOT NULL WINDOW o AS (PARTITION BY wid ORDER BY pos)) p
        LEFT JOIN merges m ON m.l = p.id AND m.r = p.after_id)
  WHERE best IS NOT NULL)
SELECT wid, pos, id FROM t WHERE id IS NOT NULL"""

#: All pairs of a word's least rank up to the first that makes a pair of a lesser one.  Pairs that
#: overlap are equal tokens in a row: every other one counts.
ALL_OF_A_RANK = """
WITH RECURSIVE t(wid, pos, id) USING KEY (wid, pos) AS (
  SELECT wid, pos, id FROM bytes_in
  UNION ALL
  SELECT wid, pos, CASE WHEN cut THEN low WHEN lag(cut) OVER (PARTITION BY wid ORDER BY i) THEN NULL ELSE id END
  FROM (SELECT wid, pos, i, id, low, taken AND coalesce(sum(stops::INTEGER) OVER (
                 PARTITION BY wid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS cut
        FROM (SELECT s.*, taken AND (coalesce(ml.merged < low, false) OR coalesce(mr.merged < low, false)) AS stops
              FROM (SELECT *, CASE WHEN lag(taken, 2) OVER o THEN low ELSE lag(id) OVER o END AS left_id,
                           lead(id, 2) OVER o AS right_id
                    FROM (SELECT *, hit AND row_number() OVER (PARTITION BY wid, hit, run ORDER BY i) % 2 = 1 AS taken
                          FROM (SELECT *, i - sum(hit::INTEGER) OVER (PARTITION BY wid ORDER BY i) AS run
                                FROM (SELECT *, coalesce(merged = low, false) AS hit
                                      FROM (SELECT p.*, m.merged, min(m.merged) OVER (PARTITION BY p.wid) AS low
                                            FROM (SELECT wid, pos, id, lead(id) OVER o AS after_id, row_number() OVER o AS i
                                                  FROM t WHERE id IS NOT NULL WINDOW o AS (PARTITION BY wid ORDER BY pos)) p
                                            LEFT JOIN merges m ON m.l = p.id AND m.r = p.after_id)
                                      WHERE low IS NOT NULL)))
                    WINDOW o AS (PARTITION BY wid ORDER BY i)) s
              LEFT JOIN merges ml ON ml.l = s.left_id AND ml.r = CASE WHEN s.taken THEN s.low END
              LEFT JOIN merges mr ON mr.l = CASE WHEN s.taken THEN s.low END AND mr.r = s.right_id)))
SELECT wid, pos, id FROM t WHERE id IS NOT NULL"""

#: The tokens of each key in order, and their bytes as hexadecimal digits.
IN_ORDER = """
SELECT k, list(id ORDER BY pos) AS ids, string_agg(hex, '' ORDER BY pos) AS hex FROM token_rows JOIN vocabulary USING (id)
GROUP BY k ORDER BY k"""


class Coder:
    """Encodes and decodes inside one task, with a database of its own."""

    def __init__(self, vocabulary: Vocabulary, merges: np.ndarray) -> None:
        self.con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        self.table("merges", l=merges[:, 0], r=merges[:, 1], merged=merges[:, 2])
        self.table("vocabulary", id=np.array(vocabulary.ids, np.int32), hex=[t.hex() for t in vocabulary.tokens])
        self.find = regex.compile(vocabulary.pattern).findall
        self.stand_ins = vocabulary.stand_ins
        self.odd = np.zeros(0x110000, bool)
        self.odd[list(self.stand_ins)] = True
        self.rank = dict(zip(vocabulary.tokens, vocabulary.ids, strict=True))
        self.byte_ids = np.array([self.rank.get(bytes([i]), -1) for i in range(256)], np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        self.forget()

    def table(self, name: str, **columns) -> None:
        data = pa.table(columns)
        self.con.register("_incoming", data)
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM _incoming")
        self.con.unregister("_incoming")

    def forget(self) -> None:
        """Drop the words kept so far."""
        self.known: dict[str, int] = {}
        self.flat, self.ends, self.texts = np.zeros(0, np.int32), np.zeros(1, np.int64), []

    def words(self, text: str) -> list[str]:
        if text.isascii() or not self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.find(text)
        at, out = 0, []
        for w in self.find(text.translate(self.stand_ins)):
            out.append(text[at:at + len(w)])
            at += len(w)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode and decode words that are not known yet, numbered on from the known ones."""
        at, size = 0, 0
        for i, w in enumerate(words):
            size += len(w)
            if size >= SLICE_BYTES or i == len(words) - 1:
                self.learn_slice([x.encode() for x in words[at:i + 1]])
                at, size = i + 1, 0

    def learn_slice(self, words: list[bytes]) -> None:
        whole = [self.rank.get(w, -1) for w in words]
        sizes = np.array([0 if r >= 0 else len(w) for r, w in zip(whole, words, strict=True)])
        rows = [(np.flatnonzero(np.array(whole) >= 0), None, np.array([r for r in whole if r >= 0], np.int32))]
        for some, query in ((sizes > LONG, ALL_OF_A_RANK), ((sizes > 0) & (sizes <= LONG), ONE_AT_A_TIME)):
            which = np.flatnonzero(some)
            if len(which):
                raw = np.frombuffer(b"".join([words[i] for i in which.tolist()]), np.uint8)
                n = sizes[which]
                pos = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
                self.table("bytes_in", wid=np.repeat(which, n).astype(np.int32), pos=pos.astype(np.int32), id=self.byte_ids[raw])
                got = self.con.execute(query).fetchnumpy()
                rows.append((got["wid"], got["pos"], got["id"]))
        self.table("token_rows", k=np.concatenate([k for k, _, _ in rows]).astype(np.int32),
                   pos=np.concatenate([np.zeros(len(k)) if p is None else p for k, p, _ in rows]).astype(np.int32),
                   id=np.concatenate([i for *_, i in rows]).astype(np.int32))
        ids, texts = self.in_order()
        self.flat = np.concatenate((self.flat, ids.flatten().to_numpy()))
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(ids.value_lengths().to_numpy())))
        self.texts += texts

    def in_order(self) -> tuple[pa.ListArray, list[bytes]]:
        got = self.con.sql(IN_ORDER).to_arrow_table().combine_chunks()
        return (got["ids"].combine_chunks() if isinstance(got["ids"], pa.ChunkedArray) else got["ids"],
                [bytes.fromhex(h) for h in got["hex"].to_pylist()])

    def encode(self, texts: list[bytes | None]) -> tuple[list[np.ndarray], list[bytes]]:
        """Token ids of each text, and the bytes that these decode to."""
        if len(self.known) > KEPT_WORDS:
            self.forget()
        known, fresh, numbers = self.known, len(self.known), []
        for t in texts:
            words = self.words(t.decode("utf-8", "replace")) if t else []
            numbers.append(np.array([known.setdefault(w, len(known)) for w in words], np.int64))
        self.learn(list(known)[fresh:])
        ids, decoded = [], []
        for w in numbers:
            first, n = self.ends[w], self.ends[w + 1] - self.ends[w]
            ids.append(self.flat[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)])
            decoded.append(b"".join([self.texts[i] for i in w.tolist()]))
        return ids, decoded

    def decode(self, ids: pa.ListArray) -> list[bytes]:
        """The bytes of each list of ids."""
        n = ids.value_lengths().fill_null(0).to_numpy()
        flat = ids.flatten()
        kept = ~flat.is_null().to_numpy(zero_copy_only=False)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n))[kept]
        self.table("token_rows", k=np.repeat(np.arange(len(n)), n)[kept].astype(np.int32), pos=pos.astype(np.int32),
                   id=flat.drop_null().cast(pa.int64()))
        got = self.con.sql(IN_ORDER).to_arrow_table()
        found = dict(zip(got["k"].to_pylist(), got["hex"].to_pylist(), strict=True))
        return [bytes.fromhex(found.get(i, "")) for i in range(len(n))]


def grouped(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches put together until their ``column`` holds ``GROUP_BYTES``."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= GROUP_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


#: The worker's coder, by the digest of its vocabulary.
KEPT: dict[str, Coder] = {}


def kept_coder(digest: str, shared) -> Coder:
    """This worker's coder for a vocabulary; one for another vocabulary makes room for it."""
    if digest not in KEPT:
        KEPT.clear()
        KEPT[digest] = Coder(*shared.value)
    return KEPT[digest]


def in_tasks(df: DataFrame, source: str, added: StructType, vocabulary: Vocabulary, work) -> DataFrame:
    """``df`` with the columns ``added`` that ``work(coder, array)`` makes of column ``source``."""
    shared = df.sparkSession.sparkContext.broadcast((vocabulary, merge_table(vocabulary)))
    digest = hashlib.sha256(repr(vocabulary).encode()).hexdigest()
    names = {f.name for f in added.fields}
    out = StructType([*[f for f in df.schema.fields if f.name.lower() not in names and f.name != source], *added.fields])
    kept = [f.name for f in out.fields[:len(out.fields) - len(added.fields)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in grouped(batches, source):
            new = work(kept_coder(digest, shared), b.column(b.schema.get_field_index(source)))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(b.schema.get_field_index(c)) for c in kept], *new], names=[f.name for f in out.fields])
    return df.mapInArrow(run, out)


def lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, np.int32)])))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (the bytes that the ids stand for)."""
    added = StructType([StructField("ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])
    source = free_name(docs, "_text_bytes")

    def work(coder: Coder, texts: pa.Array) -> list[pa.Array]:
        ids, decoded = coder.encode(texts.to_pylist())
        return [lists(ids), pa.array(decoded, pa.binary())]
    return in_tasks(docs.withColumn(source, F.col(quoted(text)).cast("binary")), source, added, vocabulary, work)


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the bytes of a column of token ids."""
    added = StructType([StructField("decoded", BinaryType())])
    source = free_name(rows, "_token_ids")

    def work(coder: Coder, lists: pa.Array) -> list[pa.Array]:
        return [pa.array(coder.decode(lists), pa.binary())]
    return in_tasks(rows.withColumn(source, F.col(quoted(ids))), source, added, vocabulary, work)
