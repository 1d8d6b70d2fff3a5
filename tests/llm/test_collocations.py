import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.conftest import SMOKE
from tests.llm.helpers import ROWS, clashing, docs

from corpusvox.llm import collocations as C

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def brute(rows, min_count, top=2000, longest=5, percent=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(str.maketrans(UP, LOW))):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang][tuple(w[i:i + m])] += 1
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        inner = defaultdict(int)
        for p, a in cands.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i:i + m]] = max(inner[p[i:i + m]], a)
        best = []
        for p, a in cands.items():
            if percent * a <= 100 * inner.get(p, -1):
                continue
            score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]])
                                 for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def got(df, **kw):
    return sorted(tuple(r) for r in C.collocations(df, **kw).collect())


@pytest.mark.parametrize("min_count,top", [(20, 2000), (5, 7)])
def test_equals_brute_force_on_whole_documents(spark, min_count, top):
    df = spark.read.parquet(f"{SMOKE}/documents.parquet")
    rows = [(r.text, r.lang) for r in df.collect()]
    want = brute(rows, min_count, top)
    assert want and got(df, min_count=min_count, top=top) == want


def test_odd_rows_ties_overlaps_and_clashing_names(spark):
    rows = [*ROWS, (9, "A a a a. a\ta\x0ba a", "xx"), (9, "a a A a. a\ta\x0ba a", "xx"), (10, "x y, x y; x y", None),
            (11, "x y", "und"), (12, "é  É ü� 日本 日本", "xx")]
    df = docs(spark, rows)
    want = brute([(t, lang) for _, t, lang in rows], 2)
    assert any(p == "a a a a" for _, _, p, *_ in want)
    assert got(df, min_count=2) == want
    assert got(clashing(df, "h", "n", "phrase", "size", "a", "doc"), min_count=2) == want
    assert got(docs(spark, [])) == [] and got(docs(spark, [(1, None, None), (2, "", "en")]), min_count=1) == []
    half = brute([(t, lang) for _, t, lang in rows], 2, percent=50)
    assert got(df, min_count=2, covered_percent=50) != [] and len(half) >= 1


def test_pointers_show_an_occurrence(spark):
    df = spark.read.parquet(f"{SMOKE}/documents.parquet").where("doc_id % 3 = 0")
    texts = {r.doc_id: r.text for r in df.collect()}
    phrases, totals = C.phrase_counts(df, min_count=30)
    rows = phrases.collect()
    assert len(rows) > 50
    for r in rows:
        words = re.findall(r"[^\x20\x09.,;:!?\x0A-\x0D]+", texts[r.doc].translate(str.maketrans(UP, LOW)))
        assert " ".join(words[r.word:r.word + r["size"]]) == r.phrase
    assert {r.lang: r.n for r in totals.collect()}["en"] > 0


class Local:
    """Runs a task function on Arrow batches without Spark."""

    def __init__(self, rows):
        self.batch = pa.RecordBatch.from_arrays(
            [pa.array([t.encode() for t, _ in rows]), pa.array([x for _, x in rows]), pa.array(range(len(rows)))],
            names=["text", "lang", "doc"])

    def mapInArrow(self, f, _):
        return [r for b in f(iter([self.batch.slice(i, 2) for i in range(0, len(self.batch), 2)])) for r in b.to_pylist()]


class Shared:
    def __init__(self, value):
        self.value = value


ALL = [Shared(np.full(64, 2**64 - 1, np.uint64))] * 3


def counted(rows):
    out = Counter()
    for r in C.exact_counts(Local(rows), ALL, 5):
        for lang, phrase, a in zip(r["lang"], r["phrase"], r["a"], strict=True):
            out[lang, phrase] += a
    return out


@pytest.mark.parametrize("chunk,held", [(1, 1), (10, 4), (1 << 20, 1 << 20)])
def test_colliding_fingerprints_are_told_apart(monkeypatch, chunk, held):
    rows = [("one two three. one two", "a"), ("three two one two three", "a"), ("one two", "b"), ("x " * 9, "b"),
            ("long" * 30 + "a " + "long" * 30 + "b", "b")]
    monkeypatch.setattr(C, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(C, "HELD", held)
    plain = counted(rows)
    assert plain["a", "one two"] == 3 and plain["b", "x x x"] == 7 and plain["a", "two three"] == 2
    monkeypatch.setattr(C.Words, "grams", lambda self, n: np.arange(max(0, self.n - n + 1), dtype=np.uint64) % np.uint64(2))
    assert counted(rows) == plain
    monkeypatch.setattr(C, "mixed", lambda h: h % np.uint64(2))
    assert counted(rows) == plain


def test_fingerprint_counts_sum_up_over_chunks(monkeypatch):
    rows = [("a b c a b. a b", "x"), ("b a b, a", "x"), ("a b", "y")]
    monkeypatch.setattr(C, "CHUNK_BYTES", 3)
    monkeypatch.setattr(C, "HELD", 2)
    sums = Counter()
    for r in C.fingerprint_counts(Local(rows), 2, None, 7):
        h, n = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int64)
        assert all(x * 7 >> 64 in (r["bucket"], r["bucket"] + 1) for x in h.tolist())
        sums.update(dict(zip(h.tolist(), n.tolist(), strict=True)))
    assert sorted(sums.values()) == [1, 1, 1, 1, 4]


def test_scores_are_exact_beyond_64_bits(spark):
    a, n, l, r = 123456789012345, 98765432109876543, 123456789012399, 223456789012345
    df = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    got = df.select(C.score_of(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("s")).first().s
    assert got == 1000 * a * n // (l * r)
