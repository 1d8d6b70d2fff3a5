import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tests.conftest import SMOKE
from tests.llm.helpers import ROWS, clashing, docs

from corpusvox.llm import byte_bpe as B
from corpusvox.llm.queries import QUERIES


@pytest.fixture(scope="module")
def vocabulary():
    return B.load_vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    ranks = dict(zip(vocabulary.tokens, vocabulary.ids, strict=True))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(7)
    every = [*range(1, 0xD800), *range(0xE000, 0x110000)]
    yield from ("", "a", "<|endoftext|> I'll we've THEY'RE", "Hello  world's \n\n x\t", " " * 777 + "x", "日本語" * 200,
                "a" * 3000, "ab" * 500, "===" * 400, "0123456789" * 50, "՘࢏abc Ᲊx½ \u0085")
    yield "".join(chr(rnd.choice(every)) for _ in range(5000))
    for letters in ("abehnrst", "thein", "the ", "aab"):
        yield "".join(rnd.choice(letters) for _ in range(2000))


@pytest.mark.parametrize("long,kept", [(64, 400_000), (0, 2), (10_000, 50)])
def test_tokens_equal_the_library(monkeypatch, vocabulary, library, long, kept):
    monkeypatch.setattr(B, "LONG", long)
    monkeypatch.setattr(B, "KEPT_WORDS", kept)
    monkeypatch.setattr(B, "SLICE_BYTES", 5000)
    coder = B.Coder(vocabulary, B.merge_table(vocabulary))
    every = [t for t in texts() if long < 10_000 or len(t) < 1000]
    for some in ([t] for t in every):
        ids, decoded = coder.encode([t.encode() for t in some])
        assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in some]
        assert decoded == [t.encode() for t in some]
    ids, decoded = coder.encode([t.encode() for t in every])
    assert [i.tolist() for i in ids] == [library.encode_ordinary(t) for t in every]
    assert coder.decode(B.lists(ids)) == decoded == [t.encode() for t in every]


def test_contracting_all_of_a_rank_stops_at_a_lesser_one(monkeypatch):
    """Merges whose result is joined at a lesser rank before the next pair of the first rank."""
    rnd = random.Random(3)
    for _ in range(12):
        tokens = [bytes([i]) for i in range(256)]
        letters = [b"a", b"b", b"c"]
        more = {b"".join(rnd.choice(letters) for _ in range(rnd.randint(2, 5))) for _ in range(25)}
        tokens += rnd.sample(sorted(more), len(more))
        v = B.Vocabulary(tokens, list(range(len(tokens))), r"\S+", {})
        word = "".join(rnd.choice("abc") for _ in range(120))
        library = tiktoken.Encoding("x", pat_str=v.pattern, mergeable_ranks=dict(zip(tokens, v.ids)), special_tokens={})
        for long in (0, 1000):
            monkeypatch.setattr(B, "LONG", long)
            got = B.Coder(v, B.merge_table(v)).encode([word.encode()])[0][0].tolist()
            assert got == library.encode_ordinary(word)


def test_stand_ins_follow_the_library(vocabulary, library):
    assert all(library.encode_ordinary(f"x{chr(c)}1") for c in list(vocabulary.stand_ins)[:5])
    coder = B.Coder(vocabulary, B.merge_table(vocabulary))
    for c in list(vocabulary.stand_ins)[::97]:
        t = f"ab{chr(c)}cd 1{chr(c)}2 {chr(c)}"
        assert coder.encode([t.encode()])[0][0].tolist() == library.encode_ordinary(t)


def test_query_on_whole_documents(spark, library):
    want = set()
    for r in spark.read.parquet(f"{SMOKE}/documents.parquet").collect():
        ids = library.encode_ordinary(r.text or "")
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                  hashlib.sha256((r.text or "").encode()).hexdigest()))
    got = QUERIES["op11_byte_bpe"](spark, SMOKE)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "string", "string"]
    assert {tuple(r) for r in got.collect()} == want


def test_odd_rows_and_clashing_names(spark, vocabulary, library):
    out = B.encode(clashing(docs(spark), "ids", "decoded", "Pos", "_text_bytes"), vocabulary)
    assert out.columns == ["doc_id", "text", "lang", "Pos", "_text_bytes", "ids", "decoded"]
    rows = out.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    back = B.decode(clashing(out.drop("decoded"), "decoded"), vocabulary).collect()
    assert sorted(bytes(r.decoded) for r in back) == sorted(bytes(r.decoded) for r in rows)
    assert B.encode(docs(spark, []), vocabulary).count() == 0


def test_decode_leaves_out_unknown_ids(vocabulary):
    coder = B.Coder(vocabulary, B.merge_table(vocabulary))
    lists = pa.array([[0, None, 1 << 20, 1], None, [], [5]], pa.list_(pa.int32()))
    one = dict(zip(vocabulary.ids, vocabulary.tokens, strict=True))
    assert coder.decode(lists) == [one[0] + one[1], b"", b"", one[5]]


def test_a_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        B.Coder(B.Vocabulary([b"a"], [0], r"\S+", {}), np.zeros((0, 3), np.int32))
