import pytest
from tests.conftest import SMOKE
from tests.llm.helpers import clashing, docs

from corpusvox.llm.repeats import normalised, repeated_units, spans_of, units_of, without_repeats

A = " ".join(f"alpha{i}" for i in range(16))
B = " ".join(f"beta{i}" for i in range(16))


def test_units_keep_their_offsets():
    text = f"short\n{A}\n\n  {B.upper()}  "
    got = units_of(text, "line", 50)
    assert [text[u["start"]:u["end"]] for u in got] == [A, f"  {B.upper()}  "]
    assert units_of(f"{A}\n{B}\n \n{A}", "paragraph", 50)[0]["end"] == len(A) + 1 + len(B)
    assert normalised("  Ab\t c ") == "ab c"
    assert units_of(None) == units_of("") == []


def test_runs_of_sentences_begin_anywhere_and_reach_the_least_length():
    text = "One here. Two is here!\nThree? four. Five"
    got = [text[u["start"]:u["end"]] for u in units_of(text, "passage", 12)]
    assert got == ["One here. Two is here!", text, "Two is here!", "Three? four.", "Three? four. Five"]
    assert [(u["start"], u["end"]) for u in units_of("a. b. c", "passage", 1)] == [(0, 2), (0, 7), (3, 5), (6, 7)]


def brute(rows, unit, min_chars):
    """Repeated units by their normalised text, ranked as the operator ranks them."""
    first, found = {}, []
    keyed = sorted((i is None, i or 0, t or "") for i, t, *_ in rows)
    for none, i, t in keyed:
        for (a, b), plain in sorted(spans_of(t, unit, min_chars).items()):
            place = (none, i, t, a)
            if first.setdefault(plain, place) != place:
                found.append((None if none else i, a, b, first[plain][1], first[plain][3]))
    return sorted(found, key=repr)


@pytest.mark.parametrize("unit,min_chars", [("passage", 90), ("passage", 30), ("passage", 1), ("line", 1), ("paragraph", 20)])
def test_equals_brute_force_on_whole_documents(spark, unit, min_chars):
    df = spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text")
    got = [(r.doc_id, r.start, r.end, r.first_doc_id, r.first_start) for r in repeated_units(df, unit=unit, min_chars=min_chars).collect()]
    want = brute([tuple(r) for r in df.collect()], unit, min_chars)
    assert want and sorted(got, key=repr) == want


def test_a_passage_inside_longer_lines_is_found(spark):
    passage = " ".join(f"This is sentence {i} of a passage that repeats." for i in range(8))
    verse = "\n".join(f"short verse {i}" for i in range(12))
    rows = [(1, f"Own start of one. {passage} Own end of one.", "x"), (2, f"Another start, quite different. {passage} And an end.", "x"),
            (3, f"x\n{verse}\ny", "x"), (4, f"z\n{verse}\nzz", "x"), (5, "Clean text of its own. " * 1 + "Nothing here is shared with others at all, nothing.", "x")]
    got = {r.doc_id: (r.text, [tuple(x) for x in r.removed]) for r in without_repeats(docs(spark, rows)).collect()}
    assert got[1] == (rows[0][1], []) and got[3] == (rows[2][1], []) and got[5] == (rows[4][1], [])
    a = rows[1][1].index(passage)
    assert len(got[2][1]) == 1 and got[2][1][0][0] == a and got[2][1][0][1] >= a + len(passage) - 90
    assert "sentence 3" not in got[2][0] and "Another start" in got[2][0]
    assert "verse 5" not in got[4][0]


def test_first_occurrence_stays_and_the_rest_goes(spark):
    rows = [(2, f"{A}\nmine\n{B}", "x"), (1, f"{A.upper()}", "x"), (3, f"{B}\n{B}\nown words", "x"), (None, A, "x"),
            (4, None, "x"), (5, "", "x"), (6, "short\nshort", "x"), (7, f"{B}  end", "x"), (7, f"{B}  end", "x")]
    df = docs(spark, rows)
    kw = {"unit": "line", "min_chars": 50}
    got = {(r.doc_id, r.start, r.first_doc_id, r.first_start) for r in repeated_units(df, **kw).collect()}
    assert got == {(2, 0, 1, 0), (None, 0, 1, 0), (3, 0, 2, len(A) + 6), (3, len(B) + 1, 2, len(A) + 6)}
    out = without_repeats(clashing(df, "removed", "digest", "hash", "start"), **kw).collect()
    assert sorted((r.doc_id or 0, r.text) for r in out if r.text is not None) == sorted([
        (2, f"mine\n{B}"), (1, A.upper()), (3, "own words"), (0, ""), (5, ""), (6, "short\nshort"),
        (7, f"{B}  end"), (7, f"{B}  end")])
    assert all(r.removed == [] for r in out if r.doc_id in (1, 4, 5, 6, 7))
    assert [tuple(x) for r in out if r.doc_id == 2 for x in r.removed] == [(0, len(A))]
    assert [tuple(x) for r in out if r.doc_id == 3 for x in r.removed] == [(0, len(B)), (len(B) + 1, 2 * len(B) + 1)]


def test_every_unit_that_is_not_blank_counts_without_a_bound(spark):
    rows = [(1, "Short line\n\n \nsame\n東京都に住む人々は、\nend", "x"), (2, "short  LINE\n\nsame\n東京都に住む人々は、\n\nother", "x")]
    df = docs(spark, rows)
    kw = {"unit": "line", "min_chars": 1}
    assert repeated_units(df, unit="line").count() == 0
    got = {(r.doc_id, r.start, r.first_doc_id, r.first_start) for r in repeated_units(df, **kw).collect()}
    assert got == {(2, 0, 1, 0), (2, 13, 1, 14), (2, 18, 1, 19)}
    out = {r.doc_id: r.text for r in without_repeats(df, **kw).collect()}
    assert out == {1: rows[0][1], 2: "\n\nother"}
    verse = "a b\nc d"
    two = docs(spark, [(1, f"x\n\n{verse}", "x"), (2, f"{verse}\n \n y", "x")])
    assert [(r.doc_id, r.start, r.end) for r in repeated_units(two, unit="paragraph", min_chars=1).collect()] == [(2, 0, 7)]


def test_long_texts_and_repeats_inside_one(spark):
    long = "\n".join(f"{A} number {i % 50}." for i in range(20_000))
    got = without_repeats(docs(spark, [(1, long, "x"), (2, "own text", "x")])).collect()
    text = {r.doc_id: r.text for r in got}
    assert text[2] == "own text" and len(text[1]) < len(long) / 300


def test_empty_table(spark):
    assert repeated_units(docs(spark, [])).count() == 0
    assert without_repeats(docs(spark, [])).count() == 0
