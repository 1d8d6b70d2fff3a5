import zlib

from tests.llm.helpers import clashing, docs

from corpusvox.llm.language import Limits, Model, fit, identify, predictor

WORDS = {"aa": "kala mala tala sala rala".split(), "bb": "pite mite vite site rite".split()}


def rows():
    out = []
    for i in range(120):
        lang = "aa" if i % 2 else "bb"
        w = WORDS[lang]
        out.append((i, " ".join(w[(i * 7 + k * k) % 5] for k in range(12)) + ".", lang))
    return out


def test_held_out_texts_are_recognised_and_labels_are_not_looked_at(spark):
    df = docs(spark, rows())
    got = {r.doc_id: r for r in identify(df).collect()}
    for i, _, lang in rows():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert got[i].lang_pred == lang and 0.5 < got[i].score <= 1
    swapped = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows()]
    again = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs(spark, swapped)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_unseen_words_fall_back_to_n_grams(spark):
    model = fit(docs(spark, rows()))
    predict = predictor(model)
    assert predict("zala")[0] == "aa" and predict("zite")[0] == "bb"
    assert predict("kala mala")[1] > 0.9
    assert predict("ЖЖЖ") == ("aa", 0.5)  # letters of no known n-gram: a tie, first by name


def test_odd_rows(spark):
    df = clashing(docs(spark), "score", "lang_pred", "held_out")
    got = {(r.doc_id, r.text): r for r in identify(df).collect()}
    assert len(got) == 9
    for key in ((2, None), (3, ""), (4, " \t\n ")):
        assert got[key].lang_pred == "und" and got[key].score == 0
    assert got[(None, "no id here at all, only some words")].held_out is False
    assert identify(docs(spark, [])).count() == 0
    nothing = docs(spark, [(1, "some words", None)])
    assert [(r.lang_pred, r.score) for r in identify(nothing).collect()] == [("und", 0.0)]


def test_the_model_is_bounded(spark):
    model = fit(docs(spark, rows()), limits=Limits(max_words=4, max_grams=6))
    assert isinstance(model, Model) and len(model.word_row) <= 4 and len(model.gram_row) <= 6
