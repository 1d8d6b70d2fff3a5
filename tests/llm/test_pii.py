import random
import re

import pytest
from tests.llm.helpers import clashing, docs

from corpusvox.llm.pii import KINDS, base_spans, disguised, find_all, find_pii, luhn, plain


def plain_regex(text):
    """The base as the patterns say it, without care for speed."""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
               if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
                 if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]}


def test_base_equals_the_patterns_on_random_text():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("aZ@@..+-% 0123459()é") for _ in range(rng.randint(0, 60)))
        assert base_spans(text) == plain_regex(text), text
    card = "4111 1111-1111 1111 x 42424242424242420"
    assert base_spans(card) == plain_regex(card) and base_spans(card)["card"]


HIDDEN = [
    ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
    ("bob at mail dot example dot org", "email", "bob at mail dot example dot org"),
    ("jim_b at example.com", "email", "jim_b at example.com"),
    ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
    ("john​@example.com ok", "email", "john​@example.com"),
    ("at 192 dot 168 dot 1 dot 7.", "ip", "192 dot 168 dot 1 dot 7"),
    ("４１１１ 1111 1111 1111", "card", "４１１１ 1111 1111 1111"),
    ("no four one one one one one one one one one one one one one one one", "card",
     "four one one one one one one one one one one one one one one one"),
    ("card 4111 11l1 1I11 1111", "card", "4111 11l1 1I11 1111"),
    ("call plus four four two zero seven nine four six zero nine five eight, thanks", "phone",
     "plus four four two zero seven nine four six zero nine five eight"),
]


@pytest.mark.parametrize("text,kind,source", HIDDEN)
def test_disguised_identifiers_map_back_to_their_source(text, kind, source):
    spans, masked = find_all(text, mask=True)
    assert [(s["kind"], text[s["start"]:s["end"]], s["added"]) for s in spans] == [(kind, source, True)]
    assert masked == text.replace(source, f"<{kind.upper()}>")


PARTLY = [
    ("to j\u043ehn@example.com now", "email", "j\u043ehn@example.com", "hn@example.com"),
    ("to jo\u200bhn@example.com now", "email", "jo\u200bhn@example.com", "hn@example.com"),
    ("to john dot smith@example.com now", "email", "john dot smith@example.com", "smith@example.com"),
    ("to user@mail.example dot com", "email", "user@mail.example dot com", "user@mail.example"),
    ("to john@example.c\u043em now", "email", "john@example.c\u043em", "john@example.c"),
    ("to john@example.co\u200bm now", "email", "john@example.co\u200bm", "john@example.co"),
    ("call +44 20 7946 o958 now", "phone", "+44 20 7946 o958", "+44 20 7946"),
    ("at 192.168.1.1\uff17 now", "ip", "192.168.1.1\uff17", "192.168.1.1"),
]


@pytest.mark.parametrize("text,kind,source,part", PARTLY)
def test_partly_disguised_identifiers_are_masked_whole(text, kind, source, part):
    spans, masked = find_all(text, mask=True)
    assert {(s["kind"], text[s["start"]:s["end"]], s["added"]) for s in spans} == {(kind, source, True), (kind, part, False)}
    assert masked == text.replace(source, f"<{kind.upper()}>")


def test_a_plain_identifier_is_not_added_again_beside_a_disguised_one():
    text = "a.b@example.com and j\u043ehn@example.com and c@d.org, 1.2.3.4"
    spans, masked = find_all(text, mask=True)
    assert masked == "<EMAIL> and <EMAIL> and <EMAIL>, <IP>"
    assert [text[s["start"]:s["end"]] for s in spans if s["added"]] == ["j\u043ehn@example.com"]


@pytest.mark.parametrize("text,kind,source", [
    ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
    ("host 10 dot zero dot Zero dot five.", "ip", "10 dot zero dot Zero dot five"),
    ("host ten 10 [dot] eins (dot) 0 dot\nfünf", "ip", "10 [dot] eins (dot) 0 dot\nfünf"),
    ("host (192.one two.1.7)", "ip", "192.one two.1.7"),
    ("host one.two.three.four", "ip", "one.two.three.four"),
    ("to john.doe at\nexample.com", "email", "john.doe at\nexample.com"),
    ("to john.doe\tat\t example.com", "email", "john.doe\tat\t example.com"),
    ("call plus\u0131 plus four four two zero s\u0131x nine four \u017fix zero nine five eight", "phone",
     "plus four four two zero s\u0131x nine four \u017fix zero nine five eight"),
])
def test_a_disguise_is_found_whatever_else_the_text_has(text, kind, source):
    for more in ("", " and 1 dot 2, a1l, one two"):
        spans, masked = find_all(text + more, mask=True)
        assert [(s["kind"], (text + more)[s["start"]:s["end"]]) for s in spans] == [(kind, source)]
        assert masked == (text + more).replace(source, f"<{kind.upper()}>")


def test_the_shortcut_skips_no_text_that_the_transducers_change():
    rng = random.Random(7)
    parts = ["at", "dot", "[at]", "(dot)", "one", "zwei", "Un", "plus", "x_y", "a.b", "ex.com", "1", "10", "l", "@", "\u043e",
             " ", " ", "  ", "\n", "\t", ".", ",", "-", "(", "\u0131", "\u017f", "K"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 9)))
        assert disguised(text) or plain(text).text == text, text


@pytest.mark.parametrize("text", ["one." * 50_000, "1 dot " * 50_000, "1" * 200_000 + ".one", "a at " * 50_000, " at" + " " * 200_000])
def test_dotted_words_take_linear_time(text):
    find_all(text)


@pytest.mark.parametrize("text", [
    "we met at noon and at six", "look at example.com", "one two three go", "a dot on the map", "10l of milk, 2O left",
    "un deux trois", "Привет мир", "", "(at) the [dot]"])
def test_plain_prose_is_left_alone(text):
    assert find_all(text, mask=True) == ([], text)


def test_spans_of_rewritten_characters_stay_in_order():
    p = plain("a [at] b [dot] c one two ３")
    assert len(p.text) == len(p.start) == len(p.end)
    assert all(s < e for s, e in zip(p.start, p.end, strict=True)) and p.start == sorted(p.start)


@pytest.mark.parametrize("text", [" " * 200_000 + "(", "o" * 200_000, "a1" * 100_000 + " at x", "1." * 100_000,
                                  "a" * 200_000, "@" * 100_000, "+1" * 100_000, "one " * 40_000])
def test_long_runs_take_linear_time(text):
    find_all(text)


def test_operator_on_odd_rows(spark):
    rows = [(1, "a@b.com 1.2.3.4", "x"), (2, None, "x"), (3, "", "x"), (None, "x [at] y [dot] z", "x"), (1, "a@b.com 1.2.3.4", "x")]
    got = find_pii(clashing(docs(spark, rows), "pii", "masked", "extra"), mask=True).collect()
    assert len(got) == 5 and all(r.extra == "old" for r in got)
    assert sorted(str(r.masked) for r in got) == ["", "<EMAIL>", "<EMAIL> <IP>", "<EMAIL> <IP>", "None"]
    assert all([k.kind for k in r.pii] == sorted([k.kind for k in r.pii], key=KINDS.index) for r in got)
    assert find_pii(docs(spark, [])).count() == 0
