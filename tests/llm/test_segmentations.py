import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import LONG, clashing, docs

from corpusvox.llm.queries import PIECES
from corpusvox.llm.segmentations import Sampler, decode, decoder, load_vocabulary, sample_segmentations


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PIECES)


def everything(v, text):
    """Each segmentation of a text with its log probability."""
    text, out = " " + text, {}

    def go(i, ids, w):
        if i == len(text):
            out[tuple(ids)] = w
        else:
            if text[i] not in v.ids:
                go(i + 1, ids + [v.bytes_[b] for b in text[i].encode()], w + v.unknown)
            for j in range(i + 1, len(text) + 1):
                if text[i:j] in v.ids:
                    go(j, ids + [v.ids[text[i:j]]], w + v.weights[text[i:j]])
    go(0, [], 0.0)
    z = math.log(sum(map(math.exp, out.values())))
    return {k: x - z for k, x in out.items()}


def test_all_segmentations_come_once_when_k_is_large(vocabulary):
    for text in ("ab", "the is", "a ☃b", "x  y"):
        want = everything(vocabulary, text)
        got = Sampler(vocabulary, len(want) + 5)([11], [text])[0]
        assert {tuple(s["ids"]) for s in got} == set(want)
        assert len(got) == len(want)
        assert all(abs(want[tuple(s["ids"])] - s["log_prob"]) < 1e-9 and s["inclusion"] == 1.0 for s in got)
        values = [s["perturbed"] for s in got]
        assert values == sorted(values, reverse=True)


def test_first_and_second_follow_sampling_without_replacement(vocabulary):
    want, n = everything(vocabulary, "the is"), 6000
    drawn = Sampler(vocabulary, 2)(list(range(n)), ["the is"] * n)
    first = Counter(tuple(d[0]["ids"]) for d in drawn)
    second = Counter(tuple(d[1]["ids"]) for d in drawn)
    p = {k: math.exp(x) for k, x in want.items()}
    for k in sorted(p, key=p.get)[-4:]:
        after = sum(p[o] * p[k] / (1 - p[o]) for o in p if o != k)
        assert abs(first[k] / n - p[k]) < 0.025 and abs(second[k] / n - after) < 0.025
    total = sum(math.exp(s["log_prob"]) / s["inclusion"] for d in drawn for s in d) / n
    assert abs(total - 1) < 0.05  # inclusion scores make the sample's sums unbiased


def test_a_row_does_not_depend_on_its_neighbours(vocabulary):
    texts = ["hello world again", LONG, "x" * 300, "日本 语 text", "trailing  "]
    together = Sampler(vocabulary, 3)([1, 2, 3, 4, 5], texts)
    for i, t in enumerate(texts):
        alone = Sampler(vocabulary, 3)([i + 1], [t])[0]
        assert [list(s["ids"]) for s in alone] == [list(s["ids"]) for s in together[i]]
        back = decoder(vocabulary)
        assert all(back([int(x) for x in s["ids"]]) == t for s in alone)
        assert len({tuple(s["ids"]) for s in alone}) == 3


def test_operator_on_odd_rows(spark, vocabulary):
    df = clashing(docs(spark), "samples", "ids")
    rows = sample_segmentations(df, vocabulary, k=2).collect()
    assert len(rows) == 10
    assert all((r.samples is None) == (r.text is None) for r in rows)
    assert [len(r.samples[0].ids) for r in rows if r.text == ""] == [0]
    long = sample_segmentations(docs(spark), vocabulary, k=2).select("text", F.explode("samples").alias("s"))
    back = long.select("text", decode(F.col("s.ids"), vocabulary, spark).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    assert sample_segmentations(docs(spark, []), vocabulary).count() == 0


def test_a_full_table_keeps_the_units_met_again_and_draws_the_same(vocabulary, monkeypatch):
    from corpusvox.llm import segmentations as S
    texts = [f"the old house again ☃é𐍈 {i}x" for i in range(60)]
    whole = [Sampler(vocabulary, 3)([i], [t])[0] for i, t in enumerate(texts)]
    brought, miss = Counter(), S.Units.__missing__
    monkeypatch.setattr(S, "TABLE_NODES", 150)
    monkeypatch.setattr(S.Units, "__missing__", lambda self, unit: brought.update([unit]) or miss(self, unit))
    drawn = Sampler(vocabulary, 3)
    for i, t in enumerate(texts):
        for a, b in zip(drawn([i], [t])[0], whole[i], strict=True):
            assert list(a["ids"]) == list(b["ids"]) and math.isclose(a["perturbed"], b["perturbed"])
    assert brought[" house"] == 1 and drawn.units.n_nodes < 200


def test_a_unit_is_looked_up_once_a_batch(vocabulary, monkeypatch):
    from corpusvox.llm import segmentations as S
    looked, get = Counter(), S.Units.__getitem__
    monkeypatch.setattr(S.Units, "__getitem__", lambda self, unit: looked.update([unit]) or get(self, unit))
    texts = ["the old house", "  the old  the old ", "the☃ the\n", LONG]
    drawn = Sampler(vocabulary, 2)([1, 2, 3, 4], texts)
    assert looked == dict.fromkeys((" the", " old", " house", "   the", "  the", " ", " the☃", " the\n", " wort"), 1)
    assert [decoder(vocabulary)([int(x) for x in d[0]["ids"]]) for d in drawn] == texts


def test_only_siblings_among_the_best_are_put_on_the_agenda(vocabulary, monkeypatch):
    from corpusvox.llm import segmentations as S
    calls, joined = [], S.Agenda.joined
    monkeypatch.setattr(S.Agenda, "joined", lambda self, other: calls.append((self, other)) or joined(self, other))
    drawn = Sampler(vocabulary, 3)([7], ["some words of a text that has many segmentations " * 20])[0]
    assert len(drawn) == 3 and len(calls) == 6
    for held, far in calls[1::2]:  # after the nodes near the front, the rest of the path
        assert len(held.value) and (far.value >= held.value.min()).all()
