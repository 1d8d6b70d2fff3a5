import re

import corpus_pipeline as cp
import pytest
from tests.conftest import SMOKE
from tests.llm.helpers import LONG
from tests.llm.test_decontaminate import brute
from tests.llm.test_pii import plain_regex
from tests.llm.test_simhash import components, plain_fingerprint

from corpusvox.llm.language import fit, held_out, predictor
from corpusvox.llm.pii import masked
from corpusvox.llm.segmentations import decoder, load_vocabulary


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    result = [docs]
    for name, stage in cp.STAGES:
        stage(spark, docs, SMOKE).write.parquet(f"{out}/{name}")
        docs = spark.read.parquet(f"{out}/{name}")
        result.append(docs)
    return result


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_stage(stages, spark):
    before = stages[0]
    predict = predictor(fit(before.where(~held_out(before.doc_id))))
    want = {i: predict(r.text) for i, r in by_id(before).items()}
    got = by_id(stages[1])
    assert set(got) == {i for i, (x, s) in want.items() if x != "und" and s >= cp.LEAST_LANGUAGE_SCORE}
    assert all(got[i].lang == want[i][0] for i in got)


def test_near_duplicate_stage(stages):
    before = by_id(stages[1])
    prints = {i: plain_fingerprint(r.text) for i, r in before.items()}
    label = components(sorted(set(prints.values())), 4)
    least = {}
    for i, v in prints.items():
        least[label[v]] = min(i, least.get(label[v], i))
    assert set(by_id(stages[2])) == set(least.values())


def test_decontamination_stage(stages, spark):
    items = [(str(r.item_id), " ".join(re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower())))
             for r in spark.read.parquet(f"{SMOKE}/benchmark.parquet").collect()]
    clean = {i for i, r in by_id(stages[2]).items()
             if not brute(re.findall(r"[0-9a-z\x80-\U0010ffff]+", r.text.lower()), items)[0]}
    assert set(by_id(stages[3])) == clean


def test_pii_stage(stages):
    before, got = by_id(stages[3]), by_id(stages[4])
    assert set(before) == set(got)
    for i, r in before.items():
        spans = [(k, a, b) for k, found in plain_regex(r.text).items() for a, b in found]
        assert got[i].text == masked(r.text, spans) and got[i].n_chars == len(got[i].text)


def test_token_stage_round_trip(stages):
    back = decoder(load_vocabulary(cp.PIECES))
    before, got = by_id(stages[4]), by_id(stages[5])
    assert set(before) == set(got)
    assert all(back(got[i].ids) == before[i].text for i in got)


def test_run_gives_the_same_rows(stages, spark):
    assert sorted(map(str, cp.run(spark, SMOKE).collect())) == sorted(map(str, stages[5].collect()))


def test_odd_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(1, None, None, None, None, "e"), (None, "", "en", "s", 0, "e"), (3, LONG, "de", "s", 1, "e"),
            (4, "mail a@b.com to me", "en", "s", 1, "e"), (4, "mail a@b.com to me", "en", "s", 1, "e")]
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, SMOKE)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra"]
        left = cp.STAGES[-1][1](spark, docs, SMOKE).collect()
        assert {r.doc_id for r in left} == ({3, 4} if some else set())
