import json

import numpy as np
import pandas as pd
import pytest

from corpusvox.operators.batching import DurationChain, duration_batches
from corpusvox.plans.chained import chained_fold
from corpusvox.streaming.punctuation import PunctCarry, carry_batch
from corpusvox.streaming.vad import VadConfig, VadFold, segments_batch

CFG = VadConfig(win=4, sil_to_speech=3, speech_to_sil=1, lookback=2, max_end_sil=3, lookahead=1, max_segment=25)


def sessions(rng, lengths):
    return [(None if k == 3 else k, i) for k, n in enumerate(lengths) for i in range(n)]


@pytest.mark.parametrize("rows_per_bucket", [50, 100_000])
def test_speech_segments_of_a_cut_session_equal_the_fold(spark, rows_per_bucket):
    rng = np.random.default_rng(rows_per_bucket)
    keys = sessions(rng, [300, 1, 45, 20])
    speech = (rng.random(len(keys)) < np.repeat([0.2, 0.9], [len(keys) // 2, len(keys) - len(keys) // 2])).astype(int)
    runs = np.repeat(rng.random(len(keys) // 5 + 1) < 0.5, 5)[:len(keys)].astype(int)
    flag = np.where(rng.random(len(keys)) < 0.8, runs, speech)
    df = spark.createDataFrame([(s, i, int(x)) for (s, i), x in zip(keys, flag)], "session long, i long, speech int").repartition(3)
    want = []
    for k in {s for s, _ in keys}:
        fold = VadFold(CFG)
        mine = np.array([x for (s, _), x in zip(keys, flag) if s == k])
        want += [(k, s, b * 10, e * 10) for s, b, e in fold.push(mine) + fold.finish()]
    got = [tuple(r) for r in segments_batch(df, "session", ["i"], "speech", CFG, rows_per_bucket).collect()]
    assert len(want) > 5 and sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rows_per_bucket", [40])
def test_punctuation_of_a_cut_session_equals_the_fold(spark, rows_per_bucket):
    rng = np.random.default_rng(rows_per_bucket)
    keys = sessions(rng, [150, 1, 44, 20])
    words = [(s, i, rng.choice(["ab", "c", "你", "d。"]), int(rng.choice([1, 1, 1, 1, 2, 3, 4, 5]))) for s, i in keys]
    df = spark.createDataFrame(words, "session long, i long, w string, p int").repartition(3)
    want = []
    for k in {s for s, _ in keys}:
        fold = PunctCarry(10, 15)
        mine = [(w, p) for s, _, w, p in words if s == k]
        want += [(k, *x) for x in fold.push([w for w, _ in mine], [p for _, p in mine]) + fold.finish()]
    got = [tuple(r) for r in carry_batch(df, "session", ["i"], "w", "p", 10, 15, rows_per_bucket).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("rows_per_bucket", [40])
def test_duration_batches_of_a_cut_recording_equal_the_fold(spark, rows_per_bucket):
    rng = np.random.default_rng(3)
    rows = [(None if r == 2 else r, i, int(d)) for r, n in enumerate((120, 1, 30)) for i, d in enumerate(rng.integers(0, 40, n))]
    df = spark.createDataFrame(rows, "rec long, idx long, dur long").repartition(3)
    want = []
    for rec in {r for r, _, _ in rows}:
        mine = sorted((d, i) for r, i, d in rows if r == rec)
        budget, cum, batch = max(90, mine[0][0]), None, 0
        for d, i in mine:
            if cum is not None and not (cum + d < budget and d < 35):
                batch, cum = batch + 1, 0
            cum = (cum or 0) + d
            want.append((rec, i, batch))
    got = [tuple(r) for r in duration_batches(df, "rec", "idx", "dur", 90, 35, rows_per_bucket).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_fold_that_never_forgets_is_still_exact(spark):
    class Counting:
        """A fold that never forgets: each bucket has to wait for the one before."""

        fields = "i long, total long"

        def guess(self, offset):
            return (0,)

        def run(self, state, batches, last):
            total, out = state[0], []
            for b in batches:
                for i, x in zip(b["i"].tolist(), b["x"].tolist()):
                    total += x
                    out.append((i, total))
            return (total,), out, 0

    rows = [(k, i, i % 7 + 1) for k in range(2) for i in range(12)]
    df = spark.createDataFrame(rows, "k long, i long, x long")
    got = chained_fold(df, "k", ["i"], ["x"], Counting(), 4).toPandas().sort_values(["k", "i"])
    want = pd.DataFrame(rows, columns=["k", "i", "x"]).groupby("k")["x"].cumsum()
    assert got["total"].tolist() == want.tolist()


def test_empty_tables(spark):
    df = spark.createDataFrame([], "session long, i long, speech int")
    assert segments_batch(df, "session", ["i"], "speech").count() == 0
    assert json.dumps(DurationChain(1, 1).guess(0)) == "[null]"
