import numpy as np
import pytest

from corpusvox.streaming.noise import NO_LEVEL, noise_gate, prefix_maps
from corpusvox.streaming.vad import NoiseFloor


@pytest.mark.parametrize("rows_per_bucket,n", [(4, 4), (40, 100), (100_000, 1)])
def test_gate_of_a_cut_session_equals_the_running_floor(spark, rows_per_bucket, n):
    rng = np.random.default_rng(n)
    keys = [(None if k == 2 else k, i) for k, m in enumerate((90, 1, 30)) for i in range(m)]
    speech = rng.random(len(keys)) < 0.5
    db = (rng.random(len(keys)) * 50 - 40).round(3)
    df = spark.createDataFrame([(s, i, bool(x), float(d)) for (s, i), x, d in zip(keys, speech, db)],
                               "session long, i long, speech boolean, db double").repartition(3)
    got = {(r.session, r.i): (r.noise_level, r.gated) for r in noise_gate(
        df, "session", ["i"], "speech", "db", n, 10.0, -35.0, rows_per_bucket).collect()}
    for k in {s for s, _ in keys}:
        at = [j for j, (s, _) in enumerate(keys) if s == k]
        floor = NoiseFloor(n, 10.0, -35.0)
        for j in at:
            before = NO_LEVEL if floor.avg is None else floor.avg
            want = bool(floor.gate([speech[j]], [db[j]])[0]) if speech[j] or db[j] >= -35 else False
            level, gated = got[keys[j]]
            assert abs(level - before) < 1e-9 and gated == want


def test_maps_of_long_stretches_stay_finite():
    db = np.full(100_000, -30.0)
    p, q = prefix_maps(np.ones(100_000, bool), db, 3, False)
    assert np.isfinite(q).all() and abs(q[-1] + 30.0) < 1e-9 and p[-1] == 0.0


def test_empty_table(spark):
    df = spark.createDataFrame([], "session long, i long, speech boolean, db double")
    assert noise_gate(df, "session", ["i"], "speech", "db").count() == 0
