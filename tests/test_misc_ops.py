import pandas as pd
from pyspark.sql import functions as F

from corpusvox.operators import augment as Ag
from corpusvox.operators import batching as Bt
from corpusvox.operators import segments as G
from corpusvox.operators.extensions import batch_inference, lookup_op, pipeline, register_op


def dur_loop(durs, budget=300_000, long_ms=60_000):
    order = sorted(range(len(durs)), key=lambda i: (durs[i], i))
    budget = max(budget, durs[order[0]])
    out, cum, b = {}, 0, 0
    for j, i in enumerate(order):
        cum += durs[i]
        out[i] = b
        if j < len(order) - 1 and cum + durs[order[j + 1]] < budget and durs[order[j + 1]] < long_ms:
            continue
        cum, b = 0, b + 1
    return out


def test_duration_batches_match_loop(spark):
    durs = [1000, 250_000, 40_000, 70_000, 5_000, 5_000, 299_999, 120]
    df = spark.createDataFrame([(1, i, d) for i, d in enumerate(durs)], "rec long, idx long, dur long")
    got = {r["idx"]: r["batch"] for r in Bt.duration_batches(df, "rec", "idx", "dur").collect()}
    assert got == dur_loop(durs)


def test_speaker_mapping_is_best_permutation(spark):
    ref = spark.createDataFrame([("r", f, s) for f, s in [(0, "A"), (1, "A"), (2, "B"), (3, "B"), (4, "B")]],
                                "rec string, frame long, spk string")
    sys = spark.createDataFrame([("r", f, s) for f, s in [(0, "x"), (1, "x"), (2, "y"), (3, "y"), (4, "x"), (5, "z")]],
                                "rec string, frame long, spk string")
    m = {r["sys_spk"]: r["ref_spk"] for r in G.best_speaker_mapping(ref, sys, "rec", "spk").collect()}
    assert m == {"x": "A", "y": "B", "z": None}


def test_augment_draws_are_deterministic(spark):
    df = spark.range(20).withColumnRenamed("id", "k")
    a = [r["f"] for r in df.select(Ag.speed_factor(F.col("k"), seed=1).alias("f")).orderBy("k").collect()]
    b = [r["f"] for r in df.select(Ag.speed_factor(F.col("k"), seed=1).alias("f")).orderBy("k").collect()]
    assert a == b and set(a) <= {0.9, 1.0, 1.1}
    spans = Ag.mask_spans(df.withColumn("n", F.lit(30).cast("long")), "k", "n", 2, 10, seed=2).collect()
    assert all(0 <= s["width"] < 10 and 0 <= s["start"] <= 30 - s["width"] for s in spans)


def test_extension_surface(spark):
    @register_op("demo", "double")
    def double(df):
        return df.withColumn("x", F.col("x") * 2)
    df = spark.createDataFrame([(1,), (2,)], "x long")
    assert [r["x"] for r in pipeline(df, [lookup_op("demo", "double")] * 2).orderBy("x").collect()] == [4, 8]

    def factory():
        return lambda pdf: pd.DataFrame({"x": pdf["x"], "y": pdf["x"] + 1})
    out = batch_inference(df, factory, "x long, y long", batch_size=1)
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2), (2, 3)]


def test_log_mel_matches_numpy(spark):
    import numpy as np
    from corpusvox.functions.vectors import log_mel, mel_filterbank
    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    df = spark.createDataFrame([(x.tolist(),)], "s array<double>")
    got = np.array(df.select(log_mel("s", 40, 20, 64, 6, 8000).alias("m")).first()["m"])
    n = 1 + (200 - 40) // 20
    frames = np.stack([x[i * 20:i * 20 + 40] * np.hamming(40) for i in range(n)])
    ref = np.log(np.maximum((np.abs(np.fft.rfft(frames, n=64)) ** 2) @ mel_filterbank(6, 64, 8000).T, 1e-10))
    assert got.shape == (n, 6) and np.allclose(got, ref)
    fb = mel_filterbank(6, 64, 8000)
    assert fb.shape == (6, 33) and (fb >= 0).all() and (fb.max(axis=1) > 0.5).all()


def test_sentence_postprocess_cases(spark):
    from corpusvox.functions.text import sentence_postprocess
    cases = [
        (["<s>", "你", "好", "</s>"], "你好"),
        (["hello", "world"], "hello world"),
        (["hel@@", "lo", "world"], "hello world"),
        (["a", "b", "c", "dog"], "ABC dog"),
        (["你", "好", "ok", "世"], "你好ok世"),
        (["Hello", "world."], "Hello world."),
        (["x", "y", "z"], "XYZ"),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "t array<string>")
    got = [r["s"] for r in df.select(sentence_postprocess(F.col("t")).alias("s")).collect()]
    assert got == [e for _, e in cases]


def test_profile_disturb(spark):
    import __spark_entry__ as entry
    out = entry.queries()["profile_disturb"](spark, "/root/testdata/sf0.001").toPandas()
    assert out["disturbed"].any()
    assert (abs(out.loc[out["disturbed"], "norm"] - 1.0) < 1e-6).all()   # mixed profiles are normalised


def test_profile_merge(spark):
    import __spark_entry__ as entry
    from corpusvox.operators.augment import merge_profiles
    out = entry.queries()["profile_merge"](spark, "/root/testdata/sf0.01").toPandas()
    per = out.groupby("rec")[["merged_into", "merged_away"]].sum()
    assert ((per["merged_into"] == per["merged_away"]) & (per["merged_into"] <= 1)).all()
    # every recording chosen: exactly one pair merged in each
    prof = spark.createDataFrame([(r, s, [float(r + 1), float(s + 1)]) for r in range(4) for s in range(3)],
                                 "rec long, spk long, v array<double>")
    m = merge_profiles(prof, "rec", "spk", "v", prob=1.0, seed=1).toPandas()
    assert (m.groupby("rec")["merged_into"].sum() == 1).all() and (m.groupby("rec")["merged_away"].sum() == 1).all()
    away = m[m["merged_away"]]
    assert all(sum(abs(x) for x in v) == 0 for v in away["v"]) and (away["label_to"] != away["spk"]).all()
    into = m[m["merged_into"]]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-9 for v in into["v"])


def test_best_assignment_is_exact_for_any_shape():
    from itertools import permutations

    import numpy as np

    from corpusvox.operators.segments import best_assignment
    rng = np.random.default_rng(4)
    for n, m in [(1, 1), (1, 4), (3, 3), (4, 2), (2, 5), (6, 6), (5, 7)] * 6:
        g = rng.integers(0, 9, (n, m)).astype(float)
        wide = g if n <= m else g.T
        best = max(sum(wide[i, j] for i, j in enumerate(p)) for p in permutations(range(wide.shape[1]), wide.shape[0]))
        pair = best_assignment(g)
        used = [j for j in pair if j >= 0]
        assert len(used) == len(set(used)) == min(n, m)
        assert sum(g[i, j] for i, j in enumerate(pair) if j >= 0) == best


def test_speaker_mapping_of_twelve_speakers_is_exact(spark):
    from corpusvox.operators import segments as G
    # greedy would pair s0 with r1 (9) and leave s1 with nothing shared; the best total pairs s0-r0 and s1-r1
    ref, sys, frame = [], [], 0
    for s, r, n in [("s00", "r00", 8), ("s00", "r01", 9), ("s01", "r01", 8)] + [(f"s{i:02}", f"r{i:02}", 3) for i in range(2, 12)]:
        for _ in range(n):
            ref.append((1, frame, r))
            sys.append((1, frame, s))
            frame += 1
    schema = "rec int, frame int, spk string"
    got = {r["sys_spk"]: r["ref_spk"] for r in G.best_speaker_mapping(
        spark.createDataFrame(ref, schema), spark.createDataFrame(sys, schema), "rec", "spk").collect()}
    assert got == {f"s{i:02}": f"r{i:02}" for i in range(12)}


def test_nearest_centroid_in_one_block_and_in_many(spark, monkeypatch):
    from corpusvox.operators import features as Fe
    cents = spark.createDataFrame([(i, [float(i % 5), float(i // 5)]) for i in range(20)] + [(99, [0.0, 0.0])],
                                  "cid int, vec array<double>")
    x = spark.createDataFrame([(k, [k * 0.37 % 5, k * 0.61 % 4]) for k in range(40)] + [(100, [0.0, 0.0])],
                              "k int, v array<double>")
    want = {r["k"]: r["centroid"] for r in Fe.nearest_centroid(x, "v", cents).collect()}
    assert want[100] == 0  # the lower id of two equal centroids
    monkeypatch.setattr(Fe, "BLOCK_VALUES", 6)
    assert {r["k"]: r["centroid"] for r in Fe.nearest_centroid(x, "v", cents).collect()} == want


def test_calibration_text_takes_a_list_for_the_assistant(spark):
    from corpusvox.operators import prompts as P
    df = spark.createDataFrame([("s", None, [1, 2, 3]), (None, "h", None)], "s string, h string, a array<int>")
    assert [r[0] for r in df.select(P.calibration_text("s", "h", "a")).collect()] == [
        "system\ns\nhuman\n\nassistant\n[1, 2, 3]", "system\n\nhuman\nh\nassistant\n"]


def test_token_counts_take_the_first_place_with_any_key(spark):
    from corpusvox.operators.vocabulary import token_counts
    rows = [(-5, 2, "a"), (-5, 0, "a"), (7, 1, "a"), (7, 0, "b"), (1 << 40, 3, "c"), (1 << 40, 2, "c"), (None, 0, "d")]
    for kind, make in (("long", lambda k: k), ("string", lambda k: None if k is None else f"{k:020d}")):
        df = spark.createDataFrame([(make(k), p, t) for k, p, t in rows], f"k {kind}, pos int, token string")
        got = {r.token: (r.cnt, r["first"]["k"], r["first"]["p"]) for r in token_counts(df, "k").collect()}
        assert got["a"] == (3, make(-5), 0) and got["b"] == (1, make(7), 0) and got["c"] == (2, make(1 << 40), 2)
        assert got["d"][0] == 1 and got["d"][1] is None
