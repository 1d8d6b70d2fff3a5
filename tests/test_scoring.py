import random

from corpusvox.operators import scoring as S


def min_dcf_loop(scores, labels, p=0.01, cm=1.0, cf=1.0):
    order = sorted(range(len(scores)), key=lambda i: scores[i])
    lab = [labels[i] for i in order]
    P = sum(lab); N = len(lab) - P
    fn = tn = 0
    best, thr = float("inf"), scores[order[0]]
    for k, i in enumerate(order):
        fn += lab[k]; tn += 1 - lab[k]
        c = cm * (fn / P) * p + cf * (1 - tn / N) * (1 - p)
        if c < best:
            best, thr = c, scores[i]
    return best / min(cm * p, cf * (1 - p)), thr


def eer_loop(scores, labels):
    P = sum(labels); N = len(labels) - P
    pts = [(float("inf"), 0, 0)]
    for t in sorted(set(scores), reverse=True):
        tp = sum(1 for s, l in zip(scores, labels) if s >= t and l == 1)
        fp = sum(1 for s, l in zip(scores, labels) if s >= t and l == 0)
        pts.append((t, tp, fp))
    best = min(pts, key=lambda x: (abs((1 - x[1] / P) - x[2] / N), -x[0]))
    return ((1 - best[1] / P) + best[2] / N) / 2, best[0]


def test_min_dcf_and_eer_match_loops(spark):
    rnd = random.Random(5)
    for _ in range(3):
        n = 80
        scores = [float(rnd.randint(0, 30)) for _ in range(n)]  # many ties
        labels = [int(rnd.random() < 0.4 + s / 100) for s in scores]
        df = spark.createDataFrame(list(zip(range(n), scores, labels)), "pos long, score double, label int")
        m = S.min_dcf(S.error_rates(df)).first()
        exp = min_dcf_loop(scores, labels)
        assert abs(m["min_dcf"] - exp[0]) < 1e-9 and m["threshold"] == exp[1]
        e = S.eer(df).first()
        ee = eer_loop(scores, labels)
        assert abs(e["eer"] - ee[0]) < 1e-12 and e["threshold"] == ee[1]


def test_min_dcf_guards(spark):
    import pytest
    df = spark.createDataFrame([(0, 1.0, 1)], "pos long, score double, label int")
    with pytest.raises(ValueError):
        S.min_dcf(df, p_target=1.0)


def test_wer_totals_empty_reference_is_null(spark):
    from pyspark.sql import functions as F
    pairs = spark.createDataFrame([("a", [], [])], "key string, ref array<string>, hyp array<string>")
    d = S.wer_detail(pairs, "key", "ref", "hyp")
    t = S.wer_totals(d).first()
    assert t["wrd"] == 0 and t["err"] is None and t["snt"] == 1
    ids = spark.createDataFrame([([1, 1, 0, 2, 2, -1, 3],)], "x array<int>")
    assert ids.select(S.collapse_ctc(F.col("x"), blank=0).alias("c")).first()["c"] == [1, 2, 3]
