import random

import numpy as np
from tests.llm.helpers import LONG, clashing, docs

from corpusvox.llm.ordinal import Limits, Model, features, fit, grade_texts, gradient, sigmoid

WORDS = ["river stone cloud", "buy cheap now", "vile rotten scum"]


def rated(n=240):
    rng, out = random.Random(2), []
    for i in range(n):
        g = i % 3
        own = WORDS[2 - g].split()
        out.append((i, " ".join(rng.choice(own if rng.random() < 0.3 else "and of in to it as at by".split())
                                for _ in range(40)), g))
    return out


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(0)
    y, t, eta = rng.integers(0, 4, 50), np.array([-1.0, 0.2, 1.5]), rng.normal(size=50)

    def loss(eta, t):
        f = np.concatenate((np.zeros((50, 1)), sigmoid(t[None] - eta[:, None]), np.ones((50, 1))), axis=1)
        return -np.log(f[np.arange(50), y + 1] - f[np.arange(50), y]).sum()
    by_eta, by_t = gradient(eta, y, t)
    h = 1e-6
    for i in range(3):
        e = np.eye(50)[i] * h
        assert abs((loss(eta + e, t) - loss(eta - e, t)) / (2 * h) - by_eta[i]) < 1e-4
        e = np.eye(3)[i] * h
        assert abs((loss(eta, t + e) - loss(eta, t - e)) / (2 * h) - by_t[i]) < 1e-3


def test_held_out_grades_are_ordered(spark):
    rows = rated()
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i % 4], "doc_id long, grade int")
    model = fit(ratings, df, limits=Limits(steps=25))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in grade_texts(df, model).collect()}
    held = [(g, got[i]) for i, _, g in rows if i % 4 == 0]
    mean = [np.mean([r.expected_grade for g, r in held if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2]
    assert np.mean([r.kept == (g == 2) for g, r in held]) > 0.9
    assert all(0 <= r.tail_prob <= 1 and 0 <= r.expected_grade <= 2 for r in got.values())


def test_odd_rows(spark):
    model = Model([0.0, 1.0], np.zeros(1 << 18, np.float32), np.array([0.0]))
    got = grade_texts(clashing(docs(spark), "kept", "tail_prob", "_eta", "extra"), model).collect()
    assert len(got) == 10 and all(r.tail_prob == 0.5 and r.kept and r.extra == "old" for r in got)
    no_ratings = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, grade int")
    empty = fit(no_ratings, docs(spark))
    assert empty.grades == []
    assert all(r.expected_grade is None and r.kept for r in grade_texts(docs(spark), empty).collect())
    assert grade_texts(docs(spark, []), model).count() == 0
    assert len(features(LONG.encode(), lambda f: hash(f) & 1023)) <= 6
