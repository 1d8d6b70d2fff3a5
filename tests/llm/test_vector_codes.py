import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import clashing

from corpusvox.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds, scale=4096):
    """Full search with Python integers; rows: (id, vector, label), already usable."""
    ints = [[int(np.floor(float(x) * scale)) for x in v] for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, ints[i]))[:entries]
    m = len(ints[0]) // parts
    cut = [[v[p * m:(p + 1) * m] for p in range(parts)] for v in ints]
    books = [[cut[i][p][:] for i in order] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            got = [near(c[p], books[p])[1] for c in cut]
            for j in set(got):
                mine = [c[p] for c, g in zip(cut, got) if g == j]
                books[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    out = []
    for row, c in zip(rows, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        out.append((row[0], "".join(f"{j:02x}" for _, j in best), sum(d for d, _ in best), row[2]))
    flat = ",".join(str(x) for p in books for e in p for x in e)
    return out, hashlib.sha256(flat.encode()).hexdigest()


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def check(df, rows, **kw):
    coded, books = V.quantise(df, **kw)
    got = [(r.vec_id, r.code.hex(), r.error, r.label) for r in coded.collect()]
    want, digest = brute(rows, kw["parts"], kw["entries"], kw["rounds"])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert books.digest() == digest
    return coded


@pytest.mark.parametrize("seed,parts,entries,rounds", [(1, 2, 4, 6), (2, 8, 16, 3), (3, 1, 3, 1), (4, 4, 5, 0)])
def test_equals_a_full_search(spark, seed, parts, entries, rounds):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16))
    rows = [(int(i), (centres[i % 6] + 0.2 * rng.normal(size=16)).astype(np.float32).tolist(), int(i % 4) or None)
            for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    coded = check(df, rows, parts=parts, entries=entries, rounds=rounds)
    measured, full = coded.agg(F.sum("scans")).first()[0], (rounds + 1) * parts * entries * len(rows)
    assert measured < full or rounds <= 1
    if seed == 1:
        assert measured < 0.6 * full


def test_ties_repeats_null_ids_and_coarse_values(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i // 2) if i % 7 else None, (rng.integers(-2, 3, 8) / 4096).astype(np.float32).tolist(), 1) for i in range(90)]
    rows += [rows[3], rows[3], (1000, [float(2 ** 15)] * 8, None)]
    check(spark.createDataFrame(rows, SCHEMA), rows, parts=4, entries=6, rounds=4)


def test_unusable_rows_go(spark):
    good = [(i, [0.5 * i, -1.0, 0.25, i % 3 + 0.1], i % 2) for i in range(9)]
    bad = [(-1, None, 0), (-2, [1.0, None, 1.0, 1.0], 0), (-3, [1.0, float("nan"), 1.0, 1.0], 0), (-4, [float("inf")] * 4, 0),
           (-5, [float("-inf")] * 4, 0), (-6, [], 0), (-7, [1.0], 0), (20, [1.0] * 6, 0), (-8, [1e30] * 4, 0)]
    df = spark.createDataFrame(good + bad, SCHEMA)
    check(df, [(i, np.array(v, np.float32).tolist(), x) for i, v, x in good], parts=2, entries=16, rounds=6)
    out = V.quantise(clashing(df, "code", "error", "scans", "part"), parts=2)[0]
    assert out.columns == ["vec_id", "embedding", "label", "part", "code", "error", "scans"] and out.count() == 9
    for none in (df.where("vec_id < 0 AND vec_id <> -7"), df.where("false")):
        out, books = V.quantise(none, parts=2)
        assert books is None and V.with_group_error(out).count() == 0


def test_group_error_keeps_nulls_together(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 6, None), (3, 1, 7), (4, 2, 7)], "vec_id long, error long, label int")
    got = {r.vec_id: r.label_error for r in V.with_group_error(clashing(df, "label_error", "_label")).collect()}
    assert got == {1: 11, 2: 11, 3: 3, 4: 3}


def test_net_displacement_is_at_most_the_accumulated_drift():
    books = V.Codebooks(np.array([[[0, 0]]]))
    books.history += [np.array([[[3, 4]]]), np.array([[[0, 0]]])]
    assert books.net()[0, :, 0].round(6).tolist() == [0.0, 5.0, 0.0]
