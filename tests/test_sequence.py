import random

import pandas as pd
from pyspark.sql import functions as F

from corpusvox.plans.sequence import seq_cumsum, seq_ffill, seq_lag, seq_lead, seq_neighbors, seq_row_number


def _data(spark, n=200, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randint(0, 5)}"
        v = None if rnd.random() < 0.3 else rnd.randint(0, 9)
        rows.append((key, rnd.random() * 100, i, v))
    return spark.createDataFrame(rows, "key string, t double, id int, v int"), pd.DataFrame(
        rows, columns=["key", "t", "id", "v"])


def test_lag_lead_cumsum_ffill_match_pandas(spark):
    df, pdf = _data(spark)
    pdf = pdf.sort_values(["key", "t", "id"])
    g = pdf.groupby("key")
    exp = pdf.assign(v_prev=g["v"].shift(1), v_next=g["v"].shift(-1), id_prev=g["id"].shift(1),
                     cs=g["id"].cumsum(), rn=g.cumcount() + 1, ff=g["v"].ffill())
    out = seq_neighbors(df, ["key"], ["t", "id"], prev=["v", "id"], next=["v"])
    out = seq_cumsum(out, ["key"], ["t", "id"], {"cs": F.col("id").cast("long")})
    out = seq_row_number(out, ["key"], ["t", "id"], "rn")
    out = seq_ffill(out, ["key"], ["t", "id"], "v", "ff")
    got = out.toPandas().set_index("id").sort_index()
    exp = exp.set_index("id").sort_index()
    for c in ["v_prev", "v_next", "id_prev", "cs", "rn", "ff"]:
        a, b = got[c].astype("float"), exp[c].astype("float")
        assert ((a == b) | (a.isna() & b.isna())).all(), c
    assert got["_seq_b"].max() > 3  # the hot key really was split


def test_global_order_and_single_wrappers(spark):
    df, pdf = _data(spark, 50)
    got = seq_row_number(df, [], ["t", "id"], "rn").toPandas().sort_values("rn")
    assert list(got["id"]) == list(pdf.sort_values(["t", "id"])["id"])
    lag = seq_lag(df, [], ["t", "id"], ["id"]).toPandas().sort_values("t")
    assert lag["id_prev"].isna().sum() == 1
    lead = seq_lead(df, [], ["t", "id"], ["id"]).toPandas().sort_values("t")
    assert lead["id_next"].isna().sum() == 1


def test_empty_and_single_row(spark):
    e = spark.createDataFrame([], "key string, t double, v int")
    assert seq_row_number(e, ["key"], ["t"]).count() == 0
    one = spark.createDataFrame([("a", 1.0, 5)], "key string, t double, v int")
    r = seq_neighbors(one, ["key"], ["t"], prev=["v"], next=["v"]).first()
    assert r["v_prev"] is None and r["v_next"] is None


def test_a_null_key_is_a_key(spark):
    rows = [(None, float(i), i) for i in range(20)] + [("a", float(i), 100 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "key string, t double, id int")
    out = seq_row_number(seq_lag(df, ["key"], ["t"], ["id"]), ["key"], ["t"]).collect()
    assert sorted(r["rn"] for r in out if r["key"] is None) == list(range(1, 21))
    assert all(r["id_prev"] == (r["id"] - 1 if r["rn"] > 1 else None) for r in out) and len(out) == 23


def test_two_keys_of_which_one_is_null(spark):
    df = spark.createDataFrame([(i % 2, None, i) for i in range(30)], "a int, b string, id int")
    out = seq_ffill(seq_row_number(df, ["a", "b"], ["id"]), ["a", "b"], ["id"], "rn", "f").collect()
    assert sorted((r["a"], r["rn"]) for r in out) == [(a, i) for a in (0, 1) for i in range(1, 16)]


def _bucket_sizes(df, keys, order, rows_per_bucket):
    from corpusvox.plans.sequence import range_buckets
    b = range_buckets(df, keys, order, rows_per_bucket)
    # buckets follow the order: no bucket begins before the one before it ends
    return [r["count"] for r in b.groupBy(*keys, "_seq_b").count().collect()]


def test_buckets_are_even_with_an_outlier_a_shared_prefix_and_ties(spark):
    n, per = 20_000, 1000
    ids = spark.range(n)
    cases = {
        "outlier": (ids.select(F.when(F.col("id") == 0, 1e15).otherwise(F.col("id").cast("double")).alias("x"), "id"), ["x", "id"]),
        "prefix": (ids.select(F.format_string("speaker_%08d", "id").alias("x")), ["x"]),
        "ties": (ids.select(F.lit(7).alias("x"), (F.col("id") % 3).alias("y"), "id"), ["x", "y", "id"]),
        "nulls": (ids.select(F.lit(None).cast("string").alias("x"), "id"), ["x", "id"])}
    for name, (df, order) in cases.items():
        for keys in ([], ["k"]):
            sizes = _bucket_sizes(df.withColumn("k", F.lit(1)), keys, order, per)
            assert sum(sizes) == n and max(sizes) <= 2 * per and 14 <= len(sizes) <= 30, (name, keys, max(sizes))


def test_more_than_65536_buckets(spark):
    df = spark.range(70_000).select("id", F.lit("k").alias("k"))
    from corpusvox.plans.sequence import range_buckets
    top = range_buckets(df, ["k"], ["id"], 1).agg(F.max("_seq_b"), F.countDistinct("_seq_b")).first()
    assert top[0] >= 69_999 and top[1] >= 69_999


def test_a_chain_of_helpers_shuffles_its_rows_once_for_each_step(spark):
    df = spark.range(0, 500, 1, 4).select((F.col("id") % 3).alias("k"), "id")
    x = seq_row_number(seq_neighbors(df, ["k"], ["id"], prev=["id"]), ["k"], ["id"])
    x.collect()
    plan = x._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or "ReusedQueryStage" in plan or "Reused" in plan


def test_integrate_and_fire_subtracts_once_a_frame(spark):
    import numpy as np

    from corpusvox.operators.segments import cif_fire
    rng = np.random.default_rng(4)
    rows = [(None if k == 2 else k, i, int(w)) for k, n in enumerate((60, 1, 25)) for i, w in enumerate(rng.integers(0, 31, n))]
    got = {(r.rec, r.i): (r.fires, r.left) for r in cif_fire(
        spark.createDataFrame(rows, "rec long, i long, w long"), "rec", ["i"], "w", 10).collect()}
    for key in {r for r, _, _ in rows}:
        total = 0
        for _, i, w in sorted((x for x in rows if x[0] == key), key=lambda x: x[1]):
            total += w
            fire = int(total >= 10)
            total -= 10 * fire
            assert got[key, i] == (fire, total)


def test_cummin_over_buckets(spark):
    from pyspark.sql import functions as F

    from corpusvox.plans.sequence import seq_cummin
    rows = [(k, i, (i * 7 + k) % 11 if i % 4 else None) for k in range(2) for i in range(25)]
    out = seq_cummin(spark.createDataFrame(rows, "k long, i long, v long"), ["k"], ["i"], F.col("v"), "low", "low_before")
    for r in out.collect():
        seen = [v for k, i, v in rows if k == r.k and i <= r.i and v is not None]
        before = [v for k, i, v in rows if k == r.k and i < r.i and v is not None]
        assert r.low == min(seen, default=None) and r.low_before == min(before, default=None)


def test_whole_tables_give_the_same_as_cut_ones(spark):
    """Small tables are plain windows: no bucket size is asked for, so the session's setting is taken off."""
    from pyspark.sql import functions as F

    from corpusvox.plans import sequence as S
    df = spark.range(30).selectExpr("nullif(id div 10, 2) AS k", "id % 10 AS i", "CASE WHEN id % 3 > 0 THEN id * 5 % 7 END AS v")
    size = spark.conf.get(S.ROWS_PER_BUCKET_CONF)

    def run():
        out = S.seq_neighbors(df, ["k"], ["i"], prev=["v"], next=["v"])
        out = S.seq_cumsum(out, ["k"], ["i"], {"total": F.coalesce("v", F.lit(0))})
        out = S.seq_cummin(out, ["k"], ["i"], F.col("v"), "low", "low_before")
        out = S.seq_ffill(out, ["k"], ["i"], "v", "filled").drop(S.B)
        out = S.seq_row_number(out, [], ["k", "i"], "at").drop(S.B)
        return out, sorted(map(repr, out.collect()))
    cut = run()[1]
    try:
        spark.conf.unset(S.ROWS_PER_BUCKET_CONF)
        plan, whole = run()
    finally:
        spark.conf.set(S.ROWS_PER_BUCKET_CONF, size)
    assert whole == cut
    assert "Join" not in plan._jdf.queryExecution().optimizedPlan().toString()
