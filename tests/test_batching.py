import random

from pyspark.sql import functions as F

from corpusvox.operators import batching as Bt


def test_dynamic_batches_partition_and_budget(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice([10, 50, 200, 900, 2500])) for i in range(300)]
    df = Bt.with_position(spark.createDataFrame(rows, "utt long, length long"), ["utt"])
    buf = Bt.buffer_order(df, "pos", 64, ["length"])
    b = Bt.dynamic_batches(buf, "length", budget=2000).toPandas()
    assert sorted(b["utt"]) == list(range(300))  # every row exactly once
    for _, g in b.groupby("batch_id"):
        assert len(g) == 1 or g["length"].max() * len(g) <= 2000  # oversized row alone, never empty
        assert g["buffer"].nunique() == 1
    assert b["batch_id"].nunique() == b["batch_id"].max() + 1


def test_rank_slice_drops_remainder_and_strided_fill(spark):
    df = Bt.with_position(spark.range(10).withColumnRenamed("id", "utt"), ["utt"])
    r = Bt.rank_slice(df, "pos", 10, 3).toPandas()
    assert len(r) == 9 and sorted(r["rank"].unique()) == [0, 1, 2]
    small = Bt.with_position(spark.range(2).withColumnRenamed("id", "utt"), ["utt"])
    s = Bt.strided_shard(small, "pos", 2, 4, num_workers=1).toPandas()
    assert sorted(s["rank"]) == [0, 1, 2, 3] and sorted(s["utt"]) == [0, 0, 1, 1]


def test_positions_are_dense_and_ordered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "a long, b long")
    p = Bt.with_position(df, ["a", "b"]).toPandas().sort_values("pos")
    assert list(p["pos"]) == list(range(50))
    assert list(zip(p["a"], p["b"])) == sorted(zip(p["a"], p["b"]))


def test_top_n_and_best_of(spark):
    df = spark.createDataFrame([(1, 1, 5.0, 2.0), (1, 2, 5.0, 1.0), (1, 3, 1.0, 9.0), (2, 1, 0.5, 1.0)],
                               "g long, i long, score double, ln double")
    t = Bt.top_n(df, ["g"], "score", 2, "i").orderBy("g", "rank").collect()
    assert [(r["g"], r["i"]) for r in t] == [(1, 1), (1, 2), (2, 1)]
    b = {r["g"]: r["best"] for r in Bt.best_of(df, ["g"], "i", "score", "ln").collect()}
    assert b == {1: 2, 2: 1}
