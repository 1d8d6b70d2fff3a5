"""Steps whose cost once grew faster than their input: what is made or moved once must stay so."""
import pytest
from pyspark.sql import functions as F

from corpusvox.plans import sequence as S


@pytest.fixture
def no_bucket_size(spark):
    """Every table counts as large and no bucket size is asked for."""
    size = spark.conf.get(S.ROWS_PER_BUCKET_CONF)
    spark.conf.unset(S.ROWS_PER_BUCKET_CONF)
    spark.conf.set(S.WHOLE_BYTES_CONF, "0")
    yield
    spark.conf.unset(S.WHOLE_BYTES_CONF)
    spark.conf.set(S.ROWS_PER_BUCKET_CONF, size)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_large_table_of_small_keys_is_left_whole_and_one_with_a_hot_key_is_cut(spark, no_bucket_size, monkeypatch):
    df = spark.range(60).selectExpr("id div 2 AS k", "id AS i")
    cold = S.seq_row_number(df, ["k"], ["i"])
    assert S.is_whole(cold) and "Join" not in plan(cold)
    monkeypatch.setattr(S, "DEFAULT_ROWS_PER_BUCKET", 3)
    hot = S.seq_row_number(df.withColumn("k", F.when(F.col("i") < 50, F.lit(None)).otherwise(F.col("k"))), ["k"], ["i"])
    assert not S.is_whole(hot)
    assert [r.rn for r in hot.where("k IS NULL").orderBy("i").collect()] == list(range(1, 51))


def test_timestamp_segments_reads_its_tokens_once(spark, no_bucket_size):
    from corpusvox.operators.segments import timestamp_segments
    rows = [(1, 0, 10), (1, 1, 3), (1, 2, 12), (1, 3, 12), (1, 4, 4), (2, 0, 5), (2, 1, 14), (2, 2, 6), (3, 0, 1), (None, 0, 11)]
    df = spark.createDataFrame(rows, "rec long, pos long, tok long")
    out = timestamp_segments(df, "rec", "pos", "tok", 10, 1.0)
    assert plan(out).count("LogicalRDD") == 1
    assert sorted(map(tuple, out.collect()), key=repr) == [
        (1, 0, 0.0, 2.0, 1), (2, 0, 0.0, 4.0, 3), (3, 0, 0.0, None, 1)]


def test_split_overlaps_after_merge_asks_for_hot_keys_once(spark, no_bucket_size, monkeypatch):
    from corpusvox.operators import segments as G
    asked, ask = [], S.has_hot_key
    monkeypatch.setattr(S, "has_hot_key", lambda *a: asked.append(1) or ask(*a))
    df = spark.createDataFrame([(1, 0, 0.0, 2.0, "a"), (1, 1, 1.0, 3.0, "b")], "rec long, i long, start double, end double, label string")
    out = G.split_overlaps(G.merge_turns(df, "rec", ["i"], mark_whole=True), "rec", ["island"])
    assert "Join" not in plan(out) and len(asked) == 1
    assert sorted((r.start, r.end) for r in out.collect()) == [(0.0, 1.5), (1.5, 3.0)]


def test_noise_gate_of_whole_sessions_joins_nothing(spark, no_bucket_size):
    from corpusvox.streaming.noise import noise_gate
    rows = [(k, i, i % 3 == 2, float(-10 - i)) for k in (1, 2, None) for i in range(9)]
    df = spark.createDataFrame(rows, "session long, i long, speech boolean, db double")
    out = noise_gate(df, "session", ["i"], "speech", "db", n=4)
    assert "Join" not in plan(out)
    level, expected = -100.0, {}
    for i in range(9):
        expected[i] = level
        if i % 3 != 2:
            level = -10.0 - i if level == -100.0 else (-10.0 - i + level * 3) / 4
    got = out.collect()
    assert len(got) == 27 and all(abs(r.noise_level - expected[r.i]) < 1e-9 for r in got)


def test_stream_slices_are_written_by_all_tasks(spark, tmp_path):
    from corpusvox.streaming.runner import write_slices
    df = spark.range(400).repartition(4).withColumn("ts", F.timestamp_seconds("id"))
    write_slices(df, "ts", str(tmp_path / "a"))
    assert len(list((tmp_path / "a").glob("part-*"))) > 4


def test_values_used_inside_lambdas_are_made_once(spark):
    from corpusvox.functions import text as X
    from corpusvox.functions import vectors as Vf
    from corpusvox.operators import scoring as Sc
    words = F.split("t", " ")
    df = spark.createDataFrame([("a b c a", [1.0, 2.0])], "t string, v array<double>")
    assert plan(df.select(X.repetition_flag(words, 3).alias("x"))).count("split(") == 1
    assert plan(df.select(Sc.collapse_ctc(F.transform(words, lambda w: F.length(w))).alias("x"))).count("split(") == 1
    frames = F.transform("v", lambda x: F.array(x))
    assert plan(df.select(Vf.splice(frames, 2).alias("x"))).count("transform(v#") == 1
    assert df.select(Vf.splice(frames, 1).alias("s")).first().s == [[0.0, 1.0, 2.0], [1.0, 2.0, 0.0]]


def test_white_space_and_readings(spark):
    from corpusvox.functions import text as X
    ws = "".join(X.PY_WHITESPACE)
    texts = [f"{ws}a{c}b{ws}" for c in X.PY_WHITESPACE] + [ws, "", "x", None, " a​bᚁ ", "Ab9 é가"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    readings = {**X.KOREAN_DIGITS, **X.KOREAN_LETTERS, **{k.lower(): v for k, v in X.KOREAN_LETTERS.items()}}
    out = df.select("t", X.py_strip("t").alias("s"), X.word_tokens("t").alias("w"), X.korean_clean("t").alias("k"))
    for r in out.collect():
        if r.t is None:
            assert r.s is None and r.w is None and r.k is None
        else:
            assert (r.s, r.w) == (r.t.strip(), r.t.split())
            assert r.k == "".join(readings.get(c, c) for c in r.t.strip())
    assert "map" not in plan(df.select(X.korean_clean("t")))


def test_dictionary_hits_are_joined_once_for_words_and_once_for_characters(spark):
    from corpusvox.operators.vocabulary import seg_tokenize
    long = spark.createDataFrame([(1, 0, "Ab"), (1, 1, "zz"), (1, 2, "一9")], "k long, pos int, token string")
    seg = spark.createDataFrame([("ab", ["a", "b"]), ("一", ["yi"])], "word string, pieces array<string>")
    out = seg_tokenize(long, "k", seg)
    assert plan(out).count("Join") == 3
    assert [r.token for r in out.orderBy("pos", "sub").collect()] == ["a", "b", "<unk>", "yi", "<unk>"]


def test_a_search_sends_blocks_to_groups_not_to_every_block(spark):
    from corpusvox.operators import cluster as C
    v = spark.range(160).selectExpr("0L AS rec", "id AS item", "array(cast(id AS double), 1.0D) AS vec")
    sizes = v.groupBy("rec").agg(F.count("*").alias("n"))
    blocks, pairs = C.blocks_of(v, sizes, 4)
    n = blocks.count()
    assert n > 20 and pairs.count() <= n * spark.sparkContext.defaultParallelism
    assert pairs.where("own").count() == n


def test_shards_number_rows_over_many_tasks_and_read_their_files_once(spark, tmp_path, monkeypatch):
    from corpusvox.sources import sinks as Sk
    numbered, number = [], Sk.seq_row_number
    monkeypatch.setattr(Sk, "seq_row_number", lambda df, *a, **b: numbered.append(df) or number(df, *a, **b))
    df = spark.range(0, 105, 1, 7).select(F.when(F.col("id") > 4, F.col("id") * 37 % 105 % 3).alias("k"), F.lit("x").alias("v"))
    shards = Sk.write_shards(df, "k", f"{tmp_path}/data", 10).orderBy("shard").collect()
    keys = sorted((r.k for r in df.collect()), key=lambda k: (k is not None, k))
    assert [(s.shard, s.rows, s.first_key, s.last_key) for s in shards] == [
        (i, len(c), c[0], c[-1]) for i, c in enumerate(keys[j:j + 10] for j in range(0, 105, 10))]
    # the rows are in no window of one task; the list's numbers come from a row a file, made once
    assert all("v" not in d.columns and "Relation" not in plan(d) for d in numbered) and len(numbered) == 1
