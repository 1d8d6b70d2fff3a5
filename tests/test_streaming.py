import numpy as np

import __spark_entry__ as entry
from corpusvox.streaming.vad import VadConfig, VadFold

SF = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_vad_stream_equals_batch_twin(spark):
    q = entry.queries()
    batch = _rows(q["vad_segments"](spark, SF))
    stream = _rows(q["vad_segments_stream"](spark, SF))
    assert batch == stream and len(batch) > 0


def test_rechunk_stream_equals_batch_twin(spark):
    q = entry.queries()
    assert _rows(q["rechunk"](spark, SF)) == _rows(q["rechunk_stream"](spark, SF))


def test_vad_fold_rules():
    cfg = VadConfig()
    v = VadFold(cfg)
    # 100 frames of silence, 300 of speech, 200 of silence
    segs = v.push(np.array([0] * 100 + [1] * 300 + [0] * 200))
    assert len(segs) == 1
    seg, beg, end = segs[0]
    assert beg == max(0, 114 - cfg.win - cfg.lookback + 1)   # speech window reaches 15 at frame 114
    assert end <= 600 and not v.in_speech
    # forced cut at max_segment, chunking the input does not change the result
    a, b = VadFold(cfg), VadFold(cfg)
    x = np.ones(13000, dtype=int)
    whole = a.push(x) + a.finish()
    parts = []
    for i in range(0, 13000, 777):
        parts += b.push(x[i:i + 777])
    parts += b.finish()
    assert whole == parts and len(whole) == 3 and whole[0][2] - whole[0][1] == cfg.max_segment


def test_crossfade_stream_equals_batch_twin(spark):
    q = entry.queries()
    assert _rows(q["crossfade"](spark, SF)) == _rows(q["crossfade_stream"](spark, SF))


def test_seg_tokenize_char_path(spark):
    from corpusvox.operators.vocabulary import seg_tokenize
    long = spark.createDataFrame([(1, 0, "Hello"), (1, 1, "中文"), (1, 2, "12"), (1, 3, "zzz")],
                                 "k long, pos long, token string")
    d = spark.createDataFrame([("hello", ["he", "llo"]), ("中", ["zh"]), ("1", ["one"])],
                              "word string, pieces array<string>")
    got = [r["token"] for r in seg_tokenize(long, "k", d).orderBy("pos", "sub").collect()]
    assert got == ["he", "llo", "zh", "<unk>", "one", "<unk>", "<unk>"]


def test_lfr_stream_equals_batch_twin(spark):
    q = entry.queries()
    assert _rows(q["lfr_online"](spark, SF)) == _rows(q["lfr_online_stream"](spark, SF))


def test_punctuation_carry_stream_equals_batch(spark):
    q = entry.queries()
    b = _rows(q["punctuation_carry"](spark, SF))
    assert b == _rows(q["punctuation_carry_stream"](spark, SF)) and len(b) > 0


def test_punct_carry_by_hand():
    from corpusvox.streaming.punctuation import PunctCarry
    f = PunctCarry(chunk=4, max_carry=5)
    assert f.push("ab cd ef gh".split(), [3, 3, 3, 1]) == []    # nothing is cut before a further word comes
    out = f.push(["ij", "kl", "mn", "op"], [3, 1, 2, 1])
    assert out == [(0, 3, "ab。 cd。 ef。")]                     # the third word; the first two and the last are not looked at
    assert f.words == ["gh", "ij", "kl", "mn", "op"]
    out = f.push(["qr", "st", "uv", "wx"], [1, 1, 1, 1])        # five carried words are not over the limit
    assert out == [] and len(f.words) == 9
    out = f.push(["yz"], [4])                                   # nine are: cut after the comma, which becomes a period
    assert out == [(1, 4, " gh ij。 kl mn。")]
    assert f.words == ["op", "qr", "st", "uv", "wx", "yz"]
    assert f.finish() == [(2, 6, " op qr st uv wx yz")]         # the final mark is withheld


def test_punct_carry_without_a_comma_carries_all_on_and_parts_single_byte_words_only():
    from corpusvox.streaming.punctuation import PunctCarry
    f = PunctCarry(chunk=3, max_carry=4)
    assert f.push(["你", "好", "ok", "好", "a1", "b", "你", "c"], [1] * 8) == []
    assert f.finish() == [(0, 8, "你好ok好a1 b你c")]


def test_rows_without_a_time_are_replayed_first(spark, tmp_path):
    from pyspark.sql import functions as F

    from corpusvox.streaming.runner import write_slices
    df = spark.createDataFrame([(1, 10), (2, None), (3, 500)], "id int, s int").withColumn("ts", F.timestamp_seconds("s"))
    write_slices(df, "ts", str(tmp_path / "a"))
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "a")).collect()} == {1, 2, 3}
    write_slices(df.where("s IS NULL"), "ts", str(tmp_path / "b"))
    assert spark.read.parquet(str(tmp_path / "b")).count() == 1


def test_noise_floor_recurrence():
    from corpusvox.streaming.vad import NoiseFloor
    nf = NoiseFloor(n=4, snr_thres=10.0)
    out = nf.gate(np.array([0, 0, 1, 1, 0]), np.array([-40.0, -20.0, -25.0, -40.0, -30.0]))
    # noise: -40, then (-20 + 3*-40)/4 = -35; frame 2: snr 10 -> speech; frame 3: snr -5 -> silence
    assert list(out) == [0, 0, 1, 0, 0]
    assert abs(nf.avg - ((-30.0 + 3 * -35.0) / 4)) < 1e-12
