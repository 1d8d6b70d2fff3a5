import json
import os
import tempfile

from pyspark.sql import functions as F

from corpusvox.functions import text as X
from corpusvox.sources import kaldi as K
from corpusvox.sources import manifest as Mf


def _write(d, name, text):
    p = os.path.join(d, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_keyed_text_edge_rows(spark):
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    p = _write(d, "text", "u1 hello world\n\n   \nu2\nu3   spaced   out  \nu1 second wins\nu4 中文 mixed Latin\n")
    got = {r["utt"]: r["value"] for r in K.read_keyed_text(spark, p, "utt", "value").collect()}
    assert got == {"u1": "second wins", "u3": "spaced   out", "u4": "中文 mixed Latin"}  # u2 has no value
    good, bad = K.split_once(K.read_lines(spark, p), "utt", "value")
    assert [r["line"] for r in bad.collect()] == ["u2"]


def test_utt2spk_and_lists(spark):
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    p = _write(d, "utt2spk", "a s1\nb s2 extra\nc s1\na s3\n")
    assert {r["utt"]: r["spk"] for r in K.read_utt2spk(spark, p).collect()} == {"a": "s3", "c": "s1"}
    q = _write(d, "spk2utt", "s1 a c\ns2 b\n")
    assert {r["spk"]: r["utts"] for r in K.read_key_list(spark, q).collect()} == {"s1": ["a", "c"], "s2": ["b"]}


def test_vocabulary_scan_checks(spark):
    import pytest
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    ok = _write(d, "v1", "<blank>\na\nb\n<unk>\n")
    v = {r["token"]: r["id"] for r in K.read_vocabulary(spark, ok).collect()}
    assert v == {"<blank>": 0, "a": 1, "b": 2, "<unk>": 3}
    with pytest.raises(ValueError):
        K.read_vocabulary(spark, _write(d, "v2", "a\na\n<unk>\n"))
    with pytest.raises(ValueError):
        K.read_vocabulary(spark, _write(d, "v3", "a\nb\n"))


def test_manifest_jsonl_aliases(spark):
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    rows = [{"audio_path": "a.wav", "text": "hi", "speaker_id": "s", "utt_id": "u"},
            {"wav": "b.wav", "transcript": "yo", "utt_id": ""},
            "not json",
            {"path": "c.wav", "text": ""}]
    p = _write(d, "m.jsonl", "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")
    good, bad = Mf.read_manifest_jsonl(spark, p)
    g = sorted(tuple(r) for r in good.select("utt", "wav", "text", "spk").collect())
    assert g == [("u", "a.wav", "hi", "s"), ("utt_000001", "b.wav", "yo", "default_speaker")]
    assert bad.count() == 2


def test_segments_trials_cmvn(spark):
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    s = K.read_segments(spark, _write(d, "segments", "u1 r1 0.0 1.5\nu2 r1 1.5 1.5\nbad line\n"))
    assert s.count() == 2
    t = K.read_trials(spark, _write(d, "trials", "a b target\na c nontarget\n"))
    assert sorted(r["label"] for r in t.collect()) == [0, 1]
    c = K.read_cmvn_text(spark, _write(d, "am.mvn", "<Nnet>\n<AddShift> 3 3\n<LearnRateCoef> 0 [ -1 -2 -3 ]\n"
                                                  "<Rescale> 3 3\n<LearnRateCoef> 0 [ 0.5 0.25 2 ]\n</Nnet>\n"))
    assert [(r["dim"], r["shift"], r["scale"]) for r in c.orderBy("dim").collect()] == [
        (0, -1.0, 0.5), (1, -2.0, 0.25), (2, -3.0, 2.0)]


def test_audio_dir_scan_and_sidecar(spark):
    d = tempfile.mkdtemp(prefix="cv-audio-", dir="/tmp")
    os.makedirs(os.path.join(d, "spkA"))
    for rel in ("spkA/x1.wav", "bob_y2.wav", "z3.wav"):
        with open(os.path.join(d, rel), "wb") as f:
            f.write(b"\x00\x01" * 8)
    _write(d, "spkA/x1.lab", "lab text")
    _write(d, "spkA/x1.txt", "txt text")
    _write(d, "bob_y2.text", "bob says")
    a = Mf.scan_audio_dir(spark, d)
    got = {r["utt"]: r["spk"] for r in a.collect()}
    assert got == {"spkA_x1": "spkA", "bob_y2": "bob", "z3": "default_speaker"}
    t = {r["utt"]: r["text"] for r in Mf.attach_sidecar_text(a, spark, d).collect()}
    assert t == {"spkA_x1": "txt text", "bob_y2": "bob says"}  # z3 has no transcript -> dropped
    pcm = spark.createDataFrame([(bytes([0, 0x80, 0xff, 0x7f]),)], "b binary")
    vals = pcm.select(Mf.pcm16_to_float("b").alias("v")).first()["v"]
    assert vals[0] == -1.0 and abs(vals[1] - 32767 / 32768) < 1e-6


def test_text_functions(spark):
    df = spark.createDataFrame([("a  b　c ", "<unk>ab c")], "t string, u string")
    r = df.select(X.word_tokens("t").alias("w"), X.char_tokens("u", ["<unk>"]).alias("c"),
                  X.field_slice(F.lit("k a b c"), "2-3").alias("f"), X.field_slice(F.lit("k a b c"), "3").alias("g"),
                  X.mixed_script_words(F.lit("ab中文 x")).alias("m")).first()
    assert r["w"] == ["a", "b", "c"] and r["c"] == ["<unk>", "a", "b", "c"]
    assert r["f"] == ["a", "b"] and r["g"] == ["b"] and r["m"] == ["ab", "中", "文", "x"]


def test_base64_audio_and_feature_maps(spark):
    from corpusvox.sources.sinks import audio_base64
    df = spark.createDataFrame([(bytes([1, 2, 3]),)], "b binary")
    assert df.select(audio_base64("b").alias("s")).first()["s"] == "AQID"
    # Precomputed feature maps are keyed Parquet tables, read and joined like any other
    d = tempfile.mkdtemp(prefix="cv-feat-", dir="/tmp")
    spark.createDataFrame([("u1", [0.5, 0.25])], "utt string, emb array<float>").write.parquet(f"{d}/utt2emb")
    back = spark.read.parquet(f"{d}/utt2emb").first()
    assert back["utt"] == "u1" and list(back["emb"]) == [0.5, 0.25]


def test_line_numbers_follow_path_order_whatever_the_file_sizes(spark):
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    sizes = {"part-00000": 3, "part-00001": 900, "part-00002": 0, "part-00003": 40, "part-00004": 300}
    want = []
    for name, n in sizes.items():
        lines = [f"{name} line {i} " + "x" * (i % 50) for i in range(n)]
        want += lines
        _write(d, name, "".join(x + "\n" for x in lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for block in ("1000", "7000", "128m"):  # many read blocks a file, and many files a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", block)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            got = {r["line_no"]: r["line"] for r in K.read_lines(spark, d, with_index=True).collect()}
            assert [got[i] for i in range(len(want))] == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_last_line_wins_and_positions_pair_over_many_files(spark):
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    os.makedirs(f"{d}/text"), os.makedirs(f"{d}/trials"), os.makedirs(f"{d}/scores")
    _write(f"{d}/text", "a", "u1 first\n")
    _write(f"{d}/text", "b", "".join(f"v{i} x\n" for i in range(500)) + "u1 middle\n")
    _write(f"{d}/text", "c", "u1 last\n")
    assert {r["value"] for r in K.read_keyed_text(spark, f"{d}/text").where("utt = 'u1'").collect()} == {"last"}
    pairs = [(f"u{i}", i) for i in range(60)]
    for part, rows in (("p0", pairs[:2]), ("p1", pairs[2:50]), ("p2", pairs[50:])):
        _write(f"{d}/trials", part, "".join(f"{u} r target\n" for u, _ in rows))
    for part, rows in (("p0", pairs[:40]), ("p1", pairs[40:])):
        _write(f"{d}/scores", part, "".join(f"{u} r {s}\n" for u, s in rows))
    j = K.read_trials(spark, f"{d}/trials").join(K.read_scores(spark, f"{d}/scores").drop("utt2").withColumnRenamed("utt1", "u"), "line_no")
    assert {(r["utt1"], r["u"]) for r in j.collect()} == {(u, u) for u, _ in pairs}


def test_segments_by_utt_and_by_recording(spark):
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    p = _write(d, "segments", "u2 r1 3.5 4\nu1 r1 0 2.5\nbad line\nu3 r2 1 2\n")
    seg = K.read_segments(spark, p)
    assert {r["utt"]: (r["rec"], r["st"], r["et"]) for r in K.segments_by_utt(seg).collect()} == {
        "u1": ("r1", 0.0, 2.5), "u2": ("r1", 3.5, 4.0), "u3": ("r2", 1.0, 2.0)}
    assert {r["rec"]: [tuple(s) for s in r["segments"]] for r in K.segments_by_rec(seg).collect()} == {
        "r1": [("u1", 0.0, 2.5), ("u2", 3.5, 4.0)], "r2": [("u3", 1.0, 2.0)]}


def test_shards_are_exact_and_the_list_reports_what_it_cannot_read(spark):
    from corpusvox.sources import sinks as Sk
    d = tempfile.mkdtemp(prefix="cv-src-", dir="/tmp")
    df = spark.range(0, 5500, 1, 7).select((F.col("id") * 37 % 5500).alias("k"), F.lit("x").alias("v"))
    shards = Sk.write_shards(df, "k", f"{d}/data", 1000).orderBy("shard").collect()
    assert [(s["shard"], s["rows"], s["first_key"], s["last_key"]) for s in shards] == [
        (i, 1000 if i < 5 else 500, 1000 * i, min(1000 * i + 999, 5499)) for i in range(6)]
    Sk.write_list(spark.createDataFrame(shards), f"{d}/list")
    with open(f"{d}/data/broken.parquet", "w") as f:
        f.write("not parquet")
    extra = [(6, f"{d}/data/broken.parquet"), (7, f"{d}/data/missing.parquet")]
    Sk.write_list(spark.createDataFrame(extra, "shard long, path string"), f"{d}/more")
    rows, rejects = Mf.read_parquet_list(spark, f"{d}/{{list,more}}")
    assert rows.count() == 5500 and rows.columns == ["k", "v"]
    assert {os.path.basename(r["path"]) for r in rejects.collect()} == {"broken.parquet", "missing.parquet"}
