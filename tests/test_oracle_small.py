"""Every registered query with a SQL twin must agree with DuckDB on the smallest tables."""
import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusvox.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["utt_assembly", "completeness_report", "length_filter", "spk2utt", "dedupe_last_wins", "keyset_diff",
        "vocabulary", "char_tokens", "wer_detail", "cer_detail", "error_rates", "min_dcf", "eer",
        "spk_embedding_mean", "nearest_centroid", "lfr_stack", "rank_slice", "parquet_shards", "nbest",
        "merge_turns", "split_overlaps", "diarization_postprocess", "assign_speakers", "diarization_error",
        "label_majority", "sentences", "srt_export", "edit_chain", "edit_requests", "codec_tokens",
        "noise_gate", "vad_segments_gated", "vad_visits_stream", "cif_heavy", "speakers_by_spectrum"]


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    sdf = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    s_rows = sorted((tuple(_norm(r[c]) for c in order) for r in sdf.collect()), key=repr)
    d_rows = sorted((tuple(_norm(r[dcols.index(c)]) for c in order) for r in res.fetchall()), key=repr)
    assert s_rows == d_rows


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "utt" in df.columns
