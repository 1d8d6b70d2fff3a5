import duckdb
import pytest
from tests.conftest import SMOKE

from corpusvox.llm.queries import ORACLE, QUERIES

NAMES = sorted(QUERIES)


def test_each_operator_has_one_query():
    numbers = [int(n[2:].split("_")[0]) for n in NAMES if n.startswith("op")]
    assert len(set(numbers)) == len(numbers) and set(numbers) == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SMOKE)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    res = con.execute(ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, res.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*names).collect())


def test_query_schemas(spark):
    want = {
        "op4": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        "op6": "doc_id bigint, held_out boolean, lang_pred string, score double",
        "op8": "doc_id bigint, fingerprint string, component_id bigint"}
    for n in NAMES:
        if n.split("_")[0] in want:
            types = ", ".join(f"{a} {b}" for a, b in QUERIES[n](spark, SMOKE).dtypes)
            assert types == want[n.split("_")[0]]
