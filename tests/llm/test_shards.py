import numpy as np
import pytest
from tests.llm.helpers import docs

from corpusvox.llm.shards import assign_shards, permuted


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_is_one_to_one_and_reproducible(n):
    got = permuted(np.arange(n), n, 7)
    assert sorted(got.tolist()) == list(range(n))
    assert got.tolist() == [int(permuted(np.array([i]), n, 7)[0]) for i in range(n)] if n <= 65 else True
    if n >= 1000:
        assert permuted(np.arange(n), n, 8).tolist() != got.tolist()
        assert abs(np.corrcoef(np.arange(n), got)[0, 1]) < 0.15


def test_shards_are_even_and_slots_gapless(spark):
    df = docs(spark).unionByName(docs(spark)).repartition(5)
    rows = assign_shards(df, ["doc_id", "text"], 6).collect()
    assert len(rows) == 20
    assert sorted(r.row_number for r in rows) == list(range(20))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = assign_shards(df.repartition(3), ["doc_id", "text"], 6).collect()
    key = lambda r: (r.doc_id or -1, r.text or "", r.shard, r.slot)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_empty_table_and_odd_names(spark):
    assert assign_shards(docs(spark, []), ["doc_id"], 4).count() == 0
    odd = docs(spark).withColumnsRenamed({"doc_id": "_tie", "lang": "_part"})
    assert assign_shards(odd, ["_tie", "_part"], 4).count() == 10
