import random
import re

import numpy as np
import pytest
import xxhash
from tests.llm.helpers import clashing, docs

from corpusvox.llm.simhash import (block_sizes, component_labels, fingerprint_of, keep_one, near_duplicates, trie_components,
                                   trie_links)


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def components(values, most):
    """label by brute force: the least value reachable."""
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= most:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_equal_the_definition():
    rng = random.Random(1)
    texts = [None, "", "  \t", "one", "One two\x0bTHREE", "É é É é É"] + [
        " ".join(rng.choice(["Ab", "cd", "EF", "g", "ñ", "ß"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    for t in texts:
        got = fingerprint_of(t.encode() if t is not None else None)
        assert got & (2**64 - 1) == plain_fingerprint(t)


def near_values(rng, n, centres, flips):
    out = set()
    while len(out) < n:
        v = rng.choice(centres)
        for _ in range(rng.randint(0, flips)):
            v ^= 1 << rng.randint(0, 63)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("flips,most", [(3, 4), (9, 4), (5, 2), (64, 4), (2, 1)])
def test_trie_walk_joins_what_brute_force_joins(flips, most):
    rng = random.Random(flips)
    values = near_values(rng, 150, [rng.getrandbits(64) for _ in range(6)], flips)
    want = components(values, most)
    v = np.array(values, np.uint64)
    one = np.zeros(len(v), np.int64)
    label = trie_components(v, one, one, most, 0, width=64)
    assert [values[i] for i in label] == [want[x] for x in values]


@pytest.mark.parametrize("per_task", [100_000, 20])
def test_links_over_blocks_and_opened_subtrees(spark, per_task):
    rng = random.Random(9)
    values = near_values(rng, 160, [rng.getrandbits(64) for _ in range(3)], 8)
    want = components([signed(v) & (2**64 - 1) for v in values], 4)
    df = spark.createDataFrame([(signed(v),) for v in values], "value long")
    edges = trie_links(df, 4, per_task)
    got = {r.node: r.label for r in component_labels(edges).collect()}
    groups, found = {}, {}
    for v in values:
        groups.setdefault(want[v], set()).add(v)
        found.setdefault(got.get(signed(v), signed(v)), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))
    assert sum(block_sizes(4)) == 64 and len(block_sizes(4)) == 5


def test_chains_stars_and_cycles_end_in_one_label(spark):
    pairs = [(i + 1, i) for i in range(30)] + [(200 + i, 200) for i in range(1, 12)] + [(52, 50), (51, 50), (52, 51)]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 200 for i in range(200, 212)}, 50: 50, 51: 50, 52: 50}


def test_operator_on_odd_rows(spark):
    df = clashing(docs(spark), "value", "label", "fingerprint", "hash", "n")
    rows = near_duplicates(df).collect()
    assert len(rows) == 10
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    assert by[2] == by[3] == by[4] == ("0" * 16, 2)
    assert by[6][1] == 6 and len(by[1][0]) == 16
    kept = keep_one(df).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2, 5, 6, 7, 8]
    assert kept[0].asDict().keys() == set(df.columns)
    none = docs(spark, [(None, "same words here now", "x"), (None, "same words here now", "x"), (None, "", "x")])
    assert sorted(r.text for r in keep_one(none).collect()) == ["", "same words here now"]
    assert {r.component_id for r in near_duplicates(none).collect()} == {None}
    assert near_duplicates(docs(spark, [])).count() == 0 and keep_one(docs(spark, [])).count() == 0
