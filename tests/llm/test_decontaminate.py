import random

from tests.llm.helpers import clashing, docs

from corpusvox.llm.decontaminate import find_contamination, tables_of, united


def brute(words, items, size=10):
    covered, found = set(), set()
    for item, text in items:
        w = text.split()
        m = min(len(w), size)
        for g in {tuple(w[i:i + m]) for i in range(len(w) - m + 1)} if w else ():
            for i in range(len(words) - m + 1):
                if tuple(words[i:i + m]) == g:
                    covered |= set(range(i, i + m))
                    found.add(item)
    return len(covered), sorted(found)


def test_search_equals_brute_force_on_random_words():
    rng = random.Random(3)
    for _ in range(60):
        alphabet = "abcd"[:rng.randint(1, 4)]
        items = [(str(i), " ".join(rng.choice(alphabet) for _ in range(rng.randint(1, 14)))) for i in range(rng.randint(1, 6))]
        words = [rng.choice(alphabet + "xy") for _ in range(rng.randint(0, 80))]
        windows = [(i, t.split()[k:k + 10]) for i, t in items for k in range(max(1, len(t.split()) - 9))]
        ids, tables = tables_of(windows)
        spans, found = [], set()
        for t in tables:
            t.search([ids.get(w.encode(), 0) for w in words], spans, found)
        assert (sum(b - a for a, b in united(spans)), sorted(found)) == brute(words, items)


ITEMS = [(1, "One two THREE four five six seven eight nine ten eleven twelve"), (2, "tiny item"), (3, ""), (4, None),
         (2, "tiny item"), (None, "no name item")]


def test_operator_on_odd_rows_in_one_block_and_in_many(spark):
    bench = spark.createDataFrame(ITEMS, "item_id int, text string")
    rows = [(1, "x two three, four-five six seven eight nine ten ELEVEN y tiny item", "a"), (2, None, "a"), (3, "", "a"),
            (None, "no name item", "a"), (5, "tiny\nitem tiny item", "a"), (5, "tiny\nitem tiny item", "a"), (6, "clean", "a")]
    want = {(1, 14, 12, "1,2"), (2, 0, 0, ""), (3, 0, 0, ""), (None, 3, 3, ""), (5, 4, 4, "2"), (6, 1, 0, "")}
    for block in (1000, 2):
        got = find_contamination(clashing(docs(spark, rows), "items", "spans"), bench, block_windows=block).collect()
        assert len(got) == 7
        assert {(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got} == want
        assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in got)


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id int, text string")
    assert not any(r.contaminated for r in find_contamination(docs(spark), bench).collect())
    assert find_contamination(docs(spark, []), bench).count() == 0
