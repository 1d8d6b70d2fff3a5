import itertools
import random

from corpusvox.functions.edit import align_counts


def brute_distance(h, r):
    d = list(range(len(r) + 1))
    for i, x in enumerate(h, 1):
        prev, d[0] = d[0], i
        for j, y in enumerate(r, 1):
            prev, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, prev + (x != y))
    return d[len(r)]


def test_counts_are_consistent_and_minimal():
    rnd = random.Random(7)
    for _ in range(300):
        r = [rnd.choice("abcd") for _ in range(rnd.randint(0, 8))]
        h = [rnd.choice("abcd") for _ in range(rnd.randint(0, 8))]
        cor, sub, ins, de, wrong = align_counts(h, r)
        assert cor + sub + de == len(r)
        assert cor + sub + ins == len(h)
        assert wrong == sub + ins + de == brute_distance([x.lower() for x in h], [x.lower() for x in r])


def test_edge_cases():
    assert align_counts([], []) == (0, 0, 0, 0, 0)
    assert align_counts([], ["a", "b"]) == (0, 0, 0, 2, 2)   # empty hypothesis: deletions
    assert align_counts(["a"], []) == (0, 0, 1, 0, 1)
    assert align_counts(["A", "b"], ["a", "B"]) == (2, 0, 0, 0, 0)  # case-insensitive
    # tie: substitution preferred over insertion+deletion
    assert align_counts(["x"], ["y"]) == (0, 1, 0, 0, 1)


def test_all_short_pairs_exhaustive():
    for n in range(4):
        for m in range(4):
            for h in itertools.product("ab", repeat=n):
                for r in itertools.product("ab", repeat=m):
                    c = align_counts(list(h), list(r))
                    assert c[4] == brute_distance(h, r)
