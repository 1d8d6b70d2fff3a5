import itertools
import math

from corpusvox.llm.url_rules import Limits, judge_urls, mine_rules

SCHEMA = "page_id long, url string"


def labelled_rows():
    out = []
    for i in range(60):
        bad = i % 3 == 0
        out.append((f"http://{'spam' if bad else 'good'}{i % 2}.site.example/{'win' if bad or i % 7 == 0 else 'news'}/{i}", bad))
    return out


def brute(rows, limits):
    import re
    sets = [({t for t in re.split("[^a-z0-9]+", u.split("://")[1].lower()) if t}, b) for u, b in rows]
    least = max(math.ceil(limits.min_support * len(rows)), limits.min_urls)
    out = set()
    for s, bad in sets:
        if not bad:
            continue
        for k in range(1, len(s) + 1):
            for c in itertools.combinations(sorted(s), k):
                seen = [b for t, b in sets if set(c) <= t]
                if sum(seen) >= least and sum(seen) >= limits.min_confidence * len(seen):
                    out.add((c, round(sum(seen) / len(rows), 9), round(sum(seen) / len(seen), 9)))
    return out


def test_rules_equal_brute_force(spark):
    limits = Limits(min_support=0.05, min_urls=3, min_confidence=0.6)
    rows = labelled_rows()
    got = mine_rules(spark.createDataFrame(rows, "url string, blocked boolean"), limits=limits).collect()
    assert {(tuple(r.tokens), round(r.support, 9), round(r.confidence, 9)) for r in got} == brute(rows, limits)
    assert got


def test_listed_rules_win_and_mined_ones_judge_the_rest(spark):
    labelled = spark.createDataFrame(labelled_rows(), "url string, blocked boolean")
    pages = [
        (1, "https://A.Example.NET/en/x"), (2, "http://b.net/en/"), (3, "http://x.example.com/de/1?q"),
        (4, "ftp://deep.sub.org/fr/#a"), (5, "http://spam0.site.example/win/999"), (6, "http://good1.site.example/news/1"),
        (7, None), (8, "no scheme"), (9, "http://net"), (10, "http://example.net/EN/"), (11, "http://notexample.com/de/"),
        (12, "http://a.net?x://y"), (None, "http://host.net/a?b"), (5, "http://spam0.site.example/win/999")]
    df = spark.createDataFrame([(*p, "old", "old") for p in pages], SCHEMA + ", rule string, host string")
    out = judge_urls(df, labelled, limits=Limits(min_support=0.05, min_urls=3, min_confidence=0.6))
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(pages) and len(out.columns) == 6
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"), (2, "b.net", "/en/", "net/", "block"),
        (3, "x.example.com", "/de/1", "example.com/de/", "block"), (4, "deep.sub.org", "/fr/", "org/fr/", "allow"),
        (5, "spam0.site.example", "/win/999", None, "block"), (6, "good1.site.example", "/news/1", None, "allow"),
        (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "net", "", None, "allow"),
        (10, "example.net", "/EN/", "net/", "block"), (11, "notexample.com", "/de/", None, "allow"),
        (12, "a.net", "", None, "allow"), (None, "host.net", "/a", "net/", "block")}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://a.b/c")], SCHEMA)
    assert [r.verdict for r in judge_urls(pages, none).collect()] == ["allow"]
    assert judge_urls(spark.createDataFrame([], SCHEMA), none).count() == 0
