import re
from collections import Counter

from tests.llm.helpers import clashing, docs

from corpusvox.llm.divergence import Limits, quality_verdicts


def counted(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    many = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if many[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(words), len(inside)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep,
            n < 10 or 100 * rep > 20 * n)


def test_base_counts_match_brute_force_on_odd_rows(spark):
    df = docs(spark)
    rows = quality_verdicts(df).collect()
    got = sorted(((r.doc_id or -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                  r.base_failed) for r in rows)
    want = sorted(((r.doc_id or -1), *counted(r.text)) for r in df.collect())
    assert got == want
    assert all(not r.kept for r in rows if r.base_failed)


def test_divergent_text_fails_and_short_text_is_not_judged(spark):
    plain = "the cat sat on the mat and the dog lay in the sun while the birds sang in the tall trees "
    rows = [(i, " ".join(f"{w}{i}x{k}" if k % 4 == 3 else w for k, w in enumerate(plain.split() * 5)), "en") for i in range(12)]
    shouted = " ".join(f"{w.upper()}!!%{i}$" for i, w in enumerate(plain.split() * 5))
    rows += [(100, shouted, "en"), (101, " ".join(shouted.split()[:12]), "en")]
    got = {r.doc_id: r for r in quality_verdicts(docs(spark, rows)).collect()}
    assert all(got[i].kept for i in range(12))
    assert not got[100].kept and not got[100].base_failed
    assert got[100].class_distance > Limits().max_class_distance
    assert got[101].class_distance is None and got[101].word_distance is None and got[101].kept


def junk_rows():
    """500 texts of one label; 30 common words are 24 % of their words, all others are rare."""
    rows = []
    for i in range(500):
        words = [f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}ing{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k // 26)}{chr(97 + k % 26)}"
                 for k in range(100)]
        for k in range(24):
            words[4 * k] = f"the{chr(97 + (i * 24 + k) % 30 // 10)}{chr(97 + (i * 24 + k) % 10)}"
        rows.append((i, " ".join(words), "en"))
    rare = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}oneword" for k in range(120)]
    return [*rows, (900, " ".join(rare), "en"), (901, " ".join(w + "&&&" if k % 5 else w + "%%" for k, w in enumerate(rows[0][1].split())), "en")]


def test_text_without_common_words_and_words_ending_in_symbols_are_dropped(spark):
    got = {r.doc_id: r for r in quality_verdicts(docs(spark, junk_rows())).collect()}
    assert all(got[i].kept for i in range(500))
    assert not got[900].base_failed and got[900].class_distance < 0.25 and 0.35 < got[900].word_distance < 0.38
    assert not got[900].kept
    assert not got[901].base_failed and 0.25 < got[901].class_distance and not got[901].kept


def test_empty_table_and_clashing_columns(spark):
    assert quality_verdicts(docs(spark, [])).count() == 0
    out = quality_verdicts(clashing(docs(spark), "kept", "N_Words", "label", "_label", "extra"))
    assert out.columns.count("kept") == 1 and "extra" in out.columns and "N_Words" not in out.columns
    assert {r.extra for r in out.collect()} == {"old"}
