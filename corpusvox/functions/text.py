"""Text column functions: tokenizers, field slices, gates.

Everything here returns a ``Column`` built from Spark built-ins, so it runs
inside whole-stage codegen; only ``compression_ratio`` (zlib) and ``korean_clean``
(62 replacements in each text) are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's ``str.split()`` treats as whitespace.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")
# the same set as one Java class: the Latin-1 ones are one bit set, the others are tried from U+1680 on
WS_CLASS = (r"[\t\n\x0b\f\r \x1c\x1d\x1e\x1f\x85\xa0[\x{1680}-\x{3000}&&"
            r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]")
WS_RUN = WS_CLASS + "+"

# Special symbols dropped from decoded token sequences.
SPECIAL_SYMBOLS = ("<s>", "</s>", "<unk>", "<OOV>")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` made once: inside a lambda a plain expression is made for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def py_strip(text) -> Column:
    """``str.strip()`` with Python's whitespace set."""
    return F.btrim(_c(text), F.lit(PY_WHITESPACE))


def word_tokens(text, delimiter: str | None = None) -> Column:
    """Word tokenizer: ``line.split(delimiter)`` (None = whitespace runs, no empties)."""
    t = _c(text)
    if delimiter is None:
        return F.filter(F.split(t, WS_RUN), lambda x: x != "")
    return F.split(t, re.escape(delimiter), -1)


def char_tokens(text, symbols: Iterable[str] = (), remove_symbols: bool = False) -> Column:
    """Character tokenizer: a listed symbol at the cursor is one token (longest
    first), a space is skipped, anything else is one code point.

    Only the ASCII space is skipped, as in the reference; other whitespace
    characters are tokens."""
    syms = sorted(set(symbols), key=lambda s: (-len(s), s))
    alt = "|".join(re.escape(s) for s in syms)
    pattern = f"({alt}|[^ ])" if alt else "([^ ])"
    toks = F.regexp_extract_all(_c(text), F.lit(pattern), 1)
    if remove_symbols and syms:
        toks = F.filter(toks, lambda x: ~x.isin(*syms))
    return toks


def mixed_script_words(text) -> Column:
    """runs of non-space ASCII are words; every other non-space char is a word."""
    return F.regexp_extract_all(_c(text), F.lit(r"([\x21-\x7e]+|[^\x00-\x7f])"), 1)


def is_english(word) -> Column:
    """a word is English when it is made of ASCII letters, digits or apostrophes."""
    return _c(word).rlike(r"^[A-Za-z0-9']+$")


def field_slice(line, field: str, delimiter: str | None = None) -> Column:
    """1-based field ranges ``n-``, ``n-m``, ``-m`` and ``n`` (one field)."""
    toks = word_tokens(line, delimiter)
    m = re.fullmatch(r"\s*(\d*)\s*(-?)\s*(\d*)\s*", field)
    if not m or (not m.group(1) and not m.group(3)):
        raise ValueError(f"bad field spec {field!r}")
    lo = int(m.group(1)) if m.group(1) else 1
    if m.group(2):
        hi = int(m.group(3)) if m.group(3) else None
    else:
        hi = lo
    if lo < 1 or (hi is not None and hi < lo):
        raise ValueError(f"bad field spec {field!r}")
    length = F.size(toks) - lo + 1 if hi is None else F.lit(hi - lo + 1)
    return F.slice(toks, F.lit(lo), F.greatest(length, F.lit(0)))


def drop_symbols(tokens, symbols: Sequence = SPECIAL_SYMBOLS) -> Column:
    """Remove special symbols (strings or ids) from a token array."""
    return F.filter(_c(tokens), lambda x: ~x.isin(*symbols))


def repetition_flag(tokens, window: int = 10, share: float = 0.1) -> Column:
    """P10: sequence of >= window tokens whose last token fills more than
    ``share`` of the last ``window`` positions."""
    def flag(t):
        return bound(F.slice(t, -window, window), lambda tail: F.size(F.filter(
            tail, lambda x: x == F.element_at(tail, -1)))) / F.lit(float(window)) > share
    return bound(_c(tokens), lambda t: (F.size(t) >= window) & flag(t))


@F.pandas_udf(T.DoubleType())
def compression_ratio(text: pd.Series) -> pd.Series:
    """UTF-8 bytes / zlib-compressed bytes (NULL text -> NULL)."""
    def one(s):
        if s is None:
            return None
        b = s.encode("utf-8")
        return len(b) / len(zlib.compress(b)) if b else None
    return text.map(one).astype("float64")


def quality_gate(compression, avg_logprob, no_speech_prob,
                 compression_threshold: float = 2.4, logprob_threshold: float = -1.0,
                 no_speech_threshold: float = 0.6) -> tuple[Column, Column]:
    """(needs_fallback, is_silence) columns."""
    fallback = (_c(compression) > compression_threshold) | (_c(avg_logprob) < logprob_threshold)
    silence = (_c(no_speech_prob) > no_speech_threshold) & ~(_c(avg_logprob) > logprob_threshold)
    return fallback, silence


# Korean readings of digits and of upper-case Latin letters.
KOREAN_DIGITS = {"0": "영", "1": "일", "2": "이", "3": "삼", "4": "사", "5": "오", "6": "육", "7": "칠", "8": "팔",
                 "9": "구"}
KOREAN_LETTERS = {"A": "에이", "B": "비", "C": "씨", "D": "디", "E": "이", "F": "에프", "G": "지", "H": "에이치",
                  "I": "아이", "J": "제이", "K": "케이", "L": "엘", "M": "엠", "N": "엔", "O": "오", "P": "피",
                  "Q": "큐", "R": "알", "S": "에스", "T": "티", "U": "유", "V": "브이", "W": "더블유", "X": "엑스",
                  "Y": "와이", "Z": "지"}


@F.pandas_udf(T.StringType())
def _korean_readings(text: pd.Series) -> pd.Series:
    """Readings hold no ASCII, so they are put in one after the other."""
    def one(s):
        for k, v in _READINGS.items():
            s = s.replace(k, v)
        return s
    return text.map(one, na_action="ignore")


_READINGS = {**KOREAN_DIGITS, **KOREAN_LETTERS, **{k.lower(): v for k, v in KOREAN_LETTERS.items()}}


def korean_clean(text) -> Column:
    """strip; digits -> Korean readings; ASCII letters (lower-case folded to
    upper) -> Korean letter names; everything else unchanged."""
    return _korean_readings(py_strip(text))


def _cjk_str(s: Column) -> Column:
    """A token counts as CJK when, compared as a whole string, it sorts inside the
    CJK ideograph block, inside '0'..'9', or is '@' (the reference compares strings)."""
    return ((s >= F.lit("一")) & (s <= F.lit("鿿"))) | ((s >= F.lit("0")) & (s <= F.lit("9"))) | (s == "@")


def _clean_tok(t: Column) -> Column:
    return F.regexp_replace(F.replace(t, F.lit(" "), F.lit("")), r"</s>|<s>|<unk>|<OOV>", "")


def _chars(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit("(?s)(.)"), 1)


def _all_cjk_chars(t: Column) -> Column:
    c = _chars(_clean_tok(t))
    return (F.size(c) > 0) & F.forall(c, lambda x: _cjk_str(x))


def _all_alpha_chars(t: Column) -> Column:
    c = _chars(_clean_tok(t))
    return (F.size(c) > 0) & F.forall(c, lambda x: (x.rlike(r"^\p{L}$") | (x == "'")) & ~_cjk_str(x))


def sentence_postprocess(tokens) -> Column:
    """F4 (text form): drop special symbols; an all-CJK token list is joined without
    spaces; an all-alphabetic list becomes space-separated words; otherwise tokens
    are folded left to right (CJK tokens glue to the previous word, '@@' pieces
    join the next word, alphabetic words are followed by a space, anything else
    is appended as is).  Runs of single ASCII letters separated by spaces then
    become one upper-case abbreviation; the result is stripped."""
    toks = F.filter(_c(tokens), lambda t: ~t.isin(*SPECIAL_SYMBOLS))
    cleaned = F.transform(toks, lambda t: _clean_tok(t))
    all_cjk = (F.size(cleaned) > 0) & F.forall(cleaned, lambda t: _cjk_str(t))
    empty = F.array().cast("array<string>")
    init = F.struct(empty.alias("w"), F.lit("").alias("item"), F.lit(False).alias("blank"))

    def step(acc, t):
        w, item, blank = acc["w"], acc["item"], acc["blank"]
        popped = F.when(blank & (F.size(w) > 0), F.slice(w, 1, F.size(w) - 1)).otherwise(w)
        return (F.when(_all_cjk_chars(t), F.struct(F.concat(popped, F.array(t)).alias("w"), item.alias("item"),
                                                   F.lit(False).alias("blank")))
                .when(F.instr(t, "@@") > 0, F.struct(w.alias("w"), F.concat(item, F.replace(t, F.lit("@@"), F.lit("")))
                                                     .alias("item"), F.lit(False).alias("blank")))
                .when(_all_alpha_chars(t), F.struct(F.concat(w, F.array(F.concat(item, t), F.lit(" "))).alias("w"),
                                                    F.lit("").alias("item"), F.lit(True).alias("blank")))
                .otherwise(F.struct(F.concat(w, F.array(t)).alias("w"), item.alias("item"), blank.alias("blank"))))

    # an all-alphabetic list folds to the same words as the general fold, so one
    # fold serves both; its finish step renders abbreviations on the folded array
    def render(words):
        n = F.size(words)
        is_letter = lambda i: F.coalesce(F.element_at(words, i + 1).rlike("^[A-Za-z]$"), F.lit(False))
        sp = lambda i: F.coalesce(F.element_at(words, i + 1) == " ", F.lit(False))

        def in_run(i):
            right = (i + 2 < n) & sp(i + 1) & is_letter(i + 2)
            left = (i - 2 >= 0) & sp(i - 1) & is_letter(i - 2)
            return is_letter(i) & (right | left)

        out = F.transform(words, lambda x, i: F.when(in_run(i), F.upper(x))
                          .when(sp(i) & (i >= 1) & (i + 1 < n) & in_run(i - 1) & in_run(i + 1), F.lit(""))
                          .otherwise(x))
        return F.array_join(out, "")

    folded = F.aggregate(toks, init, step, lambda acc: render(acc["w"]))
    joined = F.when(all_cjk, F.array_join(cleaned, "")).otherwise(folded)
    return py_strip(joined)
