"""Personal data by offset-preserving deobfuscation.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers in the text
as it stands.  Then a chain of transducers writes the text plainly: homoglyphs, other scripts'
digits, invisible characters, digits spelled as words, letters that stand for digits, and
at/dot disguises.  Each keeps, for every character it writes, the span of source characters
it came from; identifiers found in the plain text are mapped back through these spans and
added, unless they lie inside a base span of their kind.  An added span may overlap base spans,
which see only a part of a partly disguised identifier; the mask covers the union.

Defined results: a null text counts as empty; spans are in code points, end exclusive, sorted
by kind as listed and start; repeated rows each get a row; columns of the input that carry a
result's name are replaced, other extra columns pass through.  Every detector is linear in the
text, so very long texts and runs are no special case.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from corpusvox.llm.common import quoted, rows_udf, with_fields

KINDS = ["email", "ip", "card", "phone"]
SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                   StructField("end", IntegerType()), StructField("added", BooleanType())])
RESULT = StructType([StructField("pii", ArrayType(SPAN)), StructField("masked", StringType())])

Span = tuple[int, int]

LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def emails(text: str) -> list[Span]:
    """Each ``@`` with the local run before it and the domain after it; linear, unlike a plain scan."""
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d *= 1 + i % 2
        total += d - 9 * (d > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]


FIND = {"email": emails, "ip": ips, "card": cards, "phone": phones}

# Letters of other scripts that look like Latin ones, and signs that look like ASCII ones.
LOOKALIKES = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝ", "ABESIJKMHOPCTXYaesijopcxyhdqw", strict=True))
LOOKALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲ", "ABEZHIKMNOPTYXoc", strict=True))
LOOKALIKES |= {"ſ": "s", "ı": "i", "İ": "I"}  # re.I takes them for s and i
LOOKALIKES |= dict(zip("。․‧∙•﹒", "......", strict=True)) | {"﹫": "@", "﹢": "+", "﹪": "%"}
LOOKALIKES |= dict.fromkeys("‐‑‒–—−﹣", "-")
LOOKALIKES |= dict.fromkeys("             　", " ")
INVISIBLE = "­​‌‍⁠﻿"


def character_map() -> dict[str, str]:
    """Lookalikes, invisible characters, the full-width forms of ASCII, and every script's decimal digits."""
    out = LOOKALIKES | dict.fromkeys(INVISIBLE, "")
    out |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
    for c in map(chr, range(0x80, 0x20000)):
        if unicodedata.category(c) == "Nd":
            out[c] = str(unicodedata.decimal(c))
    return out


CHARACTERS = character_map()
ODD = re.compile("[" + re.escape("".join(CHARACTERS)) + "]")

# The digits 0 to 9 as words.
DIGIT_WORDS = {w: str(i) for words in (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(words.split())}
DIGIT = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
SPELLED = re.compile(rf"(?<!\w)(?:plus[ -]+(?={DIGIT}\b))?{DIGIT}(?:[ ,-]{{1,2}}{DIGIT})+(?!\w)", re.I)
#: Numbers with dots between them; some may be single digit words.
DOTTED = re.compile(rf"(?<!\w)(?:[0-9]++|{DIGIT})(?:(?:\s+dot\s+|\.)(?:[0-9]++|{DIGIT})(?!\w))+", re.I)
ONE_SPELLED = re.compile(DIGIT, re.I)
WORD = re.compile(r"\w+")

MIXED = re.compile(r"(?<![A-Za-z0-9])[0-9OolI]++(?![A-Za-z0-9])")
AS_DIGITS = str.maketrans("OolI", "0011")
LETTER_BY_DIGIT = re.compile("[0-9][OolI]|[OolI][0-9]")

BRACKET_AT = re.compile(r"(?<!\s)\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*", re.I)
BRACKET_DOT = re.compile(r"(?<!\s)\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*", re.I)
BRACKETED = re.compile(r"[\[({<]\s*(?:at|dot|[.@])\s*[\])}>]", re.I)
BARE_DOT = re.compile(r"(?<=[A-Za-z0-9-])\s+dot\s+(?=[A-Za-z0-9])", re.I)
#: A bare "at" counts only before a disguised dot, or after a name with a digit, dot or underscore inside.
BARE_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])\s+at\s+(?=[A-Za-z0-9-]+\s*(?:\sdot\s|[\[({<]\s*(?:dot|\.)\s*[\])}>]))", re.I)
NAMED_AT = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z][A-Za-z0-9._%+-]*+)(\s+at\s+)(?=[A-Za-z0-9-]+\.[A-Za-z]{2})", re.I)
#: What every match of NAMED_AT holds.
AT_DOMAIN = re.compile(r"\sat\s+[A-Za-z0-9-]+\.[A-Za-z]{2}", re.I)
INNER_SIGN = re.compile(r"[0-9._]")


def named_at(m: re.Match) -> str:
    name = m[1]
    return "@" if INNER_SIGN.search(name, 1) and not name.endswith(".") else m[2]


def mixed_digits(m: re.Match) -> str:
    """Digits with O, o, l or I among them read as digits, where two real digits are present."""
    return m[0].translate(AS_DIGITS) if sum(c.isdigit() for c in m[0]) >= 2 else m[0]


def dotted_words(text: str) -> Iterator[re.Match]:
    """The digit words beside a dot that has a number on its other side."""
    for run in DOTTED.finditer(text):
        yield from ONE_SPELLED.finditer(text, *run.span())


class Plain:
    """A text under rewriting, with the source span of each of its characters."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))

    def rewrite(self, pattern: re.Pattern, write, group: int = 0) -> None:
        """Replace each match by ``write(match)``; what is written carries the whole match's source span."""
        self.rewrite_all(pattern.finditer(self.text), write, group)

    def rewrite_all(self, matches: Iterable[re.Match], write, group: int = 0) -> None:
        text, start, end, last = [], [], [], 0
        for m in matches:
            new = write(m)
            a, b = m.span(group)
            if new == self.text[a:b] or a == b:
                continue
            text += [self.text[last:a], new]
            start += self.start[last:a] + [self.start[a]] * len(new)
            end += self.end[last:a] + [self.end[b - 1]] * len(new)
            last = b
        if last:
            self.text = "".join(text) + self.text[last:]
            self.start, self.end = start + self.start[last:], end + self.end[last:]

    def split_spelled(self) -> None:
        """Spelled digits one by one, so that a span may begin or end inside a run of them."""
        text, start, end, last = [], [], [], 0
        for run in SPELLED.finditer(self.text):
            a, b = run.span()
            text.append(self.text[last:a])
            start += self.start[last:a]
            end += self.end[last:a]
            if run[0][:4].lower() == "plus":
                text.append("+")
                start.append(self.start[a])
                end.append(self.end[a + 3])
            for m in ONE_SPELLED.finditer(self.text, a, b):
                text.append(DIGIT_WORDS[m[0].lower()])
                start.append(self.start[m.start()])
                end.append(self.end[m.end() - 1])
            last = b
        if last:
            self.text = "".join(text) + self.text[last:]
            self.start, self.end = start + self.start[last:], end + self.end[last:]


def disguised(text: str) -> bool:
    """Whether any transducer could change the text."""
    low = text.lower()
    if not text.isascii() and not CHARACTERS.keys().isdisjoint(text):
        return True
    if "dot" in low or BRACKETED.search(low) or LETTER_BY_DIGIT.search(text):
        return True
    if AT_DOMAIN.search(low):
        return True
    return not DIGIT_WORDS.keys().isdisjoint(WORD.findall(low))


def plain(text: str) -> Plain:
    p = Plain(text)
    if not text.isascii():
        p.rewrite(ODD, lambda m: CHARACTERS[m[0]])
    p.rewrite(BARE_AT, lambda m: "@")
    p.rewrite(BRACKET_AT, lambda m: "@")
    p.rewrite(BRACKET_DOT, lambda m: ".")
    p.rewrite(NAMED_AT, named_at, group=2)
    p.split_spelled()
    p.rewrite_all(dotted_words(p.text), lambda m: DIGIT_WORDS[m[0].lower()])
    p.rewrite(BARE_DOT, lambda m: ".")
    p.rewrite(MIXED, mixed_digits)
    return p


def base_spans(text: str) -> dict[str, list[Span]]:
    return {k: FIND[k](text) for k in KINDS}


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Identifiers that only the plain text shows, in source offsets."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not disguised(text):
        return out
    p = plain(text)
    if p.text == text:
        return out
    for kind in KINDS:
        known = base[kind]
        at = 0
        for a, b in FIND[kind](p.text):
            s, e = p.start[a], p.end[b - 1]
            while at < len(known) and known[at][1] < e:
                at += 1
            if at == len(known) or known[at][0] > s:
                out[kind].append((s, e))
    return out


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span written as its kind; of overlapping spans the first gives the name."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>"]
        last = max(last, b)
    return "".join(out) + text[last:]


def find_all(text: str | None, mask: bool = False) -> tuple[list[dict], str | None]:
    base = base_spans(text or "")
    more = added_spans(text or "", base)
    rows = [{"kind": k, "start": a, "end": b, "added": new} for k in KINDS
            for a, b, new in sorted([(a, b, False) for a, b in base[k]] + [(a, b, True) for a, b in more[k]])]
    if not mask or text is None:
        return rows, None
    return rows, masked(text, [(r["kind"], r["start"], r["end"]) for r in rows])


def find_pii(docs: DataFrame, text: str = "text", mask: bool = False) -> DataFrame:
    """``docs`` with pii, an array of (kind, start, end, added), and with ``mask`` the masked text."""
    def make(mask=mask):
        return lambda texts: [find_all(t, mask) for t in texts]
    names = ["pii", "masked"] if mask else ["pii"]
    return with_fields(docs, rows_udf(make, RESULT)(F.col(quoted(text))), names)
