"""DuckDB SQL for the queries of the training-data operators."""

from __future__ import annotations

from corpusvox.llm import url_rules
from corpusvox.llm.divergence import CLASS_NAMES, CLASSES, Limits
from corpusvox.llm.url_rules import LISTED

LIM = Limits()
URL = url_rules.Limits()


def class_sql() -> str:
    """Columns c0.. of ``solid`` (the text without separators), in the order of CLASS_NAMES."""
    out, rest = [], "solid"
    for i, (_, pattern) in enumerate(CLASSES):
        less = f"regexp_replace({rest}, '{pattern}', '', 'g')"
        out.append(f"length({rest}) - length({less}) AS c{i + 1}")
        rest = less
    return ", ".join(["n_chars - length(solid) AS c0", *out, f"length({rest}) AS c{len(CLASSES) + 1}"])


def jsd_term(p: str, q: str) -> str:
    return (f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / (({p} + {q}) / 2)) ELSE 0 END + "
            f"CASE WHEN {q} > 0 THEN {q} * log2({q} / (({p} + {q}) / 2)) ELSE 0 END)")


N_CLASSES = len(CLASS_NAMES)
SUMS = " + ".join(f"c{i}" for i in range(N_CLASSES))
REF_SUMS = " + ".join(f"r{i}" for i in range(N_CLASSES))

OP1 = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(lang, '') AS label, coalesce(text, '') AS t,
         length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS solid FROM documents),
classes AS (SELECT k, {class_sql()} FROM d),
ref_classes AS (SELECT label, {', '.join(f'sum(c{i})::DOUBLE AS r{i}' for i in range(N_CLASSES))}
                FROM d JOIN classes USING (k) GROUP BY label),
w AS (SELECT k, label, w, row_number() OVER (PARTITION BY k ORDER BY p) AS p FROM (
        SELECT k, label, unnest(string_split_regex(t, '[\\x20\\x09-\\x0D]+')) AS w,
               generate_subscripts(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), 1) AS p FROM d) WHERE w <> ''),
n AS (SELECT k, count(*) AS n_words FROM w GROUP BY k),
vocabulary AS (SELECT label, w, count(*) AS n FROM w GROUP BY label, w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC) AS r,
                  sum(n) OVER (PARTITION BY label) AS total FROM vocabulary),
cut AS (SELECT label, max(CASE WHEN r = {LIM.common_words + 1} THEN n ELSE 0 END) AS least FROM ranked GROUP BY label),
common AS (SELECT label, w, n / total AS q FROM ranked JOIN cut USING (label) WHERE n > least),
rest AS (SELECT label, greatest(1 - coalesce(sum(q), 0), 0) AS q0, coalesce(sum(q), 0) AS all_q
         FROM (SELECT DISTINCT label FROM vocabulary) LEFT JOIN common USING (label) GROUP BY label),
hits AS (SELECT k, label, w, count(*) AS c, any_value(q) AS q FROM w JOIN common USING (label, w) GROUP BY k, label, w),
shared AS (SELECT k, sum(c) / any_value(n_words) AS p1,
                  sum({jsd_term('(c / n_words)', 'q')} - q) AS gain FROM hits JOIN n USING (k) GROUP BY k),
odd AS (SELECT k, sqrt(greatest((gain + all_q + {jsd_term('p0', 'q0')}) / 2, 0)) AS word_distance FROM (
          SELECT k, coalesce(gain, 0) AS gain, all_q, q0, 1 - coalesce(p1, 0) AS p0
          FROM n JOIN d USING (k) JOIN rest USING (label) LEFT JOIN shared USING (k))),
far AS (SELECT k, sqrt(greatest(({' + '.join(jsd_term(f'(c{i} / ({SUMS}))', f'(r{i} / ({REF_SUMS}))') for i in range(N_CLASSES))}) / 2, 0))
          AS class_distance FROM d JOIN classes USING (k) JOIN ref_classes USING (label) WHERE {SUMS} > 0),
win AS (SELECT k, p, list(w) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM w),
marked AS (SELECT k, p FROM (SELECT k, p, count(*) OVER (PARTITION BY k, g) AS c FROM win WHERE len(g) = 5) WHERE c > 1),
rep AS (SELECT k, count(*) AS n_repeat_words FROM (
          SELECT DISTINCT k, p + i AS p FROM marked, range(5) AS x(i)) GROUP BY k),
lines AS (SELECT k, unnest(string_split(t, chr(10))) AS x FROM d),
dup AS (SELECT k, count(*) - count(DISTINCT x) AS n_dup_lines FROM lines
        WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY k),
base AS (SELECT k, doc_id, coalesce(n_words, 0) AS n_words, length(solid) AS word_chars,
                length(regexp_replace(solid, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                CASE WHEN n_chars >= {LIM.min_class_chars} THEN class_distance END AS class_distance,
                CASE WHEN n_words >= {LIM.min_words} THEN word_distance END AS word_distance
         FROM d LEFT JOIN n USING (k) LEFT JOIN dup USING (k) LEFT JOIN rep USING (k)
              LEFT JOIN far USING (k) LEFT JOIN odd USING (k)),
judged AS (SELECT *, n_words < {LIM.base_min_words} OR 100 * n_repeat_words > {LIM.base_repeat_percent} * n_words AS base_failed
           FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(class_distance, 0) <= {LIM.max_class_distance}
         AND coalesce(word_distance, 0) <= {LIM.max_word_distance} AS kept,
       round(class_distance, 6) AS class_distance, round(word_distance, 6) AS word_distance
FROM judged"""


WORDS_2 = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS_2.format('text')} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {WORDS_2.format('text')} AS w FROM benchmark),
items AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
          FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
grams AS (SELECT k, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
          FROM (SELECT k, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM items) WHERE len(w) >= m)),
hits AS (SELECT k, i, m, item FROM grams JOIN items USING (m, g)),
covered AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + m)) AS p FROM (
              SELECT DISTINCT k, i, m FROM hits)) GROUP BY k),
found AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT k, item FROM hits) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (k) LEFT JOIN found USING (k)"""


def tokens_sql(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"list_distinct(list_filter(string_split_regex({low}, '[^a-z0-9]+'), lambda x: x <> ''))"


def listed_sql(value: int) -> str:
    rules = sorted(LISTED, key=lambda r: -len(r[1] + r[2]))
    tests = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN "
             f"'{(v, h + p)[value]}'" for v, h, p in rules]
    return f"CASE {' '.join(tests)} END"


OP10 = f"""
WITH u AS (SELECT row_number() OVER () AS k, page_id,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages),
p AS (SELECT k, page_id, regexp_extract(a, '^[^/?#]*([^?#]*)', 1) AS path, {tokens_sql('a')} AS t,
             translate(regexp_extract(a, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
      FROM u),
lab AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS blocked FROM labels GROUP BY doc_id
        HAVING bool_or(quality = 0 OR toxic = 1) IS NOT NULL),
x AS (SELECT k, t, blocked FROM p JOIN lab
      ON lab.doc_id = TRY_CAST(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT)),
nn AS (SELECT greatest(ceil({URL.min_support} * count(*)), {URL.min_urls}) AS least FROM x),
f AS (SELECT tok FROM (SELECT unnest(t) AS tok, blocked FROM x) WHERE blocked GROUP BY tok
      HAVING count(*) >= (SELECT least FROM nn)),
xf AS (SELECT k, blocked, list_sort(list(tok)) AS t
       FROM (SELECT k, blocked, unnest(t) AS tok FROM x) JOIN f USING (tok) GROUP BY k, blocked),
subsets AS (SELECT blocked, list_filter(t, lambda v, i: (m >> (i - 1)::BIGINT) & 1 = 1) AS s
            FROM (SELECT blocked, t, unnest(range(1, 1::BIGINT << len(t))) AS m FROM xf)),
rules AS (SELECT s FROM subsets GROUP BY s HAVING sum(blocked::INT) >= (SELECT least FROM nn)
          AND sum(blocked::INT) >= {URL.min_confidence} * count(*)),
caught AS (SELECT DISTINCT k FROM p JOIN rules ON list_has_all(p.t, rules.s))
SELECT page_id, host, path, {listed_sql(1)} AS rule,
       coalesce({listed_sql(0)}, CASE WHEN caught.k IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM p LEFT JOIN caught USING (k)"""


def placed_sql(separator: str) -> str:
    """(doc_id, x, start) of the parts of each text between the separators."""
    return f"""SELECT doc_id, x, coalesce(sum(length(x) + length(sep)) OVER (
             PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM (
  SELECT doc_id, unnest(string_split_regex(text, '{separator}')) AS x,
         unnest(list_append(regexp_extract_all(text, '{separator}'), '')) AS sep,
         generate_subscripts(string_split_regex(text, '{separator}'), 1) AS i FROM documents WHERE text IS NOT NULL)"""


PLAIN = "array_to_string(list_filter(string_split_regex(lower(nfc_normalize(x)), '\\s+'), lambda w: w <> ''), ' ')"
FIRST = """
ranked AS (SELECT *, first_value(doc_id) OVER g AS first_doc_id, first_value(start) OVER g AS first_start,
                  rank() OVER g AS r FROM units WINDOW g AS (PARTITION BY plain ORDER BY doc_id, start))
SELECT doc_id, start, stop AS "end", first_doc_id, first_start FROM ranked WHERE r > 1"""


def units_sql(separator: str) -> str:
    return f"""
WITH placed AS ({placed_sql(separator)}),
units AS (SELECT doc_id, start, start + length(x)::INT AS stop, {PLAIN} AS plain FROM placed WHERE {PLAIN} <> ''),{FIRST}"""


def passages_sql(min_chars: int = 90) -> str:
    """Lines, paragraphs of several lines, and runs of sentences, each span once."""
    lines, paragraphs = placed_sql("\\n"), placed_sql("\\n[^\\S\\n]*\\n\\s*")
    return f"""
WITH whole AS (SELECT doc_id, start, start + length(x)::INT AS stop, {PLAIN} AS plain FROM (
  {lines} UNION ALL SELECT * FROM ({paragraphs}) WHERE contains(x, chr(10)))),
cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\t]', '\\1' || chr(10), 'g'), chr(10)) AS l
        FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM cut),
placed AS (SELECT doc_id, x, i, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS start FROM pieces),
sentences AS (SELECT doc_id, start, start + length(x)::INT AS stop, {PLAIN} AS plain,
                     row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM placed WHERE {PLAIN} <> ''),
sums AS (SELECT *, sum(length(plain) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM sentences),
runs AS (SELECT a.doc_id, a.start, a.i, min(b.i) AS j FROM sums a JOIN sums b
         ON b.doc_id = a.doc_id AND b.i BETWEEN a.i AND a.i + {min_chars}
            AND b.upto - a.upto + length(a.plain) >= {min_chars} GROUP BY a.doc_id, a.start, a.i),
taken AS (SELECT runs.doc_id, runs.start, max(s.stop) AS stop, string_agg(s.plain, ' ' ORDER BY s.i) AS plain
          FROM runs JOIN sentences s ON s.doc_id = runs.doc_id AND s.i BETWEEN runs.i AND runs.j GROUP BY runs.doc_id, runs.start),
units AS (SELECT DISTINCT doc_id, start, stop, plain FROM (
  SELECT doc_id, start, stop, plain FROM whole WHERE length(plain) >= {min_chars} UNION ALL SELECT * FROM taken)),{FIRST}"""


OP3 = passages_sql()


def phrases_sql(max_words: int = 5, min_count: int = 100, top: int = 2000, covered_percent: int = 100) -> str:
    """Collocations: every n-gram counted by its text."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS size, array_to_string(w[i:i + {m - 1}], ' ') AS phrase FROM spots WHERE i + {m - 1} <= len(w)"
        for m in range(1, max_words + 1))
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents WHERE text IS NOT NULL),
ws AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM ws WHERE len(w) > 0),
f AS (SELECT lang, size, phrase, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {min_count}),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM ws GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size >= 2),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y
         FROM (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c)),
scores AS (SELECT cuts.*, fl.a AS l, fr.a AS r, n, (1000::HUGEINT * cuts.a * n) // (fl.a::HUGEINT * fr.a) AS score
           FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = x JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = y
           JOIN totals ON totals.lang = cuts.lang),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
             SELECT *, unnest(generate_series(1, size - m + 1)) AS i FROM (
               SELECT *, unnest(generate_series(2, size - 1)) AS m FROM c WHERE size > 2))),
covers AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY ALL),
ranked AS (SELECT lowest.*, row_number() OVER (PARTITION BY lowest.lang ORDER BY score DESC, lowest.a DESC,
                                              lowest.phrase) AS rank
           FROM lowest LEFT JOIN covers ON covers.lang = lowest.lang AND covers.phrase = lowest.phrase
           WHERE longer IS NULL OR 100 * longer < {covered_percent} * lowest.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {top}"""


OP13 = phrases_sql()


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """A product quantiser by full search, its rounds written out."""
    def nearest(r: int) -> str:
        return f"""a{r} AS MATERIALIZED (
  SELECT rid, x.p, x.s, j, list_sum(list_transform(list_zip(x.s, c.s), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
  FROM x JOIN c{r} c ON c.p = x.p QUALIFY row_number() OVER (PARTITION BY rid, x.p ORDER BY d, j) = 1)"""

    def moved(r: int) -> str:
        return f"""m{r} AS (SELECT p, j, i, sum(y)::HUGEINT AS t, count(*) AS n FROM (
  SELECT p, j, unnest(s) AS y, generate_subscripts(s, 1) AS i FROM a{r}) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT c.p, c.j, coalesce(e.s, c.s) AS s FROM c{r} c LEFT JOIN (
  SELECT p, j, list((((t - ((t % n) + n) % n) // n)::BIGINT) ORDER BY i) AS s FROM m{r} GROUP BY p, j) e
  ON e.p = c.p AND e.j = c.j)"""
    steps = ", ".join(f"{nearest(r)}, {moved(r)}" for r in range(rounds))
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
             list_transform(embedding, lambda y: floor({scale} * y::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS s
                   FROM v, generate_series(0, {parts - 1}) g(p)),
c0 AS MATERIALIZED (SELECT p, rid - 1 AS j, s FROM x WHERE rid <= {entries}),
{steps},
{nearest(rounds)},
total AS (SELECT rid, string_agg(lower(printf('%02x', j)), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid),
books AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY p, j)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM v JOIN total USING (rid), books"""


OP12 = codes_sql()
