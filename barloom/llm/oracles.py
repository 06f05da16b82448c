"""DuckDB SQL of the queries whose SQL is long."""

from __future__ import annotations

from .quality import CHAR_CLASSES, COMMON_WORDS, REFERENCE_LANGUAGES
from .secrets import RULES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x20\x09-\x0D]+"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    chars = ["length(t) - word_chars", *(f"len(regexp_extract_all(t, {_quote(p)}))" for p in CHAR_CLASSES.values())]
    common = [f"len(list_filter(low, lambda x: x = {_quote(w)}))" for w in COMMON_WORDS]
    known = ", ".join(map(_quote, REFERENCE_LANGUAGES))
    js = lambda a: f"sqrt(greatest(list_sum(list_transform(range(1, len({a}) + 1), lambda i: (CASE WHEN {a}[i] > 0 THEN {a}[i] / list_sum({a}) * log2({a}[i] / list_sum({a}) / (({a}[i] / list_sum({a}) + r{a}[i] / list_sum(r{a})) / 2)) ELSE 0 END + CASE WHEN r{a}[i] > 0 THEN r{a}[i] / list_sum(r{a}) * log2(r{a}[i] / list_sum(r{a}) / (({a}[i] / list_sum({a}) + r{a}[i] / list_sum(r{a})) / 2)) ELSE 0 END) / 2)), 0))"
    nc, nw = len(chars) + 1, len(common) + 1
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({known}) THEN lang ELSE '*' END AS lang, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
f AS (SELECT rid, doc_id, lang, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(w, '')), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines, list_transform(w, lambda x: lower(x)) AS low FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT rid, w, unnest(range(1, greatest(n_words - 7, 0) + 1)) AS i FROM f)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, coalesce(i - p, 8))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM twice) GROUP BY 1),
g AS (SELECT f.*, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  [{", ".join(f"CAST({c} AS DOUBLE)" for c in chars)}] AS c0, [{", ".join(f"CAST({c} AS DOUBLE)" for c in common)}] AS m0 FROM f LEFT JOIN rep USING (rid)),
h AS (SELECT *, list_append(c0, length(t) - list_sum(c0)) AS c, list_append(m0, n_words - list_sum(m0)) AS m FROM g),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM h),
r AS (SELECT lang, [{", ".join(f"sum(c[{i + 1}])" for i in range(nc))}] AS rc, [{", ".join(f"sum(m[{i + 1}])" for i in range(nw))}] AS rm FROM b WHERE NOT base_failed GROUP BY 1),
j AS (SELECT b.*, rc, rm FROM b LEFT JOIN r USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND CASE WHEN word_chars >= 200 THEN coalesce({js("c")} <= 0.27, true) ELSE true END AND CASE WHEN n_words >= 50 THEN coalesce({js("m")} <= CASE WHEN n_words >= 75 THEN 0.25 ELSE 0.3 END, true) ELSE true END AS kept FROM j"""


def secrets_sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = _quote(r.pattern)
        parts.append(
            f"SELECT rid, {k} AS k, {_quote(r.kind)} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: struct_pack(s := CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT), n := length(m[i]), j := length(j[i])))) AS x, {r.least} AS least FROM "
            f"(SELECT rid, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {r.group}) AS j FROM d)"
        )
    last = max(i for i, r in enumerate(RULES) if r.base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)}),
v AS (SELECT rid, k, kind, x.s AS a, x.s + x.n AS b, kind || ':' || x.s || ':' || (x.s + x.n) AS w FROM s WHERE x.j >= least),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(w, ',' ORDER BY a, k, b) FILTER (k <= {last}) AS base, string_agg(w, ',' ORDER BY a, k, b) AS spans FROM v GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_WORD}') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS x FROM d),
e AS (SELECT doc_id, unnest(x) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN s p ON p.doc_id = a JOIN s q ON q.doc_id = b WHERE 100 * n >= 80 * (len(p.x) + len(q.x) - n)),
k AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(a, b) AS (SELECT a, b FROM k UNION SELECT r.a, k.b FROM reach r JOIN k ON r.b = k.a),
m AS (SELECT a, min(b) AS low FROM reach GROUP BY 1)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(m.low, s.doc_id)) AS component_id FROM s LEFT JOIN m ON m.a = s.doc_id"""

SUFFIX = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(CAST(length(h) // 2 AS BIGINT) - 99, 0))) AS i FROM d)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
g AS (SELECT doc_id, i, sum(CAST(coalesce(i > p + 100, true) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM f)),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY 1, 2),
q AS (SELECT r.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) AS pb FROM r),
z AS (SELECT q.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS top, string_agg(substr(h, CAST(2 * pb + 1 AS BIGINT), CAST(2 * (a - pb) AS BIGINT)), '' ORDER BY a) AS head FROM q JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, CAST(2 * top + 1 AS BIGINT)), h))) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)"""
