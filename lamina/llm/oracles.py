"""SQL for DuckDB that says what some corpus queries return."""

from __future__ import annotations

from lamina.llm import quality as Q
from lamina.llm import secrets as S

_WORD = r"[^\x20\x09-\x0D]"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def quality_sql() -> str:
    """op6: counts by windows over exploded words, and the verdict by lines."""
    symbols = lambda x: f"length({x}) - length(regexp_replace({x}, '[#*$%&|<>]', '', 'g'))"
    bars = "[|»›>•·]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}+') AS ws FROM d),
g AS (SELECT doc_id, i, list_slice(ws, i, i + {Q.REPEAT_WORDS - 1}) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {Q.REPEAT_WORDS - 2})) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {Q.REPEAT_WORDS})) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
c AS (SELECT doc_id, len(ls) - len(list_distinct(ls)) AS dups, list_sum(list_transform(list_filter(list_distinct(ls), lambda x: {symbols('x')} <= length(x) * {Q.MAX_SYMBOL_SHARE}
  AND NOT regexp_matches(x, '(?:{bars}[^|»›>•·]*){{{Q.MENU_MARKS}}}') AND (regexp_matches(x, '\\p{{Ll}}') OR NOT regexp_matches(x, '(?:\\p{{Lu}}[^\\p{{Lu}}]*){{{Q.SHOUT_LETTERS}}}'))
  AND NOT regexp_matches(x, {_quoted(Q.BOILERPLATE)})), lambda x: length(regexp_replace(x, '[\\x20\\x09-\\x0D]+', '', 'g')))) AS good FROM l),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, ({symbols('t')})::BIGINT AS n_symbols, dups::BIGINT AS n_dup_lines,
  coalesce(n.n, 0)::BIGINT AS n_repeat_words, coalesce(good, 0) AS good FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)),
b AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND CASE WHEN word_chars > 0 THEN good / word_chars ELSE 0 END >= {Q.MIN_KEPT} AS kept FROM b"""


def secrets_sql() -> str:
    """op2: places by gaps and matches, entropy by each window's characters."""
    kinds = (("assign", S.ASSIGN), ("access", S.ACCESS), ("hex", S.HEX), ("entropy", S.CANDIDATE))
    found = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS ord, '{kind}' AS kind, unnest(m) AS x, unnest(v) AS value, unnest(list_slice(gaps, 1, len(m))) AS gap, unnest(range(len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(t, {_quoted(p)}) AS m, "
        f"regexp_extract_all(t, {_quoted(p)}, {2 if k == 0 else 0}) AS v, string_split_regex(t, {_quoted(p)}) AS gaps FROM d)"
        for k, (kind, p) in enumerate(kinds)
    )
    allowed = " OR ".join(f"regexp_matches(x, {_quoted(p)})" for p in S.ALLOWED)
    best = f"(SELECT max(e) FROM (SELECT entropy(substr(x, s.j + o.j, 1)) AS e FROM (SELECT unnest(range(1, length(x) - {S.WINDOW - 2})) AS j) s, (SELECT unnest(range({S.WINDOW})) AS j) o GROUP BY s.j))"
    say = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord){where}, '')"
    base = " FILTER (ord < 3)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
p AS (SELECT *, sum(length(gap) + length(x)) OVER (PARTITION BY doc_id, ord ORDER BY i)::BIGINT AS e FROM f),
q AS (SELECT *, e - length(x) AS s FROM p),
g AS (SELECT * FROM q WHERE CASE ord WHEN 0 THEN length(value) >= 6 WHEN 3 THEN NOT ({allowed}) AND {best} >= CASE WHEN regexp_matches(x, '^[0-9a-fA-F]+$') THEN {S.HEX_BITS} ELSE {S.MIXED_BITS} END - 1e-9 ELSE true END)
SELECT d.doc_id, count(*) FILTER (ord = 0)::BIGINT AS n_assign, count(*) FILTER (ord = 1)::BIGINT AS n_access, count(*) FILTER (ord = 2)::BIGINT AS n_hex, sha256({say(base)}) AS base_sha256, {say('')} AS spans
FROM d LEFT JOIN g ON d.doc_id = g.doc_id GROUP BY d.doc_id"""
