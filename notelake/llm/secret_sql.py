"""The SQL of op13: the Markov models counted from the same samples, and spans cut at marked matches."""

from __future__ import annotations

from notelake.llm import secret_scan as S


def _any_case(names: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names)


_HEAD = rf"(?:{_any_case(S.NAMES)})[\"'']?\x20*[:=]\x20*[\"'']?"
#: (kind, pattern); SQL's expressions are linear and need no possessive repeats.
_PATTERNS = {
    "assign": rf"{_HEAD}[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
    "random": "[A-Za-z0-9+/_-]{16,}",
}
_CUTS = " UNION ALL ".join(
    f"SELECT r, {k} AS ord, '{kind}' AS kind, {S.LEAST[kind]} AS least, string_split(regexp_replace(text, '({_PATTERNS[kind]})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS a FROM d"
    for k, kind in enumerate(S.KINDS)
)
_BASED = "replace(base64(from_hex(h)), '=', '')"
_COMMON = ", ".join(f"'{name}'" for name in S.common_identifiers())
SQL = rf"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(3) || chr(3)) AS text FROM documents),
    g AS (SELECT sha256(CAST(i AS VARCHAR)) AS h FROM range({S.RANDOM}) x(i)),
    rnd AS (SELECT unnest([left(h, 40), {_BASED}, upper(regexp_replace({_BASED}, '[+/]', '', 'g'))]) AS s FROM g),
    few AS (SELECT list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9+/_-]+'), lambda x: length(x) BETWEEN 2 AND {S.SHORT}) AS a FROM documents ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, text LIMIT {S.ORDINARY}),
    ord AS (SELECT unnest(a || list_transform(range(1, len(a)), lambda i: CASE (i - 1) % 4 WHEN 0 THEN a[i] || '_' || a[i + 1] WHEN 1 THEN a[i] || upper(left(a[i + 1], 1)) || substr(a[i + 1], 2) WHEN 2 THEN a[i] || '-' || a[i + 1] ELSE a[i] || '/' || a[i + 1] END)) AS s FROM few),
    smp AS (SELECT true AS random, s FROM rnd UNION ALL SELECT false, s FROM ord UNION ALL SELECT false, unnest([{_COMMON}])),
    pairs AS (SELECT random, unnest(list_transform(range(1, length(s) + 1), lambda i: substr(' ' || s, i, 2))) AS pair FROM smp),
    cnt AS (SELECT random, instr('{S.ALPHABET}', left(pair, 1)) AS a, instr('{S.ALPHABET}', right(pair, 1)) AS b, count(*) AS n FROM pairs GROUP BY ALL),
    grid AS (SELECT random, a, b, coalesce(n, 0) AS n FROM (SELECT unnest([true, false]) AS random) CROSS JOIN range({S.STATES}) x(a) CROSS JOIN range(1, {S.STATES}) y(b) LEFT JOIN cnt USING (random, a, b)),
    prob AS (SELECT random, a, b, ln((n + {S.SMOOTHING}) / (sum(n) OVER (PARTITION BY random, a) + {S.SMOOTHING * len(S.ALPHABET)})) AS p FROM grid),
    llr AS MATERIALIZED (SELECT p.a, p.b, CAST(floor({S.UNIT} * (p.p - q.p) + 0.5) AS BIGINT) AS v FROM prob p JOIN prob q ON p.a = q.a AND p.b = q.b AND p.random AND NOT q.random),
    c AS (SELECT r, ord, kind, least, unnest(a) AS piece, generate_subscripts(a, 1) AS i FROM ({_CUTS})),
    pos AS (SELECT *, sum(length(piece) - CASE WHEN i > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY r, ord ORDER BY i) - length(piece) + CASE WHEN i > 1 THEN 1 ELSE 0 END AS start FROM c),
    m AS (SELECT r, ord, kind, least, i, CAST(start AS BIGINT) AS start, string_split(piece, chr(2))[1] AS match FROM pos WHERE i > 1),
    v AS MATERIALIZED (SELECT *, start + length(match) AS stop, CASE WHEN kind = 'assign' THEN regexp_replace(match, '^{_HEAD}', '') ELSE match END AS value FROM m),
    k AS MATERIALIZED (SELECT * FROM v WHERE length(value) >= least AND (kind <> 'random' OR regexp_matches(match, '[A-Za-z]') AND NOT regexp_matches(match, '{S.TWICE}'))),
    ch AS (SELECT r, ord, i, instr('{S.ALPHABET}', substr(value, j, 1)) AS b, CASE WHEN j = 1 THEN 0 ELSE instr('{S.ALPHABET}', substr(value, j - 1, 1)) END AS a FROM (SELECT *, unnest(range(1, length(value) + 1)) AS j FROM k)),
    sc AS (SELECT r, ord, i, CAST(coalesce(sum(v), 0) AS BIGINT) AS score FROM ch LEFT JOIN llr USING (a, b) GROUP BY r, ord, i),
    f AS (SELECT k.*, score FROM k JOIN sc USING (r, ord, i) WHERE kind <> 'random' OR score >= {S.THRESHOLD}),
    z AS (SELECT r, {", ".join(f"count_if(kind = '{x}') AS n_{x}" for x in S.KINDS)},
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) FILTER (ord < {len(S.BASE)}) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, ord) AS spans,
      string_agg(kind || ':' || start || ':' || stop || ':' || score, ',' ORDER BY start, ord) AS scored FROM f GROUP BY r)
    SELECT doc_id, {", ".join(f"CAST(coalesce(n_{x}, 0) AS BIGINT) AS n_{x}" for x in S.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scored, '') AS scored_spans
    FROM d LEFT JOIN z USING (r)"""
