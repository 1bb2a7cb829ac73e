"""The SQL of op11: damage, faults and the four-state recursion, and the repaired turns read off the audit string."""

from __future__ import annotations

#: A path is nine digits of cost and then its audit, so the least string is the least (cost, audit).
_COST = 9


def _longer(path: str, cost: str, edit: str) -> str:
    return f"(lpad(CAST(CAST(substr({path}, 1, {_COST}) AS BIGINT) + {cost} AS VARCHAR), {_COST}, '0') || substr({path}, {_COST + 1}) || '{edit}')"


_BASE = f"""
    SELECT r.k, n.i, {_longer("s", "3", "D")} AS s,
      CASE WHEN ok AND initial = 's' THEN least({_longer("y", "3", "D")}, {_longer("s", "worn", "K")}) ELSE {_longer("y", "3", "D")} END AS y,
      CASE WHEN ok THEN least({_longer("u", "3", "D")}, {_longer("before", "2 + worn", "R")}, CASE WHEN initial = 'u' THEN {_longer("before", "worn", "K")} END) ELSE {_longer("u", "3", "D")} END AS u,
      CASE WHEN ok THEN least({_longer("a", "3", "D")}, {_longer("u", "2 + worn", "R")}, CASE WHEN initial = 'a' THEN {_longer("u", "worn", "K")} END) ELSE {_longer("a", "3", "D")} END AS a
    FROM (SELECT *, least(s, y, a) AS before FROM run) r JOIN f n ON n.k = r.k AND n.i = r.i + 1"""

SQL = rf"""
    WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, b: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
    c AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
    o AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, list_transform(string_split(coalesce(CAST(v.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes
      FROM conversations v JOIN c ON c.conv_id IS NOT DISTINCT FROM v.conv_id),
    h AS (SELECT k, turn, role, text, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, b: xor(x >> 8, t[(xor(x, b) & 255) + 1])), 4294967295) % 20 AS kind FROM o, t),
    d AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
      unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM h WHERE kind <> 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS tail FROM d),
    g AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
      lag(initial) OVER (PARTITION BY k ORDER BY i) || initial AS pair FROM n),
    f AS MATERIALIZED (SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CAST(fault = 'truncated' AS BIGINT) AS worn FROM g),
    run AS (SELECT k, CAST(0 AS BIGINT) AS i, repeat('0', {_COST}) AS s, CAST(NULL AS VARCHAR) AS y, lpad('2', {_COST}, '0') || 'I' AS u, lpad('4', {_COST}, '0') || 'II' AS a FROM c
      UNION ALL SELECT k, i, s, y, u, least(a, {_longer("u", "2", "I")}) FROM (SELECT k, i, s, y, least(u, {_longer("least(s, y, a)", "2", "I")}) AS u, a FROM ({_BASE}) b) b),
    best AS (SELECT k, least(s, a) AS path FROM run JOIN (SELECT k, max(i) AS i FROM run GROUP BY k) USING (k, i)),
    e AS (SELECT k, unnest(string_split(substr(path, {_COST + 1}), '')) AS edit, generate_subscripts(string_split(substr(path, {_COST + 1}), ''), 1) AS j FROM best WHERE length(path) > {_COST}),
    p AS (SELECT *, count_if(edit <> 'I') OVER (PARTITION BY k ORDER BY j) AS i, count_if(edit <> 'D') OVER (PARTITION BY k ORDER BY j) AS place FROM e),
    w AS (SELECT p.*, f.role, f.text, max(CASE WHEN place = 1 AND edit = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.k) AS head FROM p LEFT JOIN f ON f.k = p.k AND f.i = p.i AND edit <> 'I' WHERE edit <> 'D'),
    z AS (SELECT k, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - head) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole FROM w GROUP BY k),
    q AS (SELECT k, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
      count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY k)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
      CAST(substr(path, 1, {_COST}) AS BIGINT) AS cost, substr(path, {_COST + 1}) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
    FROM c JOIN best USING (k) LEFT JOIN q USING (k) LEFT JOIN z USING (k)"""
