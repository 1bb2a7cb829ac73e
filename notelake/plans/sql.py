"""Common table expressions of the checking SQL (DuckDB)."""

from __future__ import annotations

from notelake import spec


def doubles(values) -> str:
    return "[" + ", ".join(f"{v!r}::DOUBLE" for v in values) + "]"


RAW = """raw0 AS (SELECT event_id, user_id AS piece_id, epoch_us(ts) AS us, value, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events),
raw1 AS (SELECT piece_id, event_id, CAST(us - min(us) OVER (PARTITION BY piece_id) AS DOUBLE) / CAST(6.0e10 AS DOUBLE) AS onset,
  greatest(CAST(1e-4 AS DOUBLE), value / 100) AS duration, k + 21 AS pitch, CAST(event_id * 37 % 128 AS INTEGER) AS velocity,
  CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 4 ELSE 40 END AS program, event_type = 'error' AS is_drum FROM raw0),
notes_all AS (SELECT *, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY onset, pitch, duration, velocity, event_id) - 1 AS INTEGER) AS note_ix FROM raw1)"""
NOTES = (
    RAW
    + """,
notes AS (SELECT * EXCLUDE note_ix, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY note_ix) - 1 AS INTEGER) AS note_ix FROM notes_all WHERE pitch BETWEEN 21 AND 108)"""
)
SOURCE = "list_extract(['aria_midi', 'maestro', 'giant_midi', 'adl_piano'], CAST(piece_id % 4 + 1 AS INTEGER))"
COMPOSER = "CASE WHEN piece_id % 11 = 0 THEN '' ELSE 'composer_' || CAST(piece_id % 7 AS VARCHAR) END"
DELTA_EDGES, DURATION_EDGES = doubles(spec.DELTA_EDGES), doubles(spec.DURATION_EDGES)
QUADS = (
    NOTES
    + f""",
gaps AS (SELECT *, greatest(0.0, onset - coalesce(lag(onset) OVER (PARTITION BY piece_id ORDER BY note_ix), 0)) AS gap FROM notes),
quads AS (SELECT piece_id, note_ix, onset, duration, pitch, velocity,
  CAST(CASE WHEN gap <= 0 THEN 0 ELSE 1 + greatest(0, least(126, len(list_filter({DELTA_EDGES}, lambda e: e <= greatest(1e-4::DOUBLE, least(8.0::DOUBLE, gap)))) - 1)) END AS INTEGER) AS delta_tok,
  CAST(128 + pitch - 21 AS INTEGER) AS pitch_tok,
  CAST(216 + greatest(0, least(127, len(list_filter({DURATION_EDGES}, lambda e: e <= greatest((1.0/64)::DOUBLE, least(8.0::DOUBLE, duration)))) - 1)) AS INTEGER) AS dur_tok,
  CAST(344 + velocity // 8 AS INTEGER) AS vel_tok FROM gaps)"""
)
#: Bodies of the pieces as token rows.
TOKENS = (
    QUADS
    + """,
tokens AS (SELECT piece_id, CAST(note_ix * 4 + s.slot AS INTEGER) AS pos, CASE s.slot WHEN 0 THEN delta_tok WHEN 1 THEN pitch_tok WHEN 2 THEN dur_tok ELSE vel_tok END AS tok, onset, duration
  FROM quads, (VALUES (0), (1), (2), (3)) s(slot))"""
)
SWEEP = (
    NOTES
    + """,
bounds AS (SELECT piece_id, greatest(0.0, onset) AS t, 1 AS d, event_id FROM notes UNION ALL SELECT piece_id, greatest(onset + 1e-4::DOUBLE, onset + duration), -1, event_id FROM notes),
active AS (SELECT piece_id, t, sum(d) OVER w AS n, lead(t) OVER w - t AS span FROM bounds WINDOW w AS (PARTITION BY piece_id ORDER BY t, d DESC, event_id ROWS UNBOUNDED PRECEDING)),
poly AS (SELECT piece_id, CASE WHEN sum(span) > 0 THEN sum(n * span) / sum(span) ELSE max(n) END AS mean_voices, CAST(greatest(1, max(n)) AS DOUBLE) AS peak_voices FROM active GROUP BY piece_id)"""
)
DENSITY = """dens AS (SELECT piece_id, count(*) / greatest(1e-3::DOUBLE, max(onset + greatest(1e-4::DOUBLE, duration)) - min(onset)) AS density, median(pitch) AS median_pitch FROM notes GROUP BY piece_id)"""
QUARTILES = """quart0 AS (SELECT quantile_cont(density, [0.25, 0.5, 0.75]) AS q, count(*) AS n FROM dens WHERE density > 0),
quart1 AS (SELECT CASE WHEN n >= 8 THEN greatest(1e-4::DOUBLE, q[1]) ELSE 1.0 END AS q1, CASE WHEN n >= 8 THEN q[2] ELSE 2.5 END AS a2, CASE WHEN n >= 8 THEN q[3] ELSE 5.0 END AS a3 FROM quart0),
quart2 AS (SELECT q1, greatest(a2, q1 + 1e-4::DOUBLE) AS q2, a3 FROM quart1),
quart AS (SELECT q1, q2, greatest(a3, q2 + 1e-4::DOUBLE) AS q3 FROM quart2)"""
TAGS = f"""{SWEEP}, {DENSITY}, {QUARTILES},
tags AS (SELECT piece_id, CAST(363 + CASE WHEN density <= q1 THEN 0 WHEN density <= q2 THEN 1 WHEN density <= q3 THEN 2 ELSE 3 END AS INTEGER) AS density_tok,
  CAST(367 + CASE WHEN peak_voices <= 1.05 AND greatest(1, mean_voices) < 1.2 THEN 0 WHEN greatest(1, mean_voices) < 2 AND peak_voices <= 3 THEN 1 WHEN greatest(1, mean_voices) < 3.5 AND peak_voices <= 6 THEN 2 ELSE 3 END AS INTEGER) AS voices_tok,
  CAST(371 + CASE WHEN median_pitch < 48 THEN 0 WHEN median_pitch <= 72 THEN 1 ELSE 2 END AS INTEGER) AS register_tok
  FROM dens JOIN poly USING (piece_id), quart)"""
