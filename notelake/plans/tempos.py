"""Queries over tempo maps: segments, look-ups both ways, and bar and position tokens with real tempi."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.operators import remi, tempo
from notelake.plans import sql as S
from notelake.plans.pieces import _r
from notelake.plans.registry import query
from notelake.sources import bind
from notelake.sources.interim import keep

_MAP = f"""{S.NOTES},
chg AS (SELECT piece_id, onset AS seconds, CAST(60 + event_id * 13 % 120 AS DOUBLE) AS bpm FROM notes WHERE program = 4),
one AS (SELECT piece_id, seconds, coalesce(max(bpm), 120.0::DOUBLE) AS bpm FROM (SELECT piece_id, greatest(0.0::DOUBLE, seconds) AS seconds, bpm FROM chg UNION ALL SELECT DISTINCT piece_id, 0.0::DOUBLE, CAST(NULL AS DOUBLE) FROM notes) GROUP BY ALL),
spn AS (SELECT *, bpm * 220 / 60 AS rate, coalesce((seconds - lag(seconds) OVER w) * (lag(bpm) OVER w * 220 / 60), 0.0) AS span FROM one WINDOW w AS (PARTITION BY piece_id ORDER BY seconds)),
map AS MATERIALIZED (SELECT piece_id, CAST(row_number() OVER w - 1 AS INTEGER) AS segment, seconds, sum(span) OVER w AS tick, bpm, rate FROM spn WINDOW w AS (PARTITION BY piece_id ORDER BY seconds ROWS UNBOUNDED PRECEDING))"""


def _tick(at: str) -> str:
    return f"CAST(round_even(m.tick + (greatest(0.0, {at}) - m.seconds) * m.rate, 0) AS BIGINT)"


def _seconds(at: str) -> str:
    return f"m.seconds + ({at} - m.tick) / m.rate"


def _snap(tick: str) -> str:
    return f"CAST(round_even({tick} / 55, 0) * 55 AS BIGINT)"


_EVENTS = f"""{_MAP},
stp AS (SELECT m.piece_id, {_seconds("55")} AS step FROM (SELECT DISTINCT piece_id, 55.0::DOUBLE AS at FROM map) x ASOF JOIN map m ON x.piece_id = m.piece_id AND x.at >= m.tick),
ev AS (SELECT n.piece_id, {_snap(_tick("n.onset"))} AS tick, 20 AS ord, n.pitch AS a, CAST(n.velocity // 4 AS INTEGER) AS b, CAST(least(greatest(round_even(greatest(1e-4::DOUBLE, n.duration) / step, 0), 1), 64) AS INTEGER) AS c
    FROM (SELECT * FROM notes WHERE NOT is_drum AND program <> 4) n ASOF JOIN map m ON n.piece_id = m.piece_id AND n.onset >= m.seconds JOIN stp ON stp.piece_id = n.piece_id
  UNION ALL SELECT n.piece_id, {_snap(_tick("n.onset"))}, 30, CASE WHEN n.velocity >= 64 THEN 1 ELSE 0 END, 0, 0 FROM (SELECT * FROM notes WHERE is_drum) n ASOF JOIN map m ON n.piece_id = m.piece_id AND n.onset >= m.seconds
  UNION ALL SELECT piece_id, {_snap("round_even(tick, 0)")}, 10, CAST(round_even((greatest(30.0, least(240.0, bpm)) - 30.0) / 210.0 * 63, 0) AS INTEGER), 0, 0 FROM map),
en AS (SELECT *, row_number() OVER (PARTITION BY piece_id ORDER BY tick, ord, a, b, c) AS n, tick // 880 AS bar FROM ev),
el AS (SELECT *, bar - coalesce(lag(bar) OVER w, -1) AS bars, coalesce(lag(tick) OVER w, 0) AS since, (tick - coalesce(lag(tick) OVER w, 0)) // 55 AS gap FROM en WINDOW w AS (PARTITION BY piece_id ORDER BY n)),
eg AS (SELECT *, CAST(greatest(0, ceil((gap - 64) / 64)) AS BIGINT) AS lng FROM el),
tk AS (SELECT piece_id, n, list_transform(range(bars), lambda i: {{'tok': 3, 'tick': (bar - bars + 1 + i) * 880, 'units': 1}})
  || list_transform(range(lng), lambda i: {{'tok': 307, 'tick': since + i * 3520, 'units': 64}})
  || CASE WHEN gap - lng * 64 > 0 THEN [{{'tok': 243 + gap - lng * 64, 'tick': since + lng * 3520, 'units': gap - lng * 64}}] ELSE [] END
  || [{{'tok': 4 + (tick - bar * 880) // 55, 'tick': tick, 'units': 1}}]
  || list_transform(CASE ord WHEN 10 THEN [308 + a] WHEN 30 THEN [CASE WHEN a = 1 THEN 372 ELSE 373 END] ELSE [20 + a, 148 + b, 179 + c] END, lambda x: {{'tok': x, 'tick': tick, 'units': CASE ord WHEN 20 THEN c ELSE 1 END}}) AS parts FROM eg),
rws AS (SELECT piece_id, n, unnest(parts) AS p, generate_subscripts(parts, 1) AS k FROM tk UNION ALL SELECT DISTINCT piece_id, 0, {{'tok': 1, 'tick': 0, 'units': 1}}, 0 FROM ev UNION ALL SELECT piece_id, count(*) + 1, {{'tok': 2, 'tick': max(tick), 'units': 1}}, 0 FROM ev GROUP BY piece_id),
tkn AS MATERIALIZED (SELECT piece_id, CAST(row_number() OVER (PARTITION BY piece_id ORDER BY n, k) - 1 AS INTEGER) AS pos, CAST(p.tok AS INTEGER) AS tok, CAST(p.tick AS BIGINT) AS tick, CAST(p.units AS INTEGER) AS units FROM rws)"""


def _notes(spark, sf_dir) -> DataFrame:
    return keep(bind.notes(spark, sf_dir).select("piece_id", "note_ix", "event_id", "onset", "duration", "pitch", "velocity", "program", "is_drum"), "notes")


def _map(notes: DataFrame) -> DataFrame:
    return keep(tempo.segments(bind.tempo_changes(notes), notes.select("piece_id")), "tempo-map")


def _tokens(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Tokens with ticks, and the map."""
    notes = _notes(spark, sf_dir)
    map_ = _map(notes)
    ev = tempo.events(notes.filter("NOT is_drum AND program <> 4"), bind.pedal_moves(notes), map_)
    return remi.encode(keep(ev, "events"), times=True), map_


@query(f"WITH {_MAP} SELECT piece_id, segment, round(seconds, 6) AS seconds, round(tick, 4) AS tick, bpm FROM map")
def tempo_segments(spark, sf_dir):
    """The tempo map of each piece."""
    return _map(_notes(spark, sf_dir)).select("piece_id", "segment", _r("seconds", 6).alias("seconds"), _r("tick", 4).alias("tick"), "bpm")


@query(
    f"""WITH {_MAP}, t AS (SELECT n.piece_id, n.note_ix, n.onset, {_tick("n.onset")} AS tick FROM notes n ASOF JOIN map m ON n.piece_id = m.piece_id AND n.onset >= m.seconds),
    b AS (SELECT t.*, {_seconds("t.tick")} AS back, m.rate AS rate FROM t ASOF JOIN map m ON t.piece_id = m.piece_id AND t.tick >= m.tick)
    SELECT piece_id, note_ix, tick, round(back, 6) AS back, abs(back - onset) * rate <= 1.5 AS close FROM b"""
)
def tempo_round_trip(spark, sf_dir):
    """Each note's tick by the map and its seconds back: the inverse is within a tick and a half (half a tick, and the map's own change of rate)."""
    notes = _notes(spark, sf_dir)
    map_ = _map(notes)
    ticks = tempo.to_ticks(notes.select("piece_id", "note_ix", "onset"), "onset", map_)
    back = tempo.to_seconds(ticks, "tick", map_, "back")
    rate = tempo._as_of(back, "tick", map_, "tick", float(tempo.BLOCK_TICKS))
    return rate.select("piece_id", "note_ix", "tick", _r("back", 6).alias("back"), (F.abs(F.col("back") - F.col("onset")) * F.col("of.rate") <= 1.5).alias("close"))


@query(
    f"""WITH {_EVENTS}, s AS (SELECT t.*, {_seconds("t.tick")} AS onset FROM tkn t ASOF JOIN map m ON t.piece_id = m.piece_id AND t.tick >= m.tick)
    SELECT s.piece_id, pos, tok, round(onset, 6) AS onset, round(greatest(1e-4::DOUBLE, {_seconds("(s.tick + units * 55)")} - onset), 6) AS duration FROM (SELECT *, tick + units * 55 AS fin FROM s) s ASOF JOIN map m ON s.piece_id = m.piece_id AND s.fin >= m.tick"""
)
def remi_tempo_encode(spark, sf_dir):
    """Bar and position tokens with the piece's real tempo changes and pedal moves, and each token's time by the tempo map."""
    timed, map_ = _tokens(spark, sf_dir)
    return tempo.token_times(timed, map_).select("piece_id", "pos", "tok", _r("onset", 6).alias("onset"), _r("duration", 6).alias("duration"))


@query(
    f"""WITH {_EVENTS}, d AS (SELECT piece_id, pos, tok, greatest(0, sum(CASE WHEN tok = 3 THEN 1 ELSE 0 END) OVER w - 1) * 880 + last_value(CASE WHEN tok BETWEEN 4 AND 19 THEN tok - 4 END IGNORE NULLS) OVER w * 55 AS place,
      last_value(CASE WHEN tok BETWEEN 20 AND 147 THEN tok - 20 END IGNORE NULLS) OVER w AS pitch, last_value(CASE WHEN tok BETWEEN 148 AND 179 THEN tok - 148 END IGNORE NULLS) OVER w AS bin FROM tkn WINDOW w AS (PARTITION BY piece_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    tm AS (SELECT piece_id, place, (30.0 + arg_max(tok - 308, pos) / 63.0 * 210.0)::DOUBLE * 220 / 60 AS rate FROM d WHERE tok BETWEEN 308 AND 371 GROUP BY ALL),
    ts AS (SELECT *, coalesce((place - lag(place) OVER w) / lag(rate) OVER w, 0.0) AS span FROM tm WINDOW w AS (PARTITION BY piece_id ORDER BY place)),
    mp AS MATERIALIZED (SELECT piece_id, CAST(place AS DOUBLE) AS tick, rate, sum(span) OVER (PARTITION BY piece_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS seconds FROM ts),
    sp AS (SELECT x.piece_id, {_seconds("55")} AS step FROM (SELECT DISTINCT piece_id, 55.0::DOUBLE AS at FROM mp) x ASOF JOIN mp m ON x.piece_id = m.piece_id AND x.at >= m.tick)
    SELECT d.piece_id, pos, round({_seconds("d.place")}, 6) AS onset, CAST(pitch AS INTEGER) AS pitch, CAST(bin * 4 + 2 AS INTEGER) AS velocity, round((tok - 179) * step, 6) AS duration
    FROM (SELECT * FROM d WHERE tok BETWEEN 180 AND 243) d ASOF JOIN mp m ON d.piece_id = m.piece_id AND d.place >= m.tick JOIN sp ON sp.piece_id = d.piece_id"""
)
def remi_tempo_decode(spark, sf_dir):
    """Those tokens as notes again, in seconds by the tempi that stand among them."""
    timed, _ = _tokens(spark, sf_dir)
    return tempo.decode(timed).select("piece_id", "pos", _r("onset", 6).alias("onset"), "pitch", "velocity", _r("duration", 6).alias("duration"))
