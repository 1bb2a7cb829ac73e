"""Tempo maps: a piece's seconds as ticks and back, piecewise linear between its tempo changes.

A map is a table of segments (piece_id, segment, seconds, tick, bpm, rate): from its
start at ``seconds`` and ``tick`` on a segment has ``rate`` ticks a second, until the
next one. Look-ups are as-of joins made by a running last value in two levels
(:mod:`notelake.operators.scan`), so a piece that holds a large share of all rows is
spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.column import Column

from notelake.operators import remi, scan
from notelake.sources.interim import keep

#: Ticks of a beat, and the tempo before the first change.
BEAT, DEFAULT = 220, 120.0
#: Seconds and ticks that one block of a look-up spans.
BLOCK_SECONDS, BLOCK_TICKS = 8.0, 4 * remi.BAR_TICKS


def segments(changes: DataFrame, pieces: DataFrame) -> DataFrame:
    """The map of the tempo changes (piece_id, seconds, bpm) of ``pieces`` (piece_id): of several at one time the highest counts, and before the first the default does."""
    first = pieces.select("piece_id").distinct().select("piece_id", F.lit(0.0).alias("seconds"), F.lit(None).cast("double").alias("bpm"))
    some = changes.select("piece_id", F.greatest(F.lit(0.0), "seconds").alias("seconds"), F.col("bpm").cast("double").alias("bpm")).unionByName(first)
    one = some.groupBy("piece_id", "seconds").agg(F.coalesce(F.max("bpm"), F.lit(DEFAULT)).alias("bpm"))
    by = W.partitionBy("piece_id").orderBy("seconds")
    rate = F.col("bpm") * BEAT / 60
    span = (F.col("seconds") - F.lag("seconds").over(by)) * F.lag("rate").over(by)
    rows = one.withColumn("rate", rate).withColumn("span", F.coalesce(span, F.lit(0.0)))
    return rows.select("piece_id", (F.row_number().over(by) - 1).alias("segment"), "seconds", F.sum("span").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("tick"), "bpm", "rate")


def _as_of(rows: DataFrame, at: str, starts: DataFrame, start: str, width: float) -> DataFrame:
    """``rows`` with the struct ``of``: the last segment of its piece that starts at or before ``at``."""
    row = F.lit(None).cast(rows.schema.simpleString())
    own = starts.select("piece_id", F.col(start).cast("double").alias("__at"), F.lit(0).alias("__side"), F.struct("seconds", "tick", "rate").alias("__segment"), row.alias("__row"))
    theirs = rows.select("piece_id", F.greatest(F.col(at).cast("double"), F.lit(0.0)).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast("struct<seconds:double,tick:double,rate:double>").alias("__segment"), F.struct(*rows.columns).alias("__row"))
    both = keep(own.unionByName(theirs), "as-of")
    block = F.floor(F.col("__at") / width)
    found = scan.running(both, "piece_id", block, ["__at", "__side"], of=("last", F.col("__segment")))
    return found.filter("__side = 1").select("__row.*", "of")


def to_ticks(rows: DataFrame, at: str, map_: DataFrame, name: str = "tick") -> DataFrame:
    """``rows`` (with piece_id) and the whole tick, half to even, of their seconds in column ``at``; times before zero count as zero."""
    found = _as_of(rows, at, map_, "seconds", BLOCK_SECONDS)
    tick = F.col("of.tick") + (F.greatest(F.lit(0.0), at) - F.col("of.seconds")) * F.col("of.rate")
    return found.select(*rows.columns, F.bround(tick, 0).cast("long").alias(name))


def to_seconds(rows: DataFrame, at: str, map_: DataFrame, name: str = "seconds") -> DataFrame:
    """``rows`` (with piece_id) and the seconds of the ticks in column ``at``."""
    found = _as_of(rows, at, map_, "tick", float(BLOCK_TICKS))
    return found.select(*rows.columns, (F.col("of.seconds") + (F.col(at) - F.col("of.tick")) / F.col("of.rate")).alias(name))


def _snapped(tick: Column) -> Column:
    return (F.bround(tick / remi.GRID, 0) * remi.GRID).cast("long")


def tempo_bin(bpm: Column) -> Column:
    """64 bins over 30 to 240 beats a minute, half to even."""
    return F.bround((F.least(F.greatest(bpm, F.lit(30.0)), F.lit(240.0)) - 30.0) / 210.0 * 63, 0).cast("int")


def events(notes: DataFrame, pedals: DataFrame, map_: DataFrame) -> DataFrame:
    """Merged events (piece_id, tick, ord, a, b, c) of notes (piece_id, onset, duration, pitch, velocity), pedal moves (piece_id, seconds, down) and the tempo changes of the map, for :func:`remi.encode`.

    A duration counts in grid steps as long as the piece's first one.
    """
    grid = to_seconds(map_.filter("segment = 0").select("piece_id", F.lit(remi.GRID).cast("long").alias("at")), "at", map_, "step").select("piece_id", "step")
    ticks = to_ticks(notes.select("piece_id", "onset", "duration", "pitch", "velocity"), "onset", map_)
    units = F.least(F.greatest(F.bround(F.greatest(F.lit(1e-4), F.col("duration")) / F.col("step"), 0), F.lit(1)), F.lit(remi.MOST)).cast("int")
    note = ticks.join(grid, "piece_id").select("piece_id", _snapped(F.col("tick")).alias("tick"), F.lit(20).alias("ord"), F.col("pitch").alias("a"), F.floor(F.col("velocity") * 32 / 128).cast("int").alias("b"), units.alias("c"))
    none = F.lit(0)
    pedal = to_ticks(pedals.select("piece_id", "seconds", "down"), "seconds", map_)
    pedal = pedal.select("piece_id", _snapped(F.col("tick")).alias("tick"), F.lit(30).alias("ord"), F.col("down").cast("int").alias("a"), none.alias("b"), none.alias("c"))
    tempo = map_.select("piece_id", _snapped(F.bround("tick", 0)).alias("tick"), F.lit(10).alias("ord"), tempo_bin(F.col("bpm")).alias("a"), none.alias("b"), none.alias("c"))
    return note.unionByName(pedal).unionByName(tempo)


def token_times(timed: DataFrame, map_: DataFrame) -> DataFrame:
    """(piece_id, pos, tok, onset, duration) in seconds of tokens with ticks and units (:func:`remi.encode` with ``times``)."""
    starts = to_seconds(timed, "tick", map_, "onset")
    ends = to_seconds(starts.withColumn("end", F.col("tick") + F.col("units") * remi.GRID), "end", map_, "fin")
    return ends.select("piece_id", "pos", "tok", "onset", F.greatest(F.lit(1e-4), F.col("fin") - F.col("onset")).alias("duration"))


def decode(tokens: DataFrame) -> DataFrame:
    """(piece_id, pos, onset, pitch, velocity, duration) of token rows, in the seconds of the tempi that stand among the tokens."""
    t = F.col("tok")
    placed = scan.running(
        keep(tokens.select("piece_id", "pos", "tok"), "tokens"), "piece_id", F.floor(F.col("pos") / 4096), ["pos"],
        bars=("sum", (t == remi.BAR).cast("int")), position=("last", F.when(t.between(remi.POSITION, remi.NOTE_ON - 1), t - remi.POSITION)),
        pitch=("last", F.when(t.between(remi.NOTE_ON, remi.VELOCITY - 1), t - remi.NOTE_ON)), bin=("last", F.when(t.between(remi.VELOCITY, remi.DURATION - 1), t - remi.VELOCITY)),
    )
    tick = F.greatest(F.lit(0), F.col("bars") - 1) * remi.BAR_TICKS + F.col("position") * remi.GRID
    placed = keep(placed.withColumn("tick", tick.cast("long")).filter(t.between(remi.DURATION, remi.TIME_SHIFT - 1) | t.between(remi.TEMPO, remi.PEDAL_ON - 1)), "placed")
    tempo = placed.filter(t >= remi.TEMPO).groupBy("piece_id", "tick").agg(F.max_by(t - remi.TEMPO, "pos").alias("bin"))
    by = W.partitionBy("piece_id").orderBy("tick")
    rate = (30.0 + F.col("bin") / 63.0 * 210.0) * BEAT / 60
    span = (F.col("tick") - F.lag("tick").over(by)) / F.lag("rate").over(by)
    map_ = tempo.withColumn("rate", rate).withColumn("span", F.coalesce(span, F.lit(0.0)))
    map_ = keep(map_.select("piece_id", (F.row_number().over(by) - 1).alias("segment"), F.sum("span").over(by.rowsBetween(W.unboundedPreceding, 0)).alias("seconds"), F.col("tick").cast("double").alias("tick"), "rate"), "tempi")
    grid = to_seconds(map_.filter("segment = 0").select("piece_id", F.lit(remi.GRID).cast("long").alias("at")), "at", map_, "step").select("piece_id", "step")
    notes = to_seconds(placed.filter(t < remi.TIME_SHIFT).select("piece_id", "pos", "tok", "tick", "pitch", "bin"), "tick", map_, "onset")
    return notes.join(grid, "piece_id").select("piece_id", "pos", "onset", "pitch", (F.col("bin") * 4 + 2).alias("velocity"), ((t - remi.DURATION + 1) * F.col("step")).alias("duration"))
