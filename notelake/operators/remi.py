"""Bar and position tokens: the base vocabulary, encoding and decoding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.column import Column

#: 440 ticks a second, 880 a bar, 16 positions of 55 ticks; spans of 4 bars at most.
TICKS, BAR_TICKS, GRID, POSITIONS, MOST = 440, 880, 55, 16, 64
#: First ids of the families of the base vocabulary.
BOS, EOS, BAR, POSITION, NOTE_ON, VELOCITY, DURATION, TIME_SHIFT, TEMPO, PEDAL_ON, PEDAL_OFF = 1, 2, 3, 4, 20, 148, 180, 244, 308, 372, 373
SIZE = 374


def tick(seconds: Column) -> Column:
    return (F.bround(F.bround(F.greatest(F.lit(0.0), seconds) * TICKS, 0) / GRID, 0) * GRID).cast("long")


def events(notes: DataFrame) -> DataFrame:
    """(piece_id, tick, ord, a, b, c): notes of melodic tracks; drum hits stand for the pedal; one tempo a piece."""
    units = F.least(F.greatest(F.bround(F.greatest(F.lit(1e-4), F.col("duration")) * TICKS / GRID, 0), F.lit(1)), F.lit(MOST)).cast("int")
    note = notes.filter(~F.col("is_drum")).select("piece_id", tick(F.col("onset")).alias("tick"), F.lit(20).alias("ord"), F.col("pitch").alias("a"), F.floor(F.col("velocity") * 32 / 128).cast("int").alias("b"), units.alias("c"))
    pedal = notes.filter("is_drum").select("piece_id", tick(F.col("onset")).alias("tick"), F.lit(30).alias("ord"), (F.col("velocity") >= 64).cast("int").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    tempo = notes.select("piece_id").distinct().select("piece_id", F.lit(0).cast("long").alias("tick"), F.lit(10).alias("ord"), F.lit(27).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"))
    return note.unionByName(pedal).unionByName(tempo)


def encode(ev: DataFrame, times: bool = False) -> DataFrame:
    """(piece_id, pos, tok) between BOS and EOS; each event emits the bars, shifts and position it needs, then itself. With ``times`` also the tick and the grid steps of each token."""
    order = W.partitionBy("piece_id").orderBy("tick", "ord", "a", "b", "c")
    bar = F.floor(F.col("tick") / BAR_TICKS).cast("int")
    e = ev.select("*", F.row_number().over(order).alias("n"), bar.alias("bar"))
    own = W.partitionBy("piece_id").orderBy("n")
    e = e.select("*", (F.col("bar") - F.coalesce(F.lag("bar").over(own), F.lit(-1))).alias("bars"), ((F.col("tick") - F.coalesce(F.lag("tick").over(own), F.lit(0))) / GRID).cast("int").alias("gap"))
    long = F.greatest(F.lit(0), F.ceil((F.col("gap") - MOST) / MOST)).cast("int")
    rest = F.col("gap") - long * MOST
    where = POSITION + F.floor((F.col("tick") - F.col("bar") * BAR_TICKS) / GRID).cast("int")
    none = F.array().cast("array<int>")
    payload = (
        F.when(F.col("ord") == 10, F.array(TEMPO + F.col("a"))).when(F.col("ord") == 30, F.array(F.when(F.col("a") == 1, PEDAL_ON).otherwise(PEDAL_OFF)))
        .otherwise(F.array(NOTE_ON + F.col("a"), VELOCITY + F.col("b"), DURATION - 1 + F.col("c")))
    )
    parts = F.flatten(F.array(F.array_repeat(F.lit(BAR), F.col("bars")), F.array_repeat(F.lit(TIME_SHIFT - 1 + MOST), long), F.when(rest > 0, F.array(TIME_SHIFT - 1 + rest)).otherwise(none), F.array(where), payload))
    if times:
        return _timed(e, long, rest, parts)
    rows = e.select("piece_id", "n", F.posexplode(parts).alias("k", "tok"))
    ends = ev.groupBy("piece_id").agg(F.count(F.lit(1)).alias("m"))
    bos = ends.select("piece_id", F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(BOS).alias("tok"))
    eos = ends.select("piece_id", (F.col("m") + 1).cast("int").alias("n"), F.lit(0).alias("k"), F.lit(EOS).alias("tok"))
    whole = rows.unionByName(bos).unionByName(eos)
    return whole.select("piece_id", (F.row_number().over(W.partitionBy("piece_id").orderBy("n", "k")) - 1).alias("pos"), F.col("tok").cast("int").alias("tok"))


def _timed(e: DataFrame, long: Column, rest: Column, parts: Column) -> DataFrame:
    """(piece_id, pos, tok, tick, units): bars start at their own ticks, shifts where the last event was, the rest with the event; a note's tokens last as long as it does."""
    since, before = F.col("tick") - F.col("gap") * GRID, F.col("bar") - F.col("bars")
    rows = e.select("piece_id", "n", "tick", "ord", "c", "bars", long.alias("long"), rest.alias("rest"), since.alias("since"), before.alias("before"), F.posexplode(parts).alias("k", "tok"))
    k, shift = F.col("k"), F.col("k") - F.col("bars")
    at = F.when(F.col("tok") == BAR, (F.col("before") + 1 + k) * BAR_TICKS).when(F.col("tok").between(TIME_SHIFT, TEMPO - 1), F.col("since") + shift * MOST * GRID).otherwise(F.col("tick"))
    units = F.when(F.col("tok").between(TIME_SHIFT, TEMPO - 1), F.col("tok") - TIME_SHIFT + 1).when((F.col("ord") == 20) & F.col("tok").between(NOTE_ON, TIME_SHIFT - 1), F.col("c")).otherwise(1)
    rows = rows.select("piece_id", "n", "k", "tok", at.cast("long").alias("tick"), units.cast("int").alias("units"))
    ends = e.groupBy("piece_id").agg((F.max("n") + 1).alias("n"), F.max("tick").alias("tick"))
    bos = ends.select("piece_id", F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(BOS).alias("tok"), F.lit(0).cast("long").alias("tick"), F.lit(1).alias("units"))
    eos = ends.select("piece_id", "n", F.lit(0).alias("k"), F.lit(EOS).alias("tok"), "tick", F.lit(1).alias("units"))
    whole = rows.unionByName(bos).unionByName(eos)
    return whole.select("piece_id", (F.row_number().over(W.partitionBy("piece_id").orderBy("n", "k")) - 1).alias("pos"), F.col("tok").cast("int").alias("tok"), "tick", "units")


def decode(tokens: DataFrame) -> DataFrame:
    """(piece_id, pos, onset, pitch, velocity, duration): a note at each duration token; the tempo is ignored, a position is an eighth of a second."""
    w = W.partitionBy("piece_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    t = F.col("tok")
    of = lambda low, high: F.last(F.when(t.between(low, high), t - low), True).over(w)
    rows = tokens.select(
        "piece_id", "pos", "tok", (F.sum((t == BAR).cast("int")).over(w) - 1).alias("bar"), of(POSITION, NOTE_ON - 1).alias("position"), of(NOTE_ON, VELOCITY - 1).alias("pitch"), of(VELOCITY, DURATION - 1).alias("bin")
    )
    onset = F.greatest(F.lit(0), F.col("bar")) * 2.0 + F.col("position") * 0.125
    return rows.filter(t.between(DURATION, TIME_SHIFT - 1)).select("piece_id", "pos", onset.alias("onset"), "pitch", (F.col("bin") * 4 + 2).alias("velocity"), ((t - DURATION + 1) * 0.125).alias("duration"))
