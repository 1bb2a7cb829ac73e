"""Token streams: quads, prefixes, decoding, windows, targets, padding and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake import spec
from notelake.functions import quantize as Q


def quads(notes: DataFrame) -> DataFrame:
    """A row per note with its four tokens."""
    w = W.partitionBy("piece_id").orderBy("note_ix")
    gap = F.greatest(F.lit(0.0), F.col("onset") - F.coalesce(F.lag("onset").over(w), F.lit(0.0)))
    rows = notes.select("piece_id", "note_ix", "onset", "duration", "pitch", "velocity", gap.alias("gap"))
    return rows.select(
        "piece_id", "note_ix", "onset", "duration", "pitch", "velocity", Q.delta_token(F.col("gap")).alias("delta_tok"), Q.pitch_token(F.col("pitch")).alias("pitch_tok"),
        Q.duration_token(F.col("duration")).alias("dur_tok"), Q.velocity_token(F.col("velocity")).alias("vel_tok"),
    )


def body(notes: DataFrame) -> DataFrame:
    """(piece_id, pos, tok, onset, duration): four rows a note."""
    four = F.posexplode(F.array("delta_tok", "pitch_tok", "dur_tok", "vel_tok")).alias("slot", "tok")
    return quads(notes).select("piece_id", "note_ix", "onset", "duration", four).select("piece_id", (F.col("note_ix") * 4 + F.col("slot")).alias("pos"), "tok", "onset", "duration")


def stream(notes: DataFrame, tags: DataFrame) -> DataFrame:
    """The whole stream of a piece: density, voices, register, BOS, quads, EOS."""
    first = tags.select("piece_id", F.posexplode(F.array("density_tok", "voices_tok", "register_tok", F.lit(spec.BOS))).alias("pos", "tok"))
    first = first.select("piece_id", "pos", "tok", F.lit(0.0).alias("onset"), F.lit(1e-4).alias("duration"))
    middle = body(notes).withColumn("pos", F.col("pos") + 4)
    last = tags.select("piece_id", (F.col("n_notes") * 4 + 4).cast("int").alias("pos"), F.lit(spec.EOS).alias("tok"), F.col("last_onset").alias("onset"), F.lit(1e-4).alias("duration"))
    return first.unionByName(middle).unionByName(last)


def sequences(tokens: DataFrame) -> DataFrame:
    """(piece_id, seq): a piece's tokens as one array, in order."""
    return tokens.groupBy("piece_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda s: s["tok"]).alias("seq"))


def decode(tokens: DataFrame) -> DataFrame:
    """(piece_id, note_ix, onset, duration, pitch, velocity) of clean quad rows."""
    slot = lambda k: F.max(F.when(F.col("pos") % 4 == k, F.col("tok")))
    rows = tokens.groupBy("piece_id", F.floor(F.col("pos") / 4).cast("int").alias("note_ix")).agg(slot(0).alias("d"), slot(1).alias("p"), slot(2).alias("u"), slot(3).alias("v"))
    onset = F.sum(Q.delta_seconds(F.col("d"))).over(W.partitionBy("piece_id").orderBy("note_ix").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("piece_id", "note_ix", onset.alias("onset"), Q.duration_seconds(F.col("u")).alias("duration"), (F.col("p") - 128 + 21).alias("pitch"), Q.velocity_value(F.col("v")).alias("velocity"))


def decode_dirty(seq):
    """Array fold over a stream that may hold stray tokens: a quad out of order costs one token, EOS ends it; structs (d, p, u, v)."""
    kind = lambda t, k: t.between(*spec.RANGES[k])
    kinds = ("delta", "pitch", "duration", "velocity")
    state = F.struct(F.lit(False).alias("done"), F.array().cast("array<int>").alias("part"), F.array().cast("array<struct<d:int,p:int,u:int,v:int>>").alias("out"))

    def push(s, t):
        part, none = s["part"], F.array().cast("array<int>")
        n = F.size(part)
        fits = F.when(n == 0, kind(t, kinds[0])).when(n == 1, kind(t, kinds[1])).when(n == 2, kind(t, kinds[2])).otherwise(kind(t, kinds[3]))
        tail = F.when(fits, F.concat(part, F.array(t))).when(kind(t, kinds[0]), F.array(t)).otherwise(none)
        quad = F.struct(F.get(part, F.lit(0)).alias("d"), F.get(part, F.lit(1)).alias("p"), F.get(part, F.lit(2)).alias("u"), t.alias("v"))
        full = (n == 3) & fits
        moved = F.struct(F.lit(False).alias("done"), F.when(full, none).otherwise(tail).alias("part"), F.when(full, F.concat(s["out"], F.array(quad))).otherwise(s["out"]).alias("out"))
        ended = F.struct(F.lit(True).alias("done"), part.alias("part"), s["out"].alias("out"))
        return F.when(s["done"], s).when(t == spec.EOS, ended).otherwise(moved)

    return F.aggregate(seq, state, push, lambda s: s["out"])


def windows(seqs: DataFrame, seed: int, continuation: int, stride: int) -> DataFrame:
    """(piece_id, start, seed, continuation): sliding windows; none for a piece that is too short."""
    n = seed + continuation
    starts = F.when(F.size("seq") >= n, F.sequence(F.lit(0), F.size("seq") - n, F.lit(stride)))
    return seqs.select("piece_id", "seq", F.explode(starts).alias("start")).select(
        "piece_id", "start", F.slice("seq", F.col("start") + 1, F.lit(seed)).alias("seed"), F.slice("seq", F.col("start") + 1 + seed, F.lit(continuation)).alias("continuation")
    )


def snap_start(start, most, event: int = spec.EVENT):
    """The nearest multiple of the event size that is not over ``most``; ties go down."""
    down = start - start % event
    near = F.when((start % event) * 2 > event, down + event).otherwise(down)
    return F.when(near > most, most - most % event).otherwise(near)


def pad(seqs: DataFrame, batch: str, value) -> DataFrame:
    """Right-pad arrays of a batch to the longest (0 pads tokens by default: an id that also means "no time")."""
    longest = seqs.groupBy(batch).agg(F.max(F.size("seq")).alias("n"))
    return seqs.join(longest, batch).withColumn("seq", F.concat("seq", F.array_repeat(F.lit(value), F.col("n") - F.size("seq")))).drop("n")
