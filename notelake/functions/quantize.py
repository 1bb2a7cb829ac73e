"""Bins and their inverses, as column functions (T3: edges are literals, never a closed form)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake import spec


def _doubles(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def bin_of(value: Column, edges: list[float]) -> Column:
    """Index of the bin [edge, next edge) that holds the value; -1 below the first edge.

    width_bucket needs equal bins and a join needs a shuffle. Here a closed form
    guesses the bin of log-spaced edges, and the literal edges around the guess
    decide: five comparisons a row, not one for each edge.
    """
    import math

    n, low, high = len(edges), math.log(edges[0]), math.log(edges[-1])
    guess = clamp(F.floor((F.log(F.greatest(value, F.lit(1e-9))) - low) * ((n - 1) / (high - low))), 1, n - 2).cast("int")
    table = _doubles(edges)
    # the true bin is within one of the guess
    at = lambda k: F.when(F.get(table, guess + k) <= value, 1).otherwise(0)
    inside = guess - 2 + at(-1) + at(0) + at(1)
    return F.when(value < edges[0], -1).when(value >= edges[-1], n - 1).otherwise(inside)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def delta_token(seconds: Column) -> Column:
    """0 for no time; else 1 + the bin of 127 over [1e-4, 8] seconds."""
    positive = clamp(seconds, 1e-4, 8.0)
    return F.when(seconds <= 0, 0).otherwise(1 + clamp(bin_of(positive, spec.DELTA_EDGES), 0, 126)).cast("int")


def duration_token(seconds: Column) -> Column:
    return (216 + clamp(bin_of(clamp(seconds, 1 / 64, 8.0), spec.DURATION_EDGES), 0, 127)).cast("int")


def pitch_token(pitch: Column) -> Column:
    return (128 + clamp(pitch, 21, 108) - 21).cast("int")


def velocity_token(velocity: Column) -> Column:
    return (344 + F.floor(clamp(velocity, 0, 127) / 8)).cast("int")


def delta_seconds(token: Column) -> Column:
    return F.element_at(_doubles(spec.DELTA_CENTRES), clamp(token, 0, 127).cast("int") + 1)


def duration_seconds(token: Column) -> Column:
    return F.element_at(_doubles(spec.DURATION_CENTRES), clamp(token - 216, 0, 127).cast("int") + 1)


def velocity_value(token: Column) -> Column:
    return F.floor((clamp(token - 344, 0, 15) + 0.5) * 8).cast("int")


def tempo_bin(bpm: Column) -> Column:
    """64 bins over 30 to 240 beats a minute, half to even."""
    return F.bround((clamp(bpm, 30.0, 240.0) - 30.0) / 210.0 * 63, 0).cast("int")


def tempo_of(bin_: Column) -> Column:
    return 30.0 + clamp(bin_, 0, 63) / 63.0 * 210.0


def snap(value: Column, grid: Column) -> Column:
    """Nearest multiple of the grid, half to even."""
    return (F.bround(value / grid, 0) * grid).cast("long")


def kind_of(token: Column) -> Column:
    """The kind of a token id."""
    out = F.when(token.isNull(), None)
    for kind, (low, high) in spec.RANGES.items():
        out = out.when(token.between(low, high), kind)
    out = out.when(token == spec.PAD, "pad").when(token == spec.BOS, "bos").when(token == spec.EOS, "eos")
    out = out.when(token.between(363, 366), "density").when(token.between(367, 370), "voices").when(token.between(371, 373), "register")
    return out.otherwise("other")
