"""Tolerant casts, paths and times, as column functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def _text(c: Column | str) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c)


def to_int(c: Column | str, fallback: int) -> Column:
    """Whole numbers only: "3.9" does not parse, as in a strict reader."""
    t = _text(c)
    return F.coalesce(F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int")), F.lit(fallback))


def to_double(c: Column | str, fallback: float) -> Column:
    """Decimal numbers, with an exponent or without; infinities and what is no number take the fallback."""
    t = _text(c)
    return F.coalesce(F.when(t.rlike(r"(?i)^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$"), t.try_cast("double")), F.lit(fallback))


def to_bool(c: Column | str) -> Column:
    t = F.lower(_text(c))
    return F.when(t.isin("1", "true", "yes", "on"), True).when(t.isin("0", "false", "no", "off"), False)


def shard_path(index: Column, path: Column, shard: int) -> Column:
    """data/SSSSS/NNNNNNN_md5.npz of a member."""
    return F.format_string("data/%05d/%07d_%s.npz", F.floor(index / shard), index, F.md5(path))


def eta(seconds: Column) -> Column:
    """HH:MM:SS; unknown where null, negative or infinite."""
    whole = F.floor(seconds)
    text = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.when(seconds.isNull() | (seconds < 0) | (seconds == float("inf")), "unknown").otherwise(text)
