"""Manifests: entries, metadata, weights, splits and hash-ordered samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.column import Column

from notelake import spec
from notelake.sources import bind


def manifest(notes: DataFrame) -> DataFrame:
    """(piece_id, source, composer, length, tail_duration, entry_id) of each piece; the tail is the end of the last note, not the latest end."""
    g = notes.groupBy("piece_id").agg((F.count(F.lit(1)) * 4 + 5).alias("length"), F.max_by(F.col("onset") + F.greatest(F.lit(1e-4), F.col("duration")), "note_ix").alias("tail_duration"))
    g = g.select("piece_id", bind.source_of("piece_id").alias("source"), bind.composer_of("piece_id").alias("composer"), "length", "tail_duration")
    path = F.concat(F.lit("midi/"), "source", F.lit("/"), F.col("piece_id").cast("string"), F.lit(".mid"))
    return g.withColumn("entry_id", F.substring(F.sha1(path), 1, 16))


def canonical(name: Column) -> Column:
    """A source's canonical name, through a map of fixed size."""
    key = F.lower(F.trim(name))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in spec.ALIASES.items() for x in pair])[key], key)


def relative_key(path: Column) -> Column:
    """Lower case with forward slashes, without any leading dots and slashes."""
    return F.regexp_replace(F.replace(F.lower(path), F.lit("\\"), F.lit("/")), r"^[./]+", "")


def with_metadata(paths: DataFrame, meta: DataFrame) -> DataFrame:
    """paths (piece_id, path) with the composer of meta (row, rel, composer): by path, else by file name, else "unknown"."""
    by_rel = meta.groupBy("rel").agg(F.max_by("composer", "row").alias("by_rel"))
    by_base = meta.groupBy(F.substring_index("rel", "/", -1).alias("base")).agg(F.min_by("composer", "row").alias("by_base"))
    keyed = paths.select("piece_id", relative_key(F.col("path")).alias("rel")).withColumn("base", F.substring_index("rel", "/", -1))
    return keyed.join(by_rel, "rel", "left").join(by_base, "base", "left").select("piece_id", "rel", F.coalesce("by_rel", "by_base", F.lit("unknown")).alias("composer"))


def sampling_probabilities(entries: DataFrame, profiles: DataFrame) -> DataFrame:
    """(source, pieces, probability): pieces times weight over the total."""
    s = entries.groupBy("source").agg(F.count(F.lit(1)).alias("pieces")).join(F.broadcast(profiles.select("source", "sample_weight")), "source")
    total = s.agg(F.sum(F.col("pieces") * F.col("sample_weight")).alias("total"))
    return s.crossJoin(F.broadcast(total)).select("source", "pieces", (F.col("pieces") * F.col("sample_weight") / F.col("total")).alias("probability"))


def hash_order(key: str, seed: int) -> Column:
    """A random-looking order that both engines can make: MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


#: Leading hex digits of the order column by which a global rank is cut into buckets (4,096 of them).
DIGITS = 3


def global_rank(df: DataFrame, order: str, tie: str) -> DataFrame:
    """Adds ``rank`` (from 1) over the whole table by a hash column, and ``n``, the number of rows.

    No task sorts the whole table: rows are ranked in buckets of the hash's
    first digits, and the buckets' running counts (4,096 rows at most) are broadcast.
    """
    df = df.withColumn("__bucket", F.substring(order, 1, DIGITS))
    counts = df.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__count"))
    every = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select("__bucket", F.coalesce(F.sum("__count").over(every), F.lit(0)).alias("__before"), F.sum("__count").over(W.partitionBy(F.lit(1))).alias("n"))
    own = F.row_number().over(W.partitionBy("__bucket").orderBy(order, tie))
    return df.join(F.broadcast(before), "__bucket").withColumn("rank", F.col("__before") + own).drop("__bucket", "__before")


def split_90_5_5(df: DataFrame) -> DataFrame:
    """Adds ``part`` by rank: 90 % train, 5 % val, the rest test, each with at least one row where there are enough."""
    train, val = F.greatest(F.lit(1), F.floor(0.90 * F.col("n"))), F.greatest(F.lit(1), F.floor(0.05 * F.col("n")))
    short = F.col("n") - train - val <= 0
    train2, val2 = F.when(short & (train > val), train - 1).otherwise(train), F.when(short & (train <= val), val - 1).otherwise(val)
    return df.withColumn("part", F.when(F.col("rank") <= train2, "train").when(F.col("rank") <= train2 + val2, "val").otherwise("test"))


def stratified(entries: DataFrame, stratum: str, key: str, most: int, seed: int) -> DataFrame:
    """``most`` entries, each stratum in proportion (half to even, one at least), then trimmed or topped up in hash order."""
    e = entries.withColumn("__h", hash_order(key, seed))
    sizes = e.groupBy(stratum).agg(F.count(F.lit(1)).alias("__size"))
    total = F.broadcast(sizes.agg(F.sum("__size").alias("__total")))
    quota = F.least(F.greatest(F.lit(1), F.bround(F.col("__size") / F.col("__total") * most, 0)).cast("int"), F.col("__size").cast("int"))
    quotas = sizes.crossJoin(total).select(F.col(stratum).alias("__stratum"), quota.alias("__quota"))
    # no stratum gives more than ``most`` rows, and those are among the first of its parts: a large stratum is cut down before it is sorted
    part = W.partitionBy(stratum, F.substring("__h", 1, DIGITS - 1)).orderBy("__h", key)
    e = e.withColumn("__part", F.row_number().over(part)).filter(F.col("__part") <= most).drop("__part")
    ranked = e.withColumn("__rank", F.row_number().over(W.partitionBy(stratum).orderBy("__h", key)))
    ranked = ranked.join(quotas, F.col(stratum).eqNullSafe(F.col("__stratum"))).drop("__stratum")  # rows without a stratum are one of their own
    chosen = ranked.withColumn("__late", (F.col("__rank") > F.col("__quota")).cast("int"))
    # selected rows first, then leftovers, each in hash order; a top-k of a stated size
    return chosen.orderBy("__late", "__h", key).limit(most).drop("__h", "__rank", "__quota", "__late")


def capped(entries: DataFrame, most: int, *order: str) -> DataFrame:
    """The first ``most`` entries in order; each task keeps so many at most."""
    return entries.orderBy(*order).limit(most)
