"""Per-piece features of a note relation: density, polyphony, register, music statistics, quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake import spec
from notelake.sources.interim import keep

#: Seconds of a block of a sweep.
SWEEP = 16.0


def density(notes: DataFrame) -> DataFrame:
    """(piece_id, density, median_pitch): notes a second of the piece's span."""
    span = F.max(F.col("onset") + F.greatest(F.lit(1e-4), F.col("duration"))) - F.min("onset")
    return notes.groupBy("piece_id").agg((F.count(F.lit(1)) / F.greatest(F.lit(1e-3), span)).alias("density"), F.median("pitch").alias("median_pitch"))


def polyphony(notes: DataFrame) -> DataFrame:
    """(piece_id, mean_voices, peak_voices) by a sweep over 2n bounds; starts go before ends at equal times.

    The sweep goes in blocks of time: a block tells its sum and its highest running
    sum, and what sounds before it is added over the few blocks of a piece, so a piece
    with a large share of all notes is many tasks' work. The notes' lengths are the area
    under the sweep, which gives the mean.
    """
    start = F.greatest(F.lit(0.0), F.col("onset"))
    end = F.greatest(F.col("onset") + F.lit(1e-4), F.col("onset") + F.col("duration"))
    bound = lambda t, d, length: F.struct(t.alias("t"), F.lit(d).alias("d"), length.alias("length"))
    bounds = notes.select("piece_id", "event_id", F.inline(F.array(bound(start, 1, end - start), bound(end, -1, F.lit(0.0))))).withColumn("block", F.floor(F.col("t") / SWEEP))
    w = W.partitionBy("piece_id", "block").orderBy("t", F.desc("d"), "event_id").rowsBetween(W.unboundedPreceding, 0)
    parts = bounds.withColumn("n", F.sum("d").over(w)).groupBy("piece_id", "block").agg(
        F.sum("d").alias("change"), F.max("n").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"), F.sum("length").alias("area")
    )
    before = F.coalesce(F.sum("change").over(W.partitionBy("piece_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    span, peak = F.max("high") - F.min("low"), F.max(F.col("before") + F.col("n"))
    mean = F.when(span > 0, F.sum("area") / span).otherwise(peak)
    return parts.withColumn("before", before).groupBy("piece_id").agg(mean.alias("mean_voices"), F.greatest(F.lit(1), peak).cast("double").alias("peak_voices"))


def quartiles(densities: DataFrame) -> DataFrame:
    """One row (q1, q2, q3), calibrated on eight pieces or more, else the defaults; sorted with gaps of 1e-4 at least.

    Exact, and no task sees all values: equal ones are counted first, and ranks are
    running counts within logarithmic buckets after a running count over the buckets
    (65,536 at most, by the range of a double), which are broadcast.
    """
    v = densities.filter("density > 0").groupBy("density").agg(F.count(F.lit(1)).alias("c")).withColumn("bucket", F.floor(F.log2("density") * 32))
    sizes = v.groupBy("bucket").agg(F.sum("c").alias("size"))
    every = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("size").over(every), F.lit(0)).alias("start"), F.sum("size").over(W.partitionBy(F.lit(1))).alias("n"))
    end = F.col("start") + F.sum("c").over(W.partitionBy("bucket").orderBy("density").rowsBetween(W.unboundedPreceding, 0))
    v = v.join(F.broadcast(starts), "bucket").select("density", "n", (end - F.col("c")).alias("first"), end.alias("end"))
    at = lambda place: F.max(F.when((F.col("first") <= place) & (place < F.col("end")), F.col("density")))
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    found = [x for k, p in enumerate((0.25, 0.5, 0.75)) for x in (at(F.floor(place(p))).alias(f"low{k}"), at(F.ceil(place(p))).alias(f"high{k}"))]
    q = v.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *found)
    part = lambda p: place(p) - F.floor(place(p))
    exact = lambda k, p: F.col(f"low{k}") * (1 - part(p)) + F.col(f"high{k}") * part(p)
    known = lambda k, p: F.when(F.col("n") >= 8, exact(k, p)).otherwise(F.lit(spec.DEFAULT_QUARTILES[k]))
    q = q.select(F.greatest(F.lit(1e-4), known(0, 0.25)).alias("q1"), known(1, 0.5).alias("a2"), known(2, 0.75).alias("a3"))
    q = q.select("q1", F.greatest("a2", F.col("q1") + F.lit(1e-4)).alias("q2"), "a3")
    return q.select("q1", "q2", F.greatest("a3", F.col("q2") + F.lit(1e-4)).alias("q3"))


def base(notes: DataFrame) -> DataFrame:
    """A row per piece (n_notes, last_onset, density, median_pitch, mean_voices, peak_voices) from one sweep: one scan, one shuffle."""
    start = F.greatest(F.lit(0.0), F.col("onset"))
    end = F.greatest(F.col("onset") + F.lit(1e-4), F.col("onset") + F.col("duration"))
    bounds = notes.select("piece_id", "event_id", "pitch", F.inline(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))))
    w = W.partitionBy("piece_id").orderBy("t", F.desc("d"), "event_id")
    active = bounds.select("piece_id", "t", "d", "pitch", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("n"), (F.lead("t").over(w) - F.col("t")).alias("span"))
    on = lambda c: F.when(F.col("d") == 1, F.col(c))
    mean = F.when(F.sum("span") > 0, F.sum(F.col("n") * F.col("span")) / F.sum("span")).otherwise(F.max("n"))
    length = F.max(F.when(F.col("d") == -1, F.col("t"))) - F.min(on("t"))
    return active.groupBy("piece_id").agg(
        F.count(on("t")).alias("n_notes"), F.max(on("t")).alias("last_onset"), (F.count(on("t")) / F.greatest(F.lit(1e-3), length)).alias("density"), F.median(on("pitch")).alias("median_pitch"),
        mean.alias("mean_voices"), F.greatest(F.lit(1), F.max("n")).cast("double").alias("peak_voices"),
    )


def tags(notes: DataFrame) -> DataFrame:
    """(piece_id, density_tok, voices_tok, register_tok, n_notes, last_onset).

    The row per piece is written once, as the quartiles and the tags both read
    it; the one-row table of quartiles is broadcast.
    """
    rows = keep(base(notes), "pieces")
    rows = rows.crossJoin(F.broadcast(quartiles(rows)))
    mean, peak = F.greatest(F.lit(1.0), F.col("mean_voices")), F.col("peak_voices")
    d = F.when(F.col("density") <= F.col("q1"), 0).when(F.col("density") <= F.col("q2"), 1).when(F.col("density") <= F.col("q3"), 2).otherwise(3)
    v = F.when((peak <= 1.05) & (mean < 1.2), 0).when((mean < 2) & (peak <= 3), 1).when((mean < 3.5) & (peak <= 6), 2).otherwise(3)
    r = F.when(F.col("median_pitch") < 48, 0).when(F.col("median_pitch") <= 72, 1).otherwise(2)
    return rows.select("piece_id", (spec.DENSITY + d).alias("density_tok"), (spec.VOICES + v).alias("voices_tok"), (spec.REGISTER + r).alias("register_tok"), "n_notes", "last_onset")


def pitch_classes(notes: DataFrame) -> DataFrame:
    """(piece_id, pitch_class, share): twelve rows a piece, in one aggregation."""
    counts = [F.count(F.when(F.col("pitch") % 12 == c, 1)).alias(f"c{c}") for c in range(12)]
    wide = notes.groupBy("piece_id").agg(*counts, F.count(F.lit(1)).alias("n"))
    return wide.select("piece_id", "n", F.posexplode(F.array(*[f"c{c}" for c in range(12)])).alias("pitch_class", "count")).select("piece_id", "pitch_class", (F.col("count") / F.col("n")).alias("share"))


def entropy(classes: DataFrame) -> DataFrame:
    bits = F.when(F.col("share") > 0, -F.col("share") * F.log2("share")).otherwise(0.0)
    return classes.groupBy("piece_id").agg(F.sum(bits).alias("entropy"))


def regularity(notes: DataFrame) -> DataFrame:
    """(piece_id, regularity): population deviation over mean of the onset gaps above 1e-4; 0 for fewer than three notes."""
    w = W.partitionBy("piece_id").orderBy("onset", "note_ix")
    gaps = notes.select("piece_id", (F.col("onset") - F.lag("onset").over(w)).alias("gap"))
    used = F.when(F.col("gap") > 1e-4, F.col("gap"))
    value = F.when((F.count(F.lit(1)) >= 3) & (F.avg(used) > 1e-8), F.stddev_pop(used) / F.avg(used)).otherwise(0.0)
    return gaps.groupBy("piece_id").agg(value.alias("regularity"))


def statistics(notes: DataFrame) -> DataFrame:
    """(piece_id, n_notes, note_density, mean_velocity, regularity, entropy, classes): one scan and one shuffle."""
    gap = F.col("onset") - F.lag("onset").over(W.partitionBy("piece_id").orderBy("onset", "note_ix"))
    rows = notes.select("piece_id", "onset", "duration", "velocity", "pitch", F.when(gap > 1e-4, gap).alias("used"))
    one = rows.groupBy("piece_id").agg(
        F.count(F.lit(1)).alias("n_notes"), F.max(F.col("onset") + F.col("duration")).alias("end"), F.avg("velocity").alias("mean_velocity"), F.avg("used").alias("mean_gap"), F.stddev_pop("used").alias("gap_std"),
        *[F.count(F.when(F.col("pitch") % 12 == c, 1)).alias(f"c{c}") for c in range(12)],
    )
    one = one.select("*", F.array(*[F.col(f"c{c}") / F.col("n_notes") for c in range(12)]).alias("classes"))
    bits = F.aggregate("classes", F.lit(0.0), lambda s, x: s + F.when(x > 0, -x * F.log2(x)).otherwise(0.0))
    regular = F.when((F.col("n_notes") >= 3) & (F.col("mean_gap") > 1e-8), F.col("gap_std") / F.col("mean_gap")).otherwise(0.0)
    return one.select(
        "piece_id", "n_notes", F.when(F.col("end") > 0, F.col("n_notes") / F.col("end")).otherwise(0.0).alias("note_density"), "mean_velocity", regular.alias("regularity"), bits.alias("entropy"), "classes"
    )


def cosine(a, b):
    """Cosine of two arrays; 0 where a norm is below 1e-8."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < 1e-8) | (nb < 1e-8), 0.0).otherwise(dot(a, b) / (na * nb))


def quality(tracks: DataFrame, profiles: DataFrame) -> DataFrame:
    """(piece_id, source, keep, reason): the first rule that a piece breaks, in the order of the rules."""
    melodic = ~F.col("is_drum")
    g = tracks.groupBy("piece_id", "source").agg(
        F.max(F.col("onset") + F.col("duration")).alias("seconds"), F.count(F.when(melodic, 1)).alias("n_notes"), F.countDistinct(F.when(melodic, F.col("pitch"))).alias("n_pitches"),
        F.coalesce(F.stddev_pop(F.when(melodic, F.col("velocity"))), F.lit(0.0)).alias("velocity_std"), F.count(F.when(melodic & F.col("program").isin(0, 1), 1)).alias("n_piano"),
    )
    g = g.join(F.broadcast(profiles), "source")
    share = F.when(F.col("n_notes") > 0, F.col("n_piano") / F.col("n_notes")).otherwise(0.0)
    reason = (
        F.when(F.col("seconds") < F.col("min_seconds"), "too_short_seconds").when(share < F.col("dominance"), "not_piano_dominant")
        .when(F.col("n_notes") < F.col("min_notes"), "too_few_notes").when(F.col("n_pitches") < F.col("min_pitches"), "too_few_distinct_pitches")
        .when(F.col("filter_velocity") & (F.col("velocity_std") < 5.0), "uniform_velocity").otherwise("ok")
    )
    return g.select("piece_id", "source", "seconds", "velocity_std", (reason == "ok").alias("keep"), reason.alias("reason"))
