"""Cut planning: chord groups, candidates, scores and the nearest beat."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def chords(notes: DataFrame, tolerance: float) -> DataFrame:
    """(piece_id, note_ix, grp, onset, duration): groups anchored on their first onset.

    A lag can't see the anchor, so sorted rows stream through a fold that holds one
    anchor, not a piece.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, anchor, grp = None, 0.0, -1
        for frame in frames:
            out = []
            for p, onset in zip(frame["piece_id"].tolist(), frame["onset"].tolist(), strict=True):
                if p != piece:
                    piece, anchor, grp = p, onset, 0
                elif abs(onset - anchor) > tolerance:
                    anchor, grp = onset, grp + 1
                out.append(grp)
            yield frame.assign(grp=pd.Series(out, dtype="int32", index=frame.index))

    rows = notes.select("piece_id", "note_ix", "onset", "duration", F.lit(0).alias("grp")).repartition("piece_id").sortWithinPartitions("piece_id", "note_ix")
    return rows.mapInPandas(fold, rows.schema).select("piece_id", "note_ix", "grp", "onset", "duration")


def groups(chorded: DataFrame) -> DataFrame:
    return chorded.groupBy("piece_id", "grp").agg(F.min("onset").alias("onset"), F.max(F.col("onset") + F.col("duration")).alias("end"), F.count(F.lit(1)).alias("n"))


def nearest(points: DataFrame, anchors: DataFrame, name: str) -> DataFrame:
    """points (piece_id, grp, t) with the distance to the piece's nearest anchor (piece_id, t), null where it has none; two as-of probes in one sort."""
    rows = points.select("piece_id", "grp", "t", F.lit(None).cast("double").alias("at")).unionByName(anchors.select("piece_id", F.lit(None).cast("int").alias("grp"), "t", F.col("t").alias("at")))
    w = W.partitionBy("piece_id").orderBy("t")
    back, ahead = F.last("at", True).over(w.rangeBetween(W.unboundedPreceding, 0)), F.first("at", True).over(w.rangeBetween(0, W.unboundedFollowing))
    return rows.select("piece_id", "grp", F.least(F.col("t") - back, ahead - F.col("t")).alias(name)).filter("grp IS NOT NULL")


def distances(points: DataFrame, beats: DataFrame) -> DataFrame:
    """``points`` (piece_id, t, ...) with the distances to the piece's nearest beat and downbeat: four as-of probes in one sort, and no join."""
    marks = beats.select("piece_id", "t", F.col("t").alias("at"), F.when(F.col("beat") % 4 == 0, F.col("t")).alias("down_at"))
    rows = points.withColumn("point", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy("piece_id").orderBy("t")
    near = lambda c: F.least(F.col("t") - F.last(c, True).over(w.rangeBetween(W.unboundedPreceding, 0)), F.first(c, True).over(w.rangeBetween(0, W.unboundedFollowing)) - F.col("t"))
    return rows.select("*", near("at").alias("beat"), near("down_at").alias("downbeat")).filter("point").drop("point", "at", "down_at")


def candidates(g: DataFrame, beats: DataFrame, target: int, least_gap: float) -> DataFrame:
    """A candidate cut after each group: kept notes, next gap, distances and score (lower is better)."""
    w = W.partitionBy("piece_id").orderBy("grp")
    c = g.select("piece_id", "grp", F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("kept"), F.col("end").alias("t"), (F.lead("onset").over(w) - F.col("end")).alias("gap"))
    c = distances(c, beats)
    #: Weights of the score's terms.
    token = F.when(F.col("kept") <= target, (target - F.col("kept")) * 2.0).otherwise((F.col("kept") - target) * 3.0)
    gap = (
        F.when(F.col("gap").isNull(), -0.5).when(F.col("gap") >= least_gap, 0.0)
        .when(F.col("gap") >= 0, (least_gap - F.col("gap")) * 80.0).otherwise((least_gap + F.abs("gap")) * 160.0)
    )
    score = token + gap + F.coalesce("downbeat", F.lit(0.0)) * 8.0 + F.coalesce("beat", F.lit(0.0)) * 1.5
    return c.select("piece_id", "grp", "kept", "t", "gap", "downbeat", "beat", score.alias("score"))


def best(c: DataFrame, target: int) -> DataFrame:
    """The best candidate of each piece that keeps at most ``target`` notes, or of all where none does."""
    fits = F.max((F.col("kept") <= target).cast("int")).over(W.partitionBy("piece_id"))
    c = c.withColumn("fits", fits).filter((F.col("fits") == 0) | (F.col("kept") <= target))
    order = W.partitionBy("piece_id").orderBy("score", F.abs(F.col("kept") - target), F.desc("kept"))
    return c.withColumn("rank", F.row_number().over(order)).filter("rank = 1").drop("rank", "fits")
