"""Queries that run through keyed state on a stream; the batch forms beside them must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.operators import tokens
from notelake.plans import sql as S
from notelake.plans.registry import query
from notelake.sources import bind
from notelake.sources.interim import keep, new_path
from notelake.streaming import state

#: Portions that a stream's source is cut into, and so micro-batches; pieces that follow one another in a lane.
PORTIONS, LANE = 4, 8


def in_portions(rows: DataFrame, along: str, folder: str) -> int:
    """Writes ``rows`` without the column ``along`` to a folder, in portions along it, one portion after another; returns the number of files of a portion.

    A stream takes files by age. Files of one job are as old as their tasks ended, in no
    order, and what comes before its predecessors has to wait in the state store.
    """
    kept, files = keep(rows, "portions"), rows.sparkSession.sparkContext.defaultParallelism
    ends = kept.approxQuantile(along, [k / PORTIONS for k in range(1, PORTIONS)], 0.01)
    portion = sum((F.coalesce(F.col(along) >= end, F.lit(False)).cast("int") for end in ends), F.lit(0))
    for k in range(len(ends) + 1):
        kept.filter(portion == k).drop(along).repartition(files).write.mode("append").parquet(folder)
    return files


@query(
    f"WITH {S.QUADS}, g AS (SELECT piece_id, note_ix, delta_tok, sum(CASE WHEN delta_tok <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY piece_id ORDER BY note_ix ROWS UNBOUNDED PRECEDING) AS grp FROM quads), s AS (SELECT piece_id, CAST(note_ix AS BIGINT) AS note_ix, count(*) FILTER (delta_tok = 0) OVER (PARTITION BY piece_id, grp ORDER BY note_ix ROWS UNBOUNDED PRECEDING) AS streak FROM g) SELECT *, streak >= 3 AS barred FROM s"
)
def zero_streak_stream(spark, sf_dir):
    """Zero steps in a row as keyed state: the notes come in micro-batches by time."""
    q = tokens.quads(bind.notes(spark, sf_dir)).select("piece_id", F.col("note_ix").cast("long").alias("note_ix"), "delta_tok", "onset")
    folder = new_path(spark, "streaks")
    files = in_portions(q, "onset", f"{folder}/in")
    return state.run(spark, f"{folder}/in", "piece_id long, note_ix long, delta_tok int", state.zero_streaks, f"{folder}/out", f"{folder}/checkpoint", files)


@query(
    f"WITH c AS (SELECT vec_id // 64 AS batch, vec_id % 64 AS pos, CASE WHEN vec_id % 5 = 0 THEN 0.5::DOUBLE ELSE round(list_max(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) END AS score FROM embeddings) SELECT batch // {LANE} AS lane, batch, pos, row_number() OVER (PARTITION BY batch ORDER BY pos) AS place FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY batch ORDER BY score DESC, pos) <= 8)"
)
def memory_stream(spark, sf_dir):
    """The bounded memory of the best candidates as keyed state, cleared when a lane comes to its next piece."""
    s = bind.scores(spark, sf_dir).select(
        "vec_id", F.col("batch").cast("long").alias("piece"), F.col("pos").cast("long").alias("pos"),
        F.when(F.col("vec_id") % 5 == 0, 0.5).otherwise(F.round(F.array_max("logits"), 9)).alias("score"), F.floor(F.col("batch") / LANE).cast("long").alias("lane"),
    )
    rows = s.withColumn("seq", F.row_number().over(W.partitionBy("lane").orderBy("vec_id")).cast("long") - 1)
    folder = new_path(spark, "memory")
    files = in_portions(rows.withColumn("at", F.col("seq")).drop("vec_id"), "at", f"{folder}/in")
    shown = state.run(spark, f"{folder}/in", "piece long, pos long, score double, lane long, seq long", state.theme_memory, f"{folder}/out", f"{folder}/checkpoint", files)
    place = F.row_number().over(W.partitionBy("batch").orderBy("pos")).cast("long")
    return state.last_memory(shown).select("lane", F.col("piece").alias("batch"), "pos").withColumn("place", place)
