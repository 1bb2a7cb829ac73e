"""Views of the event, document and embedding tables as note relations, manifests and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.column import Column

from notelake import spec


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: Column | str) -> Column:
    """Microseconds of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def source_of(piece: str) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ("aria_midi", "maestro", "giant_midi", "adl_piano")]), (F.col(piece) % 4 + 1).cast("int"))


def composer_of(piece: str) -> Column:
    """Blank for every eleventh piece, so that defaults have work to do."""
    return F.when(F.col(piece) % 11 == 0, "").otherwise(F.concat(F.lit("composer_"), (F.col(piece) % 7).cast("string")))


def notes_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every note of a piece (an event's user), in time order; one shuffle by piece."""
    events = table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("piece_id"), micros("ts").alias("us"), "value", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    piece = W.partitionBy("piece_id")
    rows = events.select(
        "piece_id", "event_id",
        ((F.col("us") - F.min("us").over(piece)).cast("double") / F.lit(6.0e10)).alias("onset"),
        F.greatest(F.lit(1e-4), F.col("value") / 100).alias("duration"),
        (F.col("k") + 21).alias("pitch"), (F.col("event_id") * 37 % 128).cast("int").alias("velocity"),
        F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", 4).otherwise(40).alias("program"),
        (F.col("event_type") == "error").alias("is_drum"),
    )
    order = piece.orderBy("onset", "pitch", "duration", "velocity", "event_id")
    return rows.withColumn("note_ix", F.row_number().over(order) - 1)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes that a tokenizer takes: pitches 21 to 108, indexed anew."""
    kept = notes_all(spark, sf_dir).filter(F.col("pitch").between(spec.LOW_PITCH, spec.HIGH_PITCH))
    return kept.withColumn("note_ix", F.row_number().over(W.partitionBy("piece_id").orderBy("note_ix")) - 1)


def tempo_changes(notes_: DataFrame) -> DataFrame:
    """(piece_id, seconds, bpm): the notes of program 4 stand for tempo changes, 60 to 179 beats a minute."""
    return notes_.filter("program = 4").select("piece_id", F.col("onset").alias("seconds"), (60 + F.col("event_id") * 13 % 120).cast("double").alias("bpm"))


def pedal_moves(notes_: DataFrame) -> DataFrame:
    """(piece_id, seconds, down): drum hits stand for the pedal."""
    return notes_.filter("is_drum").select("piece_id", F.col("onset").alias("seconds"), (F.col("velocity") >= 64).alias("down"))


def profiles(spark: SparkSession) -> DataFrame:
    """The four source profiles (a table of fixed size)."""
    return spark.createDataFrame([(k, *v) for k, v in spec.PROFILES.items()], "source string, sample_weight double, raw_share double, min_seconds double, filter_velocity boolean, min_notes int, min_pitches int, dominance double")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the members of an archive: index, path, length."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("index"), F.concat_ws("/", "source", "lang", F.format_string("%07d.mid", "doc_id")).alias("path"), F.col("n_chars").alias("length"), "source", "lang")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as logits of 64 classes: vec_id, batch, pos, logits, target."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", F.floor(F.col("vec_id") / 64).cast("int").alias("batch"), (F.col("vec_id") % 64).cast("int").alias("pos"),
        F.transform("embedding", lambda x: x.cast("double")).alias("logits"), F.col("label").alias("target"),
    )
