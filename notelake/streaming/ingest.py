"""Incremental ingest with Structured Streaming: a resumable manifest and a ledger of chunks.

The file source with ``availableNow`` stands for the resumable scan: the
checkpoint remembers which files are done, a restart takes only new ones, and an
output written twice by a retried batch is overwritten by its batch id. Indexes are
written once, whichever files bring them: those seen are keyed state of the stream,
so a micro-batch costs its own rows and never reads the manifest (:func:`pending` and
:func:`first_accepted` are the same for batch jobs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StructType

from notelake.functions import clean
from notelake.sources.interim import new_path
from notelake.streaming.state import rocks


def ingest(spark: SparkSession, folder: str, names: str, schema: StructType, manifest: str, ledger: str, checkpoint: str, files_per_batch: int = 4) -> None:
    """Read document files of a folder (by a glob of names) that are new since the last call; append manifest rows and one ledger row per micro-batch."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(folder)
    rows = source.select(
        F.col("doc_id").alias("index"), F.when(F.col("n_chars") >= 200, "accepted").otherwise("short").alias("status"),
        clean.shard_path(F.col("doc_id"), F.concat_ws("/", "source", "lang"), 250).alias("pack"), F.col("n_chars").alias("length"),
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is retried overwrites its own folder
        batch.write.mode("overwrite").parquet(f"{manifest}/batch={batch_id}")
        done = batch.sparkSession.read.parquet(f"{manifest}/batch={batch_id}")
        sums = done.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "accepted").alias("accepted"), F.min("index").alias("start_index"), F.max("index").alias("end_index"))
        sums.write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    with rocks(spark):
        query = rows.dropDuplicates(["index"]).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def stream_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of the document table, ingested as a stream."""
    folder = new_path(spark, "ingest")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one_file = table.inputFiles()[:1] and table.inputFiles()[0].endswith("/documents.parquet")
    where = (sf_dir, "documents.parquet") if one_file else (f"{sf_dir}/documents.parquet", "*.parquet")
    ingest(spark, *where, table.schema, f"{folder}/manifest", f"{folder}/ledger", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/manifest").select("index", "status", "pack", "length")


def pending(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose index isn't done yet, one for each index."""
    return rows.dropDuplicates(["index"]).join(done.select("index"), "index", "left_anti")


def first_accepted(rows: DataFrame, most: int, chunk: int = 100_000) -> DataFrame:
    """Rows (index, accepted, ...) in index order up to the one that brings the number accepted to ``most``; all of them if it isn't reached.

    Chunks of indexes are counted first; only the chunk in which the number is
    reached is ranked, so no task sorts the whole table.
    """
    rows = rows.withColumn("__chunk", F.floor(F.col("index") / chunk))
    counts = rows.groupBy("__chunk").agg(F.count_if("accepted").alias("__n"))
    before = counts.select("__chunk", "__n", F.coalesce(F.sum("__n").over(W.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rows = rows.join(before.filter(F.col("__before") < most), "__chunk")
    own = F.coalesce(F.sum(F.col("accepted").cast("int")).over(W.partitionBy("__chunk").orderBy("index").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole, last = rows.filter(F.col("__before") + F.col("__n") < most), rows.filter(F.col("__before") + F.col("__n") >= most)
    last = last.withColumn("__at", F.col("__before") + own).filter(F.col("__at") < most).drop("__at")
    return whole.unionByName(last).drop("__chunk", "__n", "__before")


def running_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """An extension (the source pipeline has no event-time windows): counts and sums of a stream by window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
