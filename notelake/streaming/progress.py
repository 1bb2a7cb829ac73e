"""Progress of a stream as a table: a row for each micro-batch, with rate, backlog and time left.

A listener of the session gets a report after each micro-batch that had rows and
writes it as a file of its own, named by query and batch, so a batch that is run
again after a restart replaces its row. Sums over batches are made when the table is
read: a listener that starts anew knows nothing of earlier runs.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQueryListener

REPORT = "query string, batch long, rows long, seconds double, rate double, total long, at string"


class Reports(StreamingQueryListener):
    """Writes a report a micro-batch below ``folder``; ``total`` is the number of rows that the source will have had, if known."""

    def __init__(self, spark: SparkSession, folder: str, total: int | None):
        self.spark, self.folder, self.total, self.ended = spark, folder, total, threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.ended.clear()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if not p.numInputRows:
            return
        seconds = p.durationMs.get("triggerExecution", 0) / 1000
        self._write(p.id, p.batchId, {"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "seconds": seconds, "rate": p.numInputRows / max(seconds, 0.001), "total": self.total, "at": p.timestamp})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.set()

    def _write(self, query, batch: int, report: dict) -> None:
        """A small file in whichever store the folder is in."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{query}-{batch}.json")
        out = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(path, True)
        try:
            out.write(bytearray(json.dumps(report).encode()))
        finally:
            out.close()


@contextmanager
def reported(spark: SparkSession, folder: str, total: int | None = None, patience: float = 30.0) -> Iterator[Reports]:
    """Reports of the streams that run inside; on leaving waits for the last one (reports come a little after their batch)."""
    listener = Reports(spark, folder, total)
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.ended.wait(patience)
    finally:
        spark.streams.removeListener(listener)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(query, batch, rows, seconds, rate, at, done, backlog, eta_seconds): rows so far, rows to come and the time they take at the rate so far."""
    reports = spark.read.schema(REPORT).json(folder)
    so_far = W.partitionBy("query").orderBy("batch").rowsBetween(W.unboundedPreceding, 0)
    done = F.sum("rows").over(so_far)
    rate = done / F.greatest(F.sum("seconds").over(so_far), F.lit(0.001))
    rows = reports.withColumns({"done": done, "mean_rate": rate}).withColumn("backlog", F.col("total") - F.col("done"))
    return rows.withColumn("eta_seconds", F.col("backlog") / F.col("mean_rate")).drop("total", "mean_rate")
