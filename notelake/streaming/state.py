"""Keyed state on streams: streaks of zero steps, and a bounded memory of the best candidates that a new piece clears.

Both depend on the order of a key's rows, which a stream doesn't keep: a row may
come in a later micro-batch than its successor. :class:`InOrder` therefore takes the
rows of a key by their sequence number from 0 on, without a gap. A row whose
predecessors are missing waits in the state store (not in memory); one that was
taken before is ignored, so files that are delivered twice change nothing. So the
result is the same however rows are split into micro-batches, and a restart goes on
from the checkpoint.

A request to the state store and a frame of a group cost far more than a row does.
So 2 ** ``TOGETHER`` keys that follow one another share a group, whose places are read
and written once a micro-batch, and rows wait in blocks of ``BLOCK`` sequence numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Zero steps in a row that bar another one; candidates that a memory holds.
BARRED, HELD = 3, 8
#: Low bits in which the keys of a group may differ; sequence numbers that wait in one entry of the store; rows after which waiting ones are given away; the group of rows without a key (no long shifted by TOGETHER comes to it, and no lane).
TOGETHER, BLOCK, CHUNK, NOBODY = 4, 1024, 10_000, -(2**62)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State beyond memory needs the RocksDB store; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class InOrder(StatefulProcessor):
    """Takes the rows of each key of a group by sequence number.

    ``key`` and ``seq`` name those columns; ``values`` (a schema) is what a row brings
    along, ``kept`` (a schema) what is known of a key between its rows, ``fresh`` that
    before the first row. What is made of the rows, ``output``, is added to ``made``.
    """

    key, seq, values, kept, fresh, output, together = "key", "seq", "", "", (), "", TOGETHER

    def init(self, handle: StatefulProcessorHandle) -> None:
        columns = [v.split() for v in self.values.split(",")]
        self.names, self.shown, self.made = [name for name, _ in columns], [o.split()[0] for o in self.output.split(",")], []
        self.places = handle.getListState("places", f"key long, next long, waiting long, {self.kept}")
        self.early = handle.getMapState("early", "key long, block long", ", ".join(f"{name} array<{kind}>" for name, kind in [("seq", "long"), *columns]))

    def take(self, key: int | None, at: int, values: tuple, kept: tuple) -> tuple:
        """The next row of a key; returns what is to be kept."""
        raise NotImplementedError

    def finish(self) -> None:
        """Before what was made is given away."""

    def _given(self) -> Iterator[pd.DataFrame]:
        self.finish()
        made, self.made = self.made, []
        if made:
            yield pd.DataFrame(made, columns=self.shown)

    def _waiting(self, key: int, block: int) -> dict[int, tuple]:
        found = self.early.getValue((key, block)) if self.early.containsKey((key, block)) else None
        return {seq: tuple(values) for seq, *values in zip(*found, strict=True)} if found else {}

    def _wait(self, key: int, block: int, rows: dict[int, tuple]) -> None:
        if rows:
            self.early.updateValue((key, block), (list(rows), *map(list, zip(*rows.values(), strict=True))))
        else:
            self.early.removeKey((key, block))

    def _put_off(self, key: int, block: int, rows: dict[int, tuple], waiting: int) -> int:
        """Lets rows wait; returns the number that wait for the key now."""
        before = self._waiting(key, block) if waiting else {}
        self._wait(key, block, rows | before)
        return waiting + len(rows.keys() - before.keys())

    def _follow(self, key: int, shown: int | None, at: int, waiting: int, kept: tuple) -> tuple[int, int, tuple]:
        """Takes the rows that wait in the block of ``at`` and follow one another from there on."""
        block, began = at // BLOCK, at
        rows = self._waiting(key, block) if waiting else {}
        while at in rows:
            kept = self.take(shown, at, rows.pop(at), kept)
            at, waiting = at + 1, waiting - 1
        if at > began:
            self._wait(key, block, rows)
        return at, waiting, kept

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        nobody = key[0] == NOBODY
        places = {k: (at, waiting, tuple(kept)) for k, at, waiting, *kept in self.places.get()}
        for frame in rows:
            late: dict[tuple[int, int], dict[int, tuple]] = {}
            frame = frame.sort_values([self.key, self.seq], kind="stable")
            for k, seq, *values in zip(*(frame[c].tolist() for c in (self.key, self.seq, *self.names)), strict=True):
                at, waiting, kept = places.get(k) or (0, 0, self.fresh)
                if seq == at and not waiting:  # else it takes its turn among those that wait
                    places[k] = at + 1, 0, self.take(None if nobody else k, at, tuple(values), kept)
                elif seq >= at:
                    late.setdefault((k, seq // BLOCK), {}).setdefault(seq, tuple(values))
            for (k, block), more in late.items():
                at, waiting, kept = places.get(k) or (0, 0, self.fresh)
                places[k] = at, self._put_off(k, block, more, waiting), kept
            for k in {k for k, _ in late}:
                began = None
                while began != places[k]:
                    began = places[k]
                    places[k] = self._follow(k, None if nobody else k, *began)
                    if len(self.made) >= CHUNK:
                        yield from self._given()
            yield from self._given()
        self.places.put([(k, at, waiting, *kept) for k, (at, waiting, kept) in places.items()])

    def close(self) -> None:
        pass


class ZeroStreak(InOrder):
    """Zero steps in a row up to each note; any other step ends the streak."""

    key, seq, values, kept, fresh = "piece_id", "note_ix", "zero boolean", "streak long", (0,)
    output = "piece_id long, note_ix long, streak long, barred boolean"

    def take(self, key: int | None, at: int, values: tuple, kept: tuple) -> tuple:
        streak = kept[0] + 1 if values[0] else 0
        self.made.append((key, at, streak, streak >= BARRED))
        return (streak,)


class ThemeMemory(InOrder):
    """The best candidates of the piece that a lane is at, ``HELD`` at most: of equal scores the earlier position stays; a new piece clears them.

    At the end of a chunk each piece that was touched gives its memory as it stands (or
    stood when it was cleared), with the number of the lane's last row; the last such
    rows of a piece are its memory.
    """

    key, seq, values = "lane", "seq", "piece long, pos long, score double"
    together = 0  # a lane has rows enough for a group of its own
    kept, fresh = "piece long, pos array<long>, score array<double>", (None, [], [])
    output = "lane long, piece long, pos long, score double, seen long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.touched = {}

    def take(self, key: int | None, at: int, values: tuple, kept: tuple) -> tuple:
        piece, held = int(values[0]), list(zip(*kept[1:], strict=True))
        if piece != kept[0]:
            self._show(key)
            held = []
        held.append((int(values[1]), float(values[2])))
        if len(held) > HELD:
            held.remove(min(held, key=lambda m: (m[1], -m[0])))
        self.touched[key] = piece, held, at
        return piece, [pos for pos, _ in held], [score for _, score in held]

    def _show(self, key: int | None) -> None:
        if key in self.touched:
            piece, held, seen = self.touched.pop(key)
            self.made += [(key, piece, pos, score, seen) for pos, score in held]

    def finish(self) -> None:
        for key in list(self.touched):
            self._show(key)


def stateful(rows: DataFrame, processor: InOrder) -> DataFrame:
    """A stream of rows through keyed state; in append mode, as each row is made once."""
    key = F.col(processor.key)
    grouped = rows.withColumn("together", F.coalesce(F.shiftright(key.cast("long"), processor.together), F.lit(NOBODY))).withColumn(processor.key, F.coalesce(key, F.lit(0)))
    return grouped.groupBy("together").transformWithStateInPandas(statefulProcessor=processor, outputStructType=processor.output, outputMode="Append", timeMode="None")


def zero_streaks(steps: DataFrame) -> DataFrame:
    """(piece_id, note_ix, streak, barred) of a stream of (piece_id, note_ix, delta_tok), note_ix from 0 on in each piece."""
    zero = F.coalesce(F.col("delta_tok") == 0, F.lit(False))
    return stateful(steps.select("piece_id", "note_ix", zero.alias("zero")), ZeroStreak())


def theme_memory(candidates: DataFrame) -> DataFrame:
    """(lane, piece, pos, score, seen) of a stream of (lane, seq, piece, pos, score), seq from 0 on in each lane and pieces one after another."""
    return stateful(candidates.select("lane", "seq", "piece", "pos", "score"), ThemeMemory())


def last_memory(shown: DataFrame) -> DataFrame:
    """(lane, piece, pos, score): of what :func:`theme_memory` gave, the last memory of each piece."""
    newest = F.max("seen").over(W.partitionBy("lane", "piece"))
    return shown.withColumn("newest", newest).filter(F.col("seen") == F.col("newest")).select("lane", "piece", "pos", "score").distinct()


def run(spark: SparkSession, folder: str, schema: str, through: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """All files of a folder that are new since the last call with this checkpoint, through a stateful stream into the table at ``out``; returns that table."""
    with rocks(spark):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
        query = through(source).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out)
