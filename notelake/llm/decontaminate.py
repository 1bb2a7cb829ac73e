"""Benchmark decontamination by an FM-index over each training shard.

A task cuts its documents into shards of bounded size and indexes every word of a
shard. The benchmark's windows are searched backward through wavelet-tree ranks,
occurrences are located by sampled suffix positions, and their spans are merged
per document. Documents are never shuffled: the windows travel to them, in blocks
of ``BLOCK_WORDS`` words, and a task looks up all blocks in a shard's one index,
one block after the other. However many blocks there are, each row is judged
once, where it stands. The driver makes a block at a time from pieces of items
(``PIECE_WORDS``), so neither a large benchmark nor a huge item passes it whole.

Defined results: null and empty texts have no words; an item without words has
no window, one of fewer than ``WINDOW`` words is one window; a null item id is
named "null"; every row is judged, whether or not its id repeats or is null; empty
tables give no rows or no hits; a very long text is a shard of its own; extra
columns are ignored, or passed through where rows are dropped.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import id_and_text, packed
from notelake.llm.fm_index import FmIndex

WINDOW = 10
#: Words of benchmark text in one block, in one piece of an item, and indexed words of one shard.
BLOCK_WORDS, PIECE_WORDS, SHARD_WORDS = 250_000, 50_000, 500_000
#: Rows that are located at a time.
LOCATE_ROWS = 1_000_000
#: Bytes: A-Z to lower case, every other ASCII character but 0-9 and a-z to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
FOUND = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TO_WORDS).split()


class Windows:
    """The distinct windows of one block of benchmark pieces, as arrays."""

    def __init__(self, pieces: list[tuple[str, list[bytes]]], width: int = WINDOW):
        ids = defaultdict(count(1).__next__)
        names = defaultdict(count().__next__)
        rows, owners = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for item, words in pieces:
            if not words:
                continue
            symbols = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
            symbols = np.concatenate((np.zeros(max(0, width - len(words)), np.int32), symbols))  # a short item stands at the right
            rows.append(np.lib.stride_tricks.sliding_window_view(symbols, width))
            owners.append(np.full(len(rows[-1]), names[item]))
        self.vocabulary, self.names = list(ids), list(names)
        self.phrases, window = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.phrases > 0).sum(axis=1)
        pairs = np.unique(np.stack((window.ravel(), np.concatenate(owners)), axis=1), axis=0)
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.phrases) + 1))

    def items(self, windows: np.ndarray) -> set[str]:
        """Names of the items that hold any of the windows."""
        return {self.names[o] for w in windows.tolist() for o in self.owners[self.first[w] : self.first[w + 1]].tolist()}


def _pieces(width: int):
    """Items cut into pieces that overlap by what a window needs, so that each window is in one piece."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item, text in zip(frame["item"], frame["text"], strict=True):
                words = split_words(text)
                for at in range(0, max(1, len(words) - width + 1), PIECE_WORDS):
                    yield pd.DataFrame({"item": [item], "words": [b" ".join(words[at : at + PIECE_WORDS + width - 1])]})

    return cut


def blocks(benchmark: DataFrame, width: int = WINDOW) -> list[Broadcast]:
    """The windows of the benchmark in broadcasts of bounded size; at least one, which may hold no window."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    context, out, held, size = benchmark.sparkSession.sparkContext, [], [], 0
    for r in items.mapInPandas(_pieces(width), "item string, words binary").toLocalIterator():
        held.append((r.item, bytes(r.words).split()))
        size += len(held[-1][1])
        if size >= BLOCK_WORDS:
            out.append(context.broadcast(Windows(held, width)))
            held, size = [], 0
    if held or not out:
        out.append(context.broadcast(Windows(held, width)))
    return out


class Shard:
    """Documents gathered for one index."""

    def __init__(self, most: int = SHARD_WORDS):
        """It is full at ``most`` words."""
        self.most = most
        self.symbols = defaultdict(count(1).__next__)
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list, at: int) -> int:
        """Take texts from place ``at`` on until the shard is full; how many were taken."""
        begin = len(self.parts)
        for text in texts[at:] if at else texts:
            words = split_words(text)
            self.parts.append(np.fromiter(map(self.symbols.__getitem__, words), np.int32, len(words)))
            self.size += len(words)
            if self.full():
                break
        return len(self.parts) - begin

    def full(self) -> bool:
        return self.size >= self.most

    def search(self, shared: list[Broadcast]) -> tuple[list[int], list[list[dict]], list[list[str]]]:
        """Per document: the number of words, merged spans of hit words, names of the items found."""
        lengths = np.fromiter(map(len, self.parts), np.int64, len(self.parts))
        ends = np.cumsum(lengths + 1)
        text = np.zeros(int(ends[-1]), np.int32)
        for part, end in zip(self.parts, ends.tolist(), strict=True):
            text[end - 1 - len(part) : end - 1] = part
        index, hits, items = FmIndex(text), [], [set() for _ in self.parts]
        for block in shared:
            windows = block.value
            for doc, start, window in self._occurrences(index, windows, ends):
                hits.append(np.stack((doc, start, start + windows.lengths[window])))
                both = np.unique(np.stack((doc, window)), axis=1)
                places, firsts = np.unique(both[0], return_index=True)
                for d, w in zip(places.tolist(), np.split(both[1], firsts[1:]), strict=True):
                    items[d] |= windows.items(w)
            if len(shared) > 1:
                block.__dict__.pop("_value", None)  # the worker keeps one block in memory, not all
        spans: list[list[dict]] = [[] for _ in self.parts]
        doc, start, end = np.concatenate(hits, axis=1) if hits else np.zeros((3, 0), np.int64)
        by = np.lexsort((start, doc))
        doc, start, end = doc[by], start[by], end[by]
        places, firsts = np.unique(doc, return_index=True)
        for d, s, e in zip(places.tolist(), np.split(start, firsts[1:]), np.split(end, firsts[1:]), strict=False):
            spans[d] = merge(s, e)
        return lengths.tolist(), spans, [sorted(i) for i in items]

    def _occurrences(self, index: FmIndex, windows: Windows, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, first word, window) of occurrences, some at a time."""
        absent = index.symbols  # a word that the shard lacks
        known = np.fromiter(map(self.symbols.get, windows.vocabulary, repeat(absent)), np.int64, len(windows.vocabulary))
        phrases = np.concatenate(([0], known))[windows.phrases]
        lo, hi = index.ranges(phrases, windows.lengths)
        found = np.flatnonzero(hi > lo)
        counts = (hi - lo)[found]
        total = np.cumsum(counts)
        for part in np.split(np.arange(len(found)), np.unique(np.searchsorted(total, np.arange(LOCATE_ROWS, counts.sum(), LOCATE_ROWS), "right"))):
            if len(part):
                n = counts[part]
                rows = np.repeat(lo[found[part]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                at = index.locate(rows)
                doc = np.searchsorted(ends, at, "right")
                yield doc, at - np.concatenate(([0], ends))[doc], np.repeat(found[part], n)


def merge(start: np.ndarray, end: np.ndarray) -> list[dict]:
    """Spans sorted by start, merged where they overlap or touch."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    last = np.concatenate((np.flatnonzero(new)[1:] - 1, [len(start) - 1]))
    return [{"start": int(s), "end": int(e)} for s, e in zip(start[new], reach[last], strict=True)]


def _per_shard(docs: DataFrame, texts_of, finish, schema) -> DataFrame:
    """Rows dealt into shards in the tasks that hold them; ``texts_of`` gives a batch's texts, ``finish`` makes output batches of a shard and its rows."""
    most = SHARD_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = Shard(most), []
        for batch in batches:
            texts, done = texts_of(batch).to_pylist(), 0
            while done < len(texts):
                took = shard.add(texts, done)
                held.append(batch.slice(done, took))
                done += took
                if shard.full():
                    yield from finish(shard, held)
                    shard, held = Shard(most), []
        if held:
            yield from finish(shard, held)

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, spans, items) of every document: merged spans of hit words, names of the items found."""
    shared = blocks(benchmark, width)

    def finish(shard: Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_words, spans, items = shard.search(shared)
        ids = pa.concat_arrays([b.column(0) for b in held]).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(SPAN)), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "spans", "items"])

    return _per_shard(id_and_text(docs), lambda batch: batch.column(1), finish, FOUND)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns. Rows pass through the tasks that search them, so nothing is shuffled."""
    shared = blocks(benchmark, width)

    def finish(shard: Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, done = pa.array([not s for s in shard.search(shared)[1]], pa.bool_()), 0
        for batch in held:
            yield batch.filter(good.slice(done, batch.num_rows))
            done += batch.num_rows

    rows, at = packed(docs), docs.columns.index("text")  # as one struct, so that any column name passes
    return _per_shard(rows, lambda batch: batch.column(0).field(at), finish, rows.schema).select("row.*")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from what :func:`contamination` returns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
