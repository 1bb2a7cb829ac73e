"""Hard-negative mining by bit-sliced integer products.

Vectors become integers floor(256 x). A vector's components are cut into bit
planes, the sign plane first; planes come to the product with a block of anchors
most significant first. After each plane a pair's score lies in an interval, as
what is still to come adds between (2^b - 1) times the sum of the anchor's negative
components and (2^b - 1) times the sum of its positive ones. A candidate whose
interval can't reach what an anchor has found already, or can't meet its score
band, is dropped; the last planes are multiplied for surviving pairs only, and
when no plane is left the score is exact.

The query set (anchors) comes in blocks of at most ``BLOCK_BYTES``; each block is
broadcast to one pass over all vectors for positives, and to one for negatives, and
is let go before the next. Vectors are never shuffled: a task keeps the best few
rows for each anchor and only those are merged.

Defined results: rows with a null label, a null or empty vector, or a null or
non-finite component take no part, nor do rows with a component whose products
may not fit a long (see :func:`quantised`); a shorter vector counts as filled
with zeros; rows with a null id take part as candidates, last among ties; repeated
rows are rows of their own, each id once per row; an anchor without positives, or a
band without rows, gives no row; an empty table has none; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.llm.common import keep, new_path

#: What a component is multiplied by, positives of an anchor, negatives of a positive, the band in percent of the positive's score.
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
#: Every id that this divides is an anchor.
EVERY = 100
#: Bytes of anchors that one pass takes (8 a component), and vectors that a task multiplies with them at once (less for large blocks).
BLOCK_BYTES, CELLS = 16_000_000, 2_000_000
#: Largest number of pairs whose components are gathered at once.
PAIRS = 50_000
#: Pairs are multiplied one by one when so small a share of them is left.
SPARSE = 1 / 32
RESULT = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
NEVER = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, q): rows that take part, their components floor(256 x), and a row number of their own.

    The number of components times the square of the largest must be below 2^62, so
    that every score fits a long; a row beyond that takes no part.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.transform(vector_col, lambda x: x.cast("double") * SCALE).alias("v"))
    size = F.size("v")
    most = F.floor(F.sqrt(F.lit(2.0**62) / size))
    fits = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < most), F.lit(False)))
    rows = rows.filter(F.col("label").isNotNull() & F.col("v").isNotNull() & (size > 0) & fits)
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.transform("v", lambda x: F.floor(x).cast("long")).alias("q"))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array as a matrix, filled up with zeros (or cut where ``width`` is smaller: the other side has only zeros there)."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


class Block:
    """A block of anchors: components, and by how much a unit of every later plane can lower or raise each score."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, q: np.ndarray, scores: np.ndarray | None = None):
        self.rows, self.labels, self.q = rows, labels, q
        self.down, self.up = np.minimum(q, 0).sum(1), np.maximum(q, 0).sum(1)
        #: Scores of the positives, an anchor a row, filled up with -1 (a band below zero is empty).
        self.scores = scores

    def of(self, keep: np.ndarray) -> Block:
        return Block(self.rows[keep], self.labels[keep], self.q[keep], None if self.scores is None else self.scores[keep])


def bits_of(q: np.ndarray) -> int:
    """Planes that hold every component, the sign plane among them."""
    return int(max(q.max(initial=0), -q.min(initial=0) - 1)).bit_length() + 1


def sliced(block: Block, q: np.ndarray, alive: np.ndarray, qualify) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, candidate, exact score) of the pairs that stay qualified to the last plane.

    ``alive`` says which pairs (anchors down, candidates across) take part, and
    ``qualify(anchor, low, high)`` which of them may still count when their scores
    lie between ``low`` and ``high``; it gets either matrices or lists of pairs.
    """
    planes = bits_of(q)
    exact = q.shape[1] * max(1, int(np.abs(block.q).max(initial=0))) << planes
    kind = np.float32 if exact < 1 << 24 else np.float64 if exact < 1 << 53 else np.int64  # whichever holds every partial score
    own, part = block.q.astype(kind), np.zeros((len(block.q), len(q)), np.int64)
    everyone = np.arange(len(block.q))[:, None]
    plane = planes - 1
    while plane >= 0 and alive.any() and alive.mean() >= SPARSE:
        worth = -(1 << plane) if plane == planes - 1 else 1 << plane
        part += worth * (own @ (q >> plane & 1).T.astype(kind)).astype(np.int64)
        rest = (1 << plane) - 1
        alive &= qualify(everyone, part + rest * block.down[:, None], part + rest * block.up[:, None])
        plane -= 1
    anchor, candidate = np.nonzero(alive)
    part = part[anchor, candidate]
    while plane >= 0 and len(anchor):
        worth, rest = -(1 << plane) if plane == planes - 1 else 1 << plane, (1 << plane) - 1
        for i in range(0, len(anchor), PAIRS):
            j = slice(i, i + PAIRS)
            part[j] += worth * np.einsum("ij,ij->i", block.q[anchor[j]], q[candidate[j]] >> plane & 1)
        stay = qualify(anchor, part + rest * block.down[anchor], part + rest * block.up[anchor])
        anchor, candidate, part, plane = anchor[stay], candidate[stay], part[stay], plane - 1
    return anchor, candidate, part


def kth(low: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; NEVER where there are fewer."""
    return np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), NEVER)


class Best:
    """The best rows of each list so far: (score, id, row), at most ``most`` a list, in order."""

    def __init__(self, lists: int, most: int):
        self.most, self.found, self.floor = most, [[] for _ in range(lists)], np.full(lists, NEVER)

    def add(self, at: np.ndarray, scores: np.ndarray, ids: list, rows: np.ndarray) -> None:
        for i in np.unique(at):
            mine = np.flatnonzero(at == i) if len(at) < 64 else self._of(at, i)
            new = [(-int(scores[j]), ids[j] is None, ids[j] or 0, int(rows[j])) for j in mine]  # a null id comes last among ties
            self.found[i] = sorted([*self.found[i], *new])[: self.most]
            if len(self.found[i]) == self.most:
                self.floor[i] = -self.found[i][-1][0]

    @staticmethod
    def _of(at: np.ndarray, i: int) -> np.ndarray:
        return np.arange(np.searchsorted(at, i), np.searchsorted(at, i, "right"))  # lists come in order


def positives_of(block: Block, labels: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: list, best: Best) -> None:
    """Adds a batch's rows to the best of the anchors of their label; an anchor isn't its own positive."""
    for label in np.intersect1d(block.labels, labels):
        mine, theirs = np.flatnonzero(block.labels == label), np.flatnonzero(labels == label)
        floor = best.floor[mine]
        alive = block.rows[mine][:, None] != rows[theirs][None, :]
        others = alive.copy()

        def qualify(anchor, low, high, floor=floor, others=others):
            if low.ndim == 2:
                np.maximum(floor, kth(np.where(others, low, NEVER), POSITIVES), out=floor)
            return high >= floor[anchor]

        a, c, score = sliced(block.of(mine), q[theirs], alive, qualify)
        best.add(mine[a], score, [ids[i] for i in theirs[c]], rows[theirs[c]])


def negatives_of(block: Block, labels: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: list, best: Best) -> None:
    """Adds a batch's rows of other labels to the best of each band; list i * POSITIVES + k is the band of positive k of anchor i."""
    n = block.scores.shape[1]
    floor = best.floor.reshape(-1, n)
    bottom = np.where(block.scores >= 0, -(-LOW * block.scores // HIGH), 1)

    def qualify(anchor, low, high):
        out = np.zeros(low.shape, bool)
        for k in range(n):
            top, least = block.scores[anchor, k], bottom[anchor, k]
            # a band is empty where its top is below its bottom; a full band takes nothing below its last row
            out |= (low <= top) & (high >= np.maximum(least, floor[anchor, k])) & (top >= least)
        return out

    alive = block.labels[:, None] != labels[None, :]
    a, c, score = sliced(block, q, alive, qualify)
    for k in range(n):
        inside = (score <= block.scores[a, k]) & (score >= bottom[a, k])
        best.add(a[inside] * n + k, score[inside], [ids[i] for i in c[inside]], rows[c[inside]])


FOUND = "anchor long, list int, score long, id long, row long"
FOUND_TYPES = pa.schema([("anchor", pa.int64()), ("list", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("row", pa.int64())])


def _pass(table: DataFrame, block: Block, most: int, lists: int, search) -> DataFrame:
    """The best rows of each list of each anchor: a few a task, then merged."""
    shared = table.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best, step = Best(len(own.rows) * lists, most), max(64, CELLS // max(1, len(own.rows)))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                column = lambda name, part=part: part.column(part.schema.get_field_index(name))
                search(own, column("label").to_numpy(zero_copy_only=False), matrix(column("q"), own.q.shape[1]), column("row").to_numpy(), column("id").to_pylist(), best)
        out = [(int(own.rows[i // lists]), i % lists, -s, None if none else at, row) for i, found in enumerate(best.found) for s, none, at, row in found]
        for i in range(0, len(out), 10_000):
            some = zip(*out[i : i + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(some, FOUND_TYPES, strict=True)], schema=FOUND_TYPES)

    order = W.partitionBy("anchor", "list").orderBy(F.desc("score"), F.col("id").isNull(), "id", "row")
    found = table.mapInArrow(run, FOUND).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    found = keep(found, "neighbours")
    shared.destroy()
    return found


def _block(anchors: DataFrame) -> Block:
    """A bounded block of anchors on the driver, from where it is broadcast."""
    rows = anchors.select("row", "label", "q").toArrow().combine_chunks()
    column = lambda name: rows.column(name).combine_chunks()
    width = int(max(column("q").value_lengths().to_numpy(zero_copy_only=False), default=1))
    return Block(column("row").to_numpy(), column("label").to_numpy(), matrix(column("q"), width))


def _with_scores(block: Block, found: DataFrame) -> Block:
    """The block's anchors that have positives, and those positives' scores."""
    own = found.select("anchor", "score", "rank").toArrow()  # at most POSITIVES rows for each anchor of the block
    anchor, score, rank = (own.column(i).to_numpy() for i in range(3))
    order = np.argsort(block.rows)
    at = order[np.searchsorted(block.rows, anchor, sorter=order)]
    scores = np.full((len(block.rows), POSITIVES), -1, np.int64)
    scores[at, rank - 1] = score
    return Block(block.rows, block.labels, block.q, scores).of(np.unique(at))


def mine(table: DataFrame, anchors: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors (rows of ``table``) among all rows of ``table``.

    Both have the columns of :func:`quantised`, and ``table`` stands where its row numbers don't change (a written table).
    """
    spark = table.sparkSession
    size = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    blocks = max(1, -(-size.n * 8 * (size.width or 1) // block_bytes))
    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    ids, path = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), new_path(spark, "negatives")
    for b in range(blocks):
        block = _block(dealt.filter(F.col("block") == b))
        if not len(block.rows):
            continue
        positives = _pass(table, block, POSITIVES, 1, positives_of)
        negatives = _pass(table, _with_scores(block, positives), NEGATIVES, POSITIVES, negatives_of)
        of = positives.select("anchor", (F.col("rank") - 1).alias("list"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        pairs = negatives.select("anchor", "list", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(of, ["anchor", "list"])
        pairs.join(ids, "anchor").select(*RESULT).write.mode("append").parquet(path)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.read.schema(schema).parquet(path) if size.n else spark.createDataFrame([], schema)


def mine_vectors(vectors: DataFrame, every: int = EVERY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """:func:`mine` with the rows whose id ``every`` divides as anchors, over a written table of integers."""
    table = keep(quantised(vectors), "quantised")
    return mine(table, table.filter(F.col("id") % every == 0), block_bytes)


def relabelled(embeddings: DataFrame) -> DataFrame:
    """The contract's labels: where 7 divides the id, the next one of ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return embeddings.select("vec_id", moved.alias("label"), "embedding")
