"""Adjacent-pair mining and merging of token sequences, as window functions over (piece_id, pos, tok) rows.

No piece is gathered into one row, so a long piece is sorted (and spilled) but
never held. A place in the corpus is the struct (piece_id, pos).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.sources.interim import forget, new_path

#: Merges that may be broadcast to a pass: two and a half times the largest vocabulary in use.
MOST_MERGES = 75_000
#: Tokens of a block.
BLOCK = 4096


def _by_pos(*bounds: int):
    w = W.partitionBy("piece_id").orderBy("pos")
    return w.rowsBetween(*bounds) if bounds else w


def counts(tokens: DataFrame) -> DataFrame:
    """(lhs, rhs, freq, first): overlapping adjacent pairs of (piece_id, pos, tok) rows; first is the place first seen."""
    rhs = F.lead("tok").over(_by_pos())
    pairs = tokens.select(F.col("tok").alias("lhs"), rhs.alias("rhs"), F.struct("piece_id", "pos").alias("place")).filter("rhs IS NOT NULL")
    return pairs.groupBy("lhs", "rhs").agg(F.count(F.lit(1)).alias("freq"), F.min("place").alias("first"))


def top(tokens: DataFrame, most: int, base: int, least: int = 2) -> DataFrame:
    """(rank, lhs, rhs, freq, new_id): the most frequent pairs, ties by first place; a top-k of a stated size."""
    best = counts(tokens).filter(F.col("freq") >= least).orderBy(F.desc("freq"), "first").limit(most)
    rank = F.row_number().over(W.orderBy(F.desc("freq"), "first")) - 1  # over a table of ``most`` rows
    return best.select(rank.alias("rank"), "lhs", "rhs", "freq", (rank + base).alias("new_id"))


def merge_pass(tokens: DataFrame, merges: DataFrame) -> DataFrame:
    """One greedy pass from left to right with merges (lhs, rhs, new_id): (piece_id, pos, tok, first, last), first and last being the places of the first and last token merged.

    In a run of places whose pairs all merge, greedy merging takes the first, third,
    fifth ... pair. So a token is taken up by the one before it if an odd number of
    pairs that merge stands right before it, and begins a merge if an even number
    does and its own pair merges: no state is carried but the last place whose pair
    doesn't merge.
    """
    rows = tokens.select("piece_id", "pos", "tok", F.lead("tok").over(_by_pos()).alias("rhs"))
    if merges.limit(MOST_MERGES + 1).count() > MOST_MERGES:
        raise ValueError(f"more than the {MOST_MERGES} merges that may be broadcast")
    new = F.broadcast(merges.select(F.col("lhs").alias("tok"), "rhs", "new_id"))  # at most MOST_MERGES rows
    rows = rows.join(new, ["tok", "rhs"], "left").withColumn("place", F.row_number().over(_by_pos()))
    stop = F.max(F.when(F.col("new_id").isNull(), F.col("place"))).over(_by_pos(W.unboundedPreceding, -1))
    rows = rows.withColumn("before", F.col("place") - 1 - F.coalesce(stop, F.lit(0))).filter(F.col("before") % 2 == 0)
    return rows.select(
        "piece_id", (F.row_number().over(_by_pos()) - 1).alias("pos"), F.coalesce("new_id", "tok").alias("tok"),
        F.col("pos").alias("first"), (F.col("pos") + F.col("new_id").isNotNull().cast("int")).alias("last"),
    )


def independent(pairs: list, most: int) -> list:
    """The longest beginning of ``pairs`` (lhs, rhs, rank or frequency, id made if known), best first, in which no pair ends with what another one starts with.

    Two such pairs never overlap in a sequence, so merging one leaves the places of the
    other as they are. What a merge makes new, say (x, ab) from x a b, is at most as
    frequent as the pair (x, a) was and is first seen no earlier than its neighbours;
    (x, a) ends with what (a, b) starts with, so it isn't in the beginning and all of
    the beginning ranks before it. So merging the beginning in one round gives what one
    round a pair gives. A pair of equal tokens goes alone.
    """
    out, starts, ends, made = [], set(), set(), set()
    for p in pairs[:most]:
        a, b = p[0], p[1]
        if a in ends or b in starts or {a, b} & made or (a == b and out):
            break
        out.append(p)
        starts.add(a)
        ends.add(b)
        made |= set(p[3:])
        if a == b:
            break
    return out


def blocks(tokens: DataFrame, size: int = BLOCK) -> DataFrame:
    """(piece_id, block, toks): the tokens of (piece_id, pos, tok) rows in arrays of at most ``size``, so a piece of any length is many rows."""
    one = tokens.groupBy("piece_id", F.floor(F.col("pos") / size).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", F.col("tok").cast("int").alias("tok")))).alias("t"))
    return one.select("piece_id", "block", F.col("t.tok").alias("toks"))


def with_edges(cut: DataFrame) -> DataFrame:
    """Blocks with the last token before and the first token after each (-1: none); only those edges are put in order."""
    w = W.partitionBy("piece_id").orderBy("block")
    edges = cut.select("piece_id", "block", F.element_at("toks", 1).alias("head"), F.element_at("toks", -1).alias("tail"))
    edges = edges.select("piece_id", "block", F.coalesce(F.lag("tail").over(w), F.lit(-1)).alias("before"), F.coalesce(F.lead("head").over(w), F.lit(-1)).alias("after"))
    return cut.join(edges, ["piece_id", "block"])


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a batch's blocks, the row of each, and each pair of a token and its successor as one number (negative: none)."""
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    sizes = column("toks").value_lengths().to_numpy(zero_copy_only=False)
    tok = column("toks").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    after = np.empty(len(tok), np.int64)
    after[:-1] = tok[1:]
    ends = np.cumsum(sizes) - 1
    after[ends] = column("after").to_numpy(zero_copy_only=False)
    return tok, row, np.where(after < 0, -1, tok << 32 | after)


def merge_blocks(cut: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """(piece_id, block, toks) with independent merges (lhs, rhs, new id) of different tokens applied; the block of a pair's first token gets what it becomes."""
    table = np.array(sorted((a << 32 | b, n) for a, b, n in merges), np.int64)

    def hits(pairs: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(table[:, 0], pairs), len(table) - 1)
        return np.where(table[at, 0] == pairs, table[at, 1], -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, row, pair = _flat(batch)
            new = hits(pair)
            taken = np.empty(len(tok), bool)
            taken[1:] = new[:-1] >= 0
            first = np.flatnonzero(np.diff(row, prepend=-1))
            before = batch.column(batch.schema.get_field_index("before")).to_numpy(zero_copy_only=False).astype(np.int64)
            taken[first] = (before >= 0) & (hits(before << 32 | tok[first]) >= 0)
            out, sizes = np.where(new >= 0, new, tok)[~taken].astype(np.int32), np.bincount(row[~taken], minlength=batch.num_rows)
            toks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(out))
            made = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("piece_id")), batch.column(batch.schema.get_field_index("block")), toks], ["piece_id", "block", "toks"])
            yield made.filter(pa.array(sizes > 0))

    return with_edges(cut).mapInArrow(run, cut.schema)


def count_blocks(cut: DataFrame) -> DataFrame:
    """(lhs, rhs, freq, first) of blocks, counted in each task before the shuffle; first is a struct that orders as places do."""
    piece = cut.schema["piece_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
            _, row, pair = _flat(batch)
            order = np.argsort(np.lexsort((column("block"), column("piece_id"))))[row]
            at = np.flatnonzero(pair >= 0)
            at = at[np.lexsort((at, order[at], pair[at]))]  # a row's tokens stand in order already
            if not len(at):
                continue
            first = np.flatnonzero(np.diff(pair[at], prepend=-1))
            n, some = np.diff(np.append(first, len(at))), at[first]
            inside = some - np.searchsorted(row, row[some])
            columns = [pair[some] >> 32, pair[some] & 0xFFFFFFFF, n, column("piece_id")[row[some]], column("block")[row[some]], inside]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["lhs", "rhs", "n", "piece", "block", "inside"])

    if piece not in ("bigint", "int"):
        raise TypeError("pieces are numbered")
    found = with_edges(cut).mapInArrow(run, "lhs long, rhs long, n long, piece long, block long, inside long")
    return found.groupBy("lhs", "rhs").agg(F.sum("n").alias("freq"), F.min(F.struct("piece", "block", "inside")).alias("first"))


def as_rows(cut: DataFrame) -> DataFrame:
    """(piece_id, pos, tok) of blocks, positions counted anew."""
    rows = cut.select("piece_id", "block", F.posexplode("toks").alias("k", "tok"))
    sizes = cut.select("piece_id", "block", F.size("toks").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("piece_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(sizes.select("piece_id", "block", before.alias("before")), ["piece_id", "block"]).select("piece_id", (F.col("before") + F.col("k")).cast("int").alias("pos"), "tok")


class Rounds:
    """A table of blocks that is written anew each round; the one before it is removed, so a lost executor costs one round at most."""

    def __init__(self, tokens: DataFrame, size: int):
        self.spark, self.size, self.last = tokens.sparkSession, size, None
        self.table = self._written(blocks(tokens, size))

    def _written(self, cut: DataFrame) -> DataFrame:
        path = new_path(self.spark, "merged")
        cut.write.parquet(path)
        table = self.spark.read.schema(cut.schema).parquet(path)
        if self.last:
            forget(self.spark, self.last)
        self.last = path
        return table

    def merge(self, merges: list[tuple[int, int, int]]) -> None:
        if any(a == b for a, b, _ in merges):  # which pairs of a run merge depends on the whole run
            table = self.spark.createDataFrame(merges, "lhs int, rhs int, new_id int")
            self.table = self._written(blocks(merge_pass(as_rows(self.table), table), self.size))
        else:
            self.table = self._written(merge_blocks(self.table, merges))


def train_iterative(tokens: DataFrame, size: int, base: int, least: int = 2, batch: int = 256, block: int = BLOCK) -> tuple[list[tuple[int, int, int, int]], DataFrame]:
    """Merges up to ``size``, or until no pair occurs ``least`` times: (rank, lhs, rhs, freq), and the merged (piece_id, pos, tok) rows.

    A round counts the pairs of blocks, takes the best ones that are independent (of
    ``batch`` that come to the driver) and merges them in one pass over the blocks.
    """
    rounds, merges = Rounds(tokens, block), []
    while len(merges) < size:
        best = count_blocks(rounds.table).filter(F.col("freq") >= least).orderBy(F.desc("freq"), "first").limit(batch).collect()
        own = independent([(r.lhs, r.rhs, r.freq) for r in best], size - len(merges))
        if not own:
            break
        rounds.merge([(a, b, base + len(merges) + k) for k, (a, b, _) in enumerate(own)])
        merges += [(len(merges) + k, *p) for k, p in enumerate(own)]
    return merges, as_rows(rounds.table)


def apply_ranked(tokens: DataFrame, merges: list[tuple[int, int, int]], block: int = BLOCK) -> DataFrame:
    """(piece_id, pos, tok) with merges (lhs, rhs, new id) applied by rank, leftmost first: passes with merges that are independent, in order."""
    if len(merges) > MOST_MERGES:
        raise ValueError(f"{len(merges)} merges are more than the {MOST_MERGES} that may be broadcast")
    made = {n: r for r, (_, _, n) in enumerate(merges)}
    if any(made.get(x, -1) >= r for r, (a, b, _) in enumerate(merges) for x in (a, b)):
        raise ValueError("a merge may only use tokens that merges before it make")
    rounds, done = Rounds(tokens, block), 0
    ranked = [(a, b, r, n) for r, (a, b, n) in enumerate(merges)]
    while done < len(merges):
        own = independent(ranked[done:], len(merges))
        done += len(own)
        rounds.merge([(a, b, n) for a, b, _, n in own])
    return as_rows(rounds.table)
