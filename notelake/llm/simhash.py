"""SimHash near-dedup with pivot distance tables.

Each document gets a 64-bit fingerprint of its 3-word shingles. The Hamming
distances of every distinct fingerprint to 16 pivots (reference fingerprints from
a fixed seed) are worked out once and written: the pivot table. By the triangle
inequality two fingerprints that differ in three bits at most have no coordinate
that differs by more than three, so a pair is discarded by its largest coordinate
difference, and survivors are verified by their own Hamming distance.

Coordinates of random fingerprints lie close together (32 +- 4), so they discard
pairs well but are no join key. Which pairs are looked at is therefore settled
by pigeonhole: the 64 bits are cut into five blocks, three differing bits leave
two blocks untouched, so two fingerprints that link share one of ten (mask, bits)
buckets. A bucket of two is judged in the aggregation that counts it; a bucket of
up to ``BUCKET`` brings its rows of the pivot table together; a larger one is
dealt again on its free bits by the same rule, and after four rounds fewer than
ten bits are free, which bounds every bucket whatever the data. Only a spanning
forest of each bucket leaves it, so a group of n near copies costs n links;
components are then found by star rounds.

Defined results: null and empty texts have fingerprint zero and link like any
other; fewer than three words are one shingle; rows that repeat an id are kept;
null ids never are a component's id unless it has no other; an empty table has no
rows; very long texts are hashed in parts of bounded memory; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake.llm.common import id_and_text, keep, one_row_each
from notelake.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints that one bucket may hold before it is dealt again.
BUCKET = 1024
BLOCKS, AGREE = 5, 2
#: Reference fingerprints, made from a fixed seed.
PIVOTS = np.random.default_rng(64).integers(0, 1 << 64, 16, dtype=np.uint64)
#: Columns of the pivot table: fingerprint, distances to the first eight pivots, to the other eight.
TABLE = ("fp", "near", "far")


def fingerprint(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < SHINGLE:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - SHINGLE + 1], ends[SHINGLE - 1 :]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounds the bit matrix of a very long text
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(text: Column | str) -> Column:
    """Fingerprints as signed longs."""
    return F.pandas_udf(_fingerprints, "long")(text)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def refine(mask: int) -> list[int]:
    """The masks that extend ``mask`` by two of the five blocks that its free bits are cut into."""
    free = [i for i in range(64) if not mask >> i & 1]
    cut = [sum(1 << i for i in part) for part in np.array_split(np.array(free, object), BLOCKS)]
    return sorted({mask | cut[i] | cut[j] for i in range(BLOCKS) for j in range(i)})


def pivot_table(fps: DataFrame) -> DataFrame:
    """(fp, near, far) of distinct fingerprints: the Hamming distances to the 16 pivots, a byte each, packed in two longs. Worked out once; every bucket reads them from here."""
    distance = lambda p: F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p))).cast("long"))).cast("long")
    packed = lambda ps: reduce(Column.bitwiseOR, [F.shiftleft(distance(p), 8 * k) for k, p in enumerate(ps)])
    return fps.select("fp", packed(PIVOTS[:8]).alias("near"), packed(PIVOTS[8:]).alias("far"))


def apart(a: Column, b: Column) -> Column:
    """The largest coordinate difference of two rows of the pivot table: a lower bound of their Hamming distance."""
    coordinate = lambda row, name, k: F.shiftrightunsigned(row[name], 8 * k).bitwiseAND(F.lit(255).cast("long"))
    return F.greatest(*[F.abs(coordinate(a, n, k) - coordinate(b, n, k)) for n in ("near", "far") for k in range(8)])


def _deal(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, fp, near, far) rows dealt to every finer mask: (mask, key, fp, near, far). The table of masks has at most ten rows for each of ``masks``."""
    finer = [(_signed(m), _signed(f)) for m in masks for f in refine(m)]
    if masks == [0]:
        dealt = rows.select(F.explode(F.array(*[F.lit(f) for _, f in finer])).alias("mask"), *TABLE)
    else:
        table = F.broadcast(rows.sparkSession.createDataFrame(finer, "mask long, finer long"))
        dealt = rows.join(table, "mask").select(F.col("finer").alias("mask"), *TABLE)
    dealt = dealt.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), *TABLE)
    return dealt.distinct() if len(masks) > 1 else dealt  # two masks may be refined to the same one


def spanning(bucket: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within one bucket of distinct fingerprints; ``table`` has their pivot distances."""
    rest, stack = np.arange(len(bucket)), []
    a, b = [], []
    while len(rest):
        if not stack:
            stack, rest = [rest[0]], rest[1:]
        x = stack.pop()
        close = np.abs(table[rest] - table[x]).max(axis=1, initial=0) <= RADIUS  # the pivots' verdict
        hit = close.copy()
        hit[close] = np.bitwise_count(bucket[rest[close]] ^ bucket[x]) <= RADIUS  # verified
        new = rest[hit]
        a += [x] * len(new)
        b += new.tolist()
        stack += new.tolist()
        rest = rest[~hit]
    return bucket[a], bucket[b]


def _bucket_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        pairs = []
        for fps, near, far in zip(frame["fps"], frame["nears"], frame["fars"], strict=True):
            table = np.stack((near, far), axis=1).astype("<i8").view(np.uint8).astype(np.int16)
            pairs.append(spanning(np.asarray(fps, np.int64).view(np.uint64), table))
        a, b = (np.concatenate([np.zeros(0, np.uint64), *(p[k] for p in pairs)]).view(np.int64) for k in (0, 1))
        yield pd.DataFrame({"a": a, "b": b})


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct (fp). Returns (a, b): a spanning forest of each bucket's links at RADIUS or fewer differing bits."""
    rows, masks, out = keep(pivot_table(fps), "pivot-table").select(F.lit(0).cast("long").alias("mask"), *TABLE), [0], None
    while True:
        dealt, row = _deal(rows, masks), F.struct(*TABLE)
        sizes = dealt.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("count"), F.min(row).alias("x"), F.max(row).alias("y")).filter("count > 1")
        sizes = keep(sizes, "buckets")
        # two rows are judged where they were counted: the pivots discard the pair, or it is verified
        two = sizes.filter((F.col("count") == 2) & (apart(F.col("x"), F.col("y")) <= RADIUS))
        two = two.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
        more = sizes.filter(F.col("count").between(3, BUCKET)).select("mask", "key")
        # written before it is grouped: a grouping by the join's own keys would keep AQE from splitting a hot bucket in the join
        small = keep(dealt.join(more, ["mask", "key"]).select("mask", "key", *TABLE), "small-buckets")
        lists = small.groupBy("mask", "key").agg(F.collect_list(row).alias("l"))
        found = lists.select(*[F.col(f"l.{c}").alias(f"{c}s") for c in TABLE]).mapInPandas(_bucket_links, "a long, b long").unionByName(two)
        out = found if out is None else out.unionByName(found)
        large = sizes.filter(F.col("count") > BUCKET).select("mask", "key")
        if large.isEmpty():
            return out.distinct()
        rows = keep(dealt.join(large, ["mask", "key"]).select("mask", *TABLE).distinct(), "large-buckets")
        masks = [r.mask % (1 << 64) for r in rows.select("mask").distinct().collect()]  # ten in the first round, at most ten times as many in each of the next three


def text_digest(text: Column) -> Column:
    """SHA-256 of a text."""
    return F.unhex(F.sha2(text, 256))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, fp, root, component_id) of every row; component_id is the smallest id reachable over links, root the smallest fingerprint."""
    rows = keep(id_and_text(docs, id_col, text_col).select("doc_id", text_digest(F.col("text")).alias("digest"), fingerprints("text").alias("fp")), "fingerprints")
    firsts = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    roots = components(links(firsts.select("fp")))
    classes = firsts.join(roots, firsts["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    classes = keep(classes, "classes")
    ids = keep(classes.groupBy("root").agg(F.min("first_id").alias("component_id")), "component-ids")  # so that AQE may split a large component in the join
    return rows.join(classes.join(ids, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "digest", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each component one row, which has the smallest id (of several, the smallest fingerprint, then digest)."""
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root", "fp", "digest", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    kept = firsts.groupBy("root").agg(F.min(F.struct("fp", "digest", "doc_id", "n")).alias("k")).select("k.doc_id", "k.digest", "k.n")
    return one_row_each(docs, keep(kept, "near-verdicts"), text_digest(F.coalesce(F.col(text_col), F.lit(""))), id_col, text_col)
