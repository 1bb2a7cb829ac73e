"""Repeated passages by sparse suffix arrays.

A word of a document counts as repeated if it lies in a window of ``PASSAGE``
consecutive words that stands at another place of the corpus as well (in the same
or another document).

1. Documents are cut into words; a suffix is retained only where its first
   ``GRAM`` words are a minimiser (the smallest hash among the grams of a
   window). Which place that is depends on the window's content alone, so equal
   windows retain equal places: two equal windows have a retained suffix at the
   same offset.
2. Suffixes whose gram occurs once in the corpus can't take part in a repeat and
   go (a count with partial aggregation); the others get their context, as far
   as a window reaches to either side. Equal contexts are one row with a count.
3. Per gram the suffixes are sorted by what follows and neighbours compared. A
   window that begins o words before its suffix needs an extension of
   ``PASSAGE`` - o words to the right: suffixes whose neighbours agree that far
   form a block of the suffix array, and inside a block equal extensions of o
   words to the left make the window repeat. Every o is tried, so the result is
   exact up to collisions of 64-bit hashes of grams and 32-bit hashes of words.
4. A gram with more than ``GROUP`` different contexts is not gathered in a task:
   its windows are spread as rows and counted by hash, which is the same test.

Defined results: null and empty texts, and texts of fewer than ``PASSAGE`` words,
have no repeated words; rows that repeat an id are documents of their own that
share the id, so their words count as repeated; an empty table has no rows; very
long texts are scanned in parts of bounded memory; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import id_and_text, keep

PASSAGE, GRAM = 50, 12
#: Grams of a window, and words that a window reaches beyond a gram, to either side.
WINDOW = PASSAGE - GRAM + 1
REACH = PASSAGE - GRAM
#: Contexts of one gram that one task compares; more are spread as rows.
GROUP = 4_096
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: A row per retained suffix, ``row`` being the SHA-256 of its text; and per document one with ``at`` -1 and the number of words for the gram.
SUFFIX = "row binary, doc_id long, at int, gram long"
CONTEXT = "row binary, at int, first int, last int, gram long, context binary, context_hash long"


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(words: np.ndarray, n: int = GRAM) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        out = out * _STEP + words[k : k + len(out)]
    return _mix(out)


def suffixes(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the retained suffixes, their grams, and the first and last window start that each stands for."""
    grams = gram_hashes(words)
    if len(grams) < WINDOW:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    starts = np.arange(len(grams) - WINDOW + 1)
    at = np.concatenate([starts[i : i + 65536] + np.lib.stride_tricks.sliding_window_view(grams[i : i + 65536 + WINDOW - 1], WINDOW).argmin(axis=1) for i in range(0, len(starts), 65536)])
    edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return at[edge], grams[at[edge]], starts[edge], np.concatenate((starts[edge[1:]] - 1, starts[-1:]))


def _retain(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        ats, grams = [], []
        for text in frame["text"]:
            words = word_hashes(text)
            at, gram, _, _ = suffixes(words)
            ats.append(np.concatenate(([-1], at)))
            grams.append(np.concatenate((np.array([len(words)], np.uint64), gram)))
        sizes = [len(x) for x in ats]
        yield pd.DataFrame({
            "row": np.repeat(frame["row"].to_numpy(object), sizes), "doc_id": frame["doc_id"].astype("Int64").array.repeat(sizes),
            "at": np.concatenate(ats).astype(np.int32), "gram": np.concatenate(grams).view(np.int64),
        })


def _context_table(words: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """32-bit words: REACH to the right of each gram, then REACH to its left, nearest first; 0 beyond what the suffix's windows reach."""
    short = np.concatenate((np.zeros(REACH, np.uint32), (words >> np.uint64(32)).astype(np.uint32) | np.uint32(1), np.zeros(PASSAGE + REACH, np.uint32)))
    ahead = at[:, None] + GRAM + np.arange(REACH)[None, :]
    behind = at[:, None] - 1 - np.arange(REACH)[None, :]
    right, left = short[REACH + ahead], short[REACH + behind]
    right[ahead >= last[:, None] + PASSAGE] = 0
    left[behind < first[:, None]] = 0
    return np.hstack((right, left)).astype(">u4")


def _contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        parts = []
        for row, text, places in zip(frame["row"], frame["text"], frame["places"], strict=True):
            words = word_hashes(text)
            found = suffixes(words)
            wanted = np.isin(found[0], np.asarray(places))
            at, gram, first, last = (x[wanted] for x in found)
            parts.append((np.repeat(np.array([row], object), len(at)), at, first, last, gram, _context_table(words, at, first, last)))
        if not parts:
            continue
        row, at, first, last, gram, table = (np.concatenate(x) for x in zip(*parts, strict=True))
        contexts = [c.tobytes() for c in np.ascontiguousarray(table)]
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(c, g) for g, c in zip(gram.tolist(), contexts, strict=True)), np.uint64, len(contexts))
        yield pd.DataFrame({
            "row": row, "at": at.astype(np.int32), "first": first.astype(np.int32), "last": last.astype(np.int32),
            "gram": gram.view(np.int64), "context": contexts, "context_hash": hashes.view(np.int64),
        })


def _split(contexts) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(b"".join(contexts), ">u4").reshape(-1, 2 * REACH)
    return table[:, :REACH].astype(np.uint32), table[:, REACH:].astype(np.uint32)


def _prefixes(left: np.ndarray) -> np.ndarray:
    """Hashes of the first o words to the left, a column for each o from 0 to REACH."""
    out = np.zeros((len(left), REACH + 1), np.uint64)
    for o in range(REACH):
        out[:, o + 1] = _mix(out[:, o] * _STEP + left[:, o].astype(np.uint64) + np.uint64(1))
    return out


def compare(gram: np.ndarray, contexts, count: np.ndarray) -> np.ndarray:
    """A bit set per context: bit o is set if the window that begins o words before the suffix repeats."""
    right, left = _split(contexts)
    order = np.lexsort((*[right[:, k] for k in reversed(range(REACH))], gram))  # the sparse suffix array
    gram, right, count = gram[order], right[order], count[order]
    same = right[1:] == right[:-1]
    agree = np.where(same.all(axis=1), REACH, same.argmin(axis=1)) + GRAM  # words in which neighbours agree
    agree[gram[1:] != gram[:-1]] = 0
    before, left = _prefixes(left[order]), left[order]
    out = np.zeros(len(order), np.uint64)
    for o in range(REACH + 1):
        need = PASSAGE - o  # words from the suffix on
        block = np.concatenate(([0], np.cumsum(agree < need)))
        whole = (need <= GRAM) | (right[:, max(0, need - GRAM - 1)] != 0)  # the window lies inside the context
        whole &= (o == 0) | (left[:, max(0, o - 1)] != 0)
        key = np.flatnonzero(whole)
        by = np.lexsort((before[key, o], block[key]))
        key = key[by]
        new = np.concatenate(([True], (block[key][1:] != block[key][:-1]) | (before[key, o][1:] != before[key, o][:-1])))[: len(key)]
        group = np.cumsum(new) - 1
        total = np.bincount(group, count[key], group[-1] + 1 if len(group) else 0)
        out[key[total[group] > 1]] |= np.uint64(1 << o)
    back = np.empty_like(out)
    back[order] = out
    return back


def _compare_groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        flat = lambda c: np.concatenate([np.asarray(x) for x in frame[c]])
        sizes = [len(x) for x in frame["hashes"]]
        contexts = [bytes(b) for x in frame["contexts"] for b in x]
        bits = compare(np.repeat(frame["gram"].to_numpy(np.int64), sizes), contexts, flat("counts").astype(float))
        yield pd.DataFrame({"context_hash": flat("hashes").astype(np.int64), "bits": bits.view(np.int64)})


def _window_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per window of a context: (context_hash, o, window, count), window a hash of gram, offset and content."""
    for frame in frames:
        right, left = _split([bytes(b) for b in frame["context"]])
        ahead, back = _prefixes(right), _prefixes(left)
        gram = frame["gram"].to_numpy(np.int64).view(np.uint64)
        for o in range(REACH + 1):
            need = PASSAGE - o - GRAM
            whole = ((need <= 0) | (right[:, max(0, need - 1)] != 0)) & ((o == 0) | (left[:, max(0, o - 1)] != 0))
            window = _mix(_mix(gram * _STEP + ahead[:, need]) * _STEP + back[:, o])
            yield pd.DataFrame({"context_hash": frame["context_hash"][whole], "o": np.full(int(whole.sum()), o, np.int32), "window": window[whole].view(np.int64), "count": frame["count"][whole]})


def _flags(contexts: DataFrame) -> DataFrame:
    """contexts: (gram, context, context_hash, count). Returns (context_hash, bits)."""
    common = keep(contexts.groupBy("gram").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > GROUP).select("gram"), "common-grams")
    # written before it is grouped: a grouping by the join's own key would keep AQE from splitting a common gram in the join
    few = keep(contexts.join(common, "gram", "left_anti"), "few-contexts")
    lists = few.groupBy("gram").agg(F.collect_list(F.struct("context_hash", "context", "count")).alias("l"))
    lists = lists.select("gram", F.col("l.context_hash").alias("hashes"), F.col("l.context").alias("contexts"), F.col("l.count").alias("counts"))
    near = lists.mapInPandas(_compare_groups, "context_hash long, bits long")
    if common.isEmpty():
        return near
    rows = contexts.join(common, "gram").mapInPandas(_window_rows, "context_hash long, o int, window long, count long")
    often = keep(rows.groupBy("o", "window").agg(F.sum("count").alias("n")).filter("n > 1").select("o", "window"), "repeated-windows")  # so that AQE may split the join
    far = rows.join(often, ["o", "window"]).groupBy("context_hash").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("o"))).alias("bits"))
    return near.unionByName(far)


def _spans(first: int, last: int, at: int, bits: int) -> list[tuple[int, int]]:
    """Word spans of the repeated windows that a suffix stands for."""
    starts = [s for s in range(first, last + 1) if bits >> (at - s) & 1]
    out: list[tuple[int, int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], s + PASSAGE)
        else:
            out.append((s, s + PASSAGE))
    return out


def _merge_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for hits in frame["hits"]:
            merged: list[list[int]] = []
            for h in sorted(hits, key=lambda h: h["at"]):
                for s, e in _spans(h["first"], h["last"], h["at"], h["bits"] % (1 << 64)):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([s, e])
            out.append([{"start": s, "end": e} for s, e in merged])
        yield pd.DataFrame({"row": frame["row"], "spans": out})


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, spans) of every row: merged word spans (start, end exclusive) of its repeated windows."""
    texts = id_and_text(docs, id_col, text_col).withColumn("row", F.unhex(F.sha2("text", 256)))
    retained = keep(texts.mapInPandas(_retain, SUFFIX), "suffixes")
    # equal texts are one row from here on, read from the document of the smallest id
    facts = retained.filter("at < 0").select("row", "doc_id", F.col("gram").alias("n_words"))
    known = F.coalesce("doc_id", F.lit(-1))
    rows = facts.groupBy("row").agg(F.count(F.lit(1)).alias("copies"), F.min(known).alias("reader"))
    places = retained.filter("at >= 0").select("row", "at", "gram").distinct()
    again = keep(places.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "repeated-grams")  # so that AQE may split the join
    places = places.join(again, "gram", "left_semi").groupBy("row").agg(F.collect_list("at").alias("places"))
    places = keep(places.join(rows, "row").select("row", F.col("reader").alias("doc_id"), "places"), "places")
    read = texts.select("row", known.alias("doc_id"), "text").join(places, ["row", "doc_id"]).select("row", "text", "places")
    contexts = keep(read.mapInPandas(_contexts, CONTEXT), "contexts")
    distinct = contexts.groupBy("gram", "context_hash", "context").agg(F.count(F.lit(1)).alias("count"))
    flags = keep(_flags(keep(distinct, "distinct-contexts")).filter("bits <> 0"), "flags")
    hits = contexts.join(flags, "context_hash").groupBy("row").agg(F.collect_list(F.struct("at", "first", "last", "bits")).alias("hits"))
    spans = hits.mapInPandas(_merge_rows, "row binary, spans array<struct<start:long,end:long>>")
    verdicts = keep(rows.join(spans, "row", "left").select("row", "copies", "spans"), "verdicts")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    found = F.when((F.col("copies") > 1) & (F.col("n_words") >= PASSAGE), whole).otherwise(F.coalesce("spans", none))
    return facts.join(verdicts, "row").select("doc_id", "n_words", found.alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_repeated, n_spans, spans), spans as start:end joined by commas."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", n.alias("n_repeated"), F.size("spans").cast("long").alias("n_spans"), text.alias("spans"))
