"""Toxicity by non-negative positive-unlabelled (nnPU) learning.

A linear model over hashed words and word beginnings is fitted in numpy from
confirmed toxic texts (P) and from texts whose label nobody looks at (U). With the
class prior pi the risk that is minimised is

    a * mean_P loss(+1) + c * max(0, mean_U loss(-1) - pi * mean_P loss(-1)) + L1 * |w|

with the logistic loss, a = ``SHARE`` and c = (1 - SHARE) / (1 - pi): toxic texts
are few, so both classes are weighted as if toxic ones had that share. Where the
corrected negative risk falls below zero it isn't followed further down (the
non-negative estimator). Every hashed feature takes part; the L1 term, applied as
a proximal step, leaves weights of no use at zero. The intercept is the log odds of
pi, so a text of which no feature is known is as unlikely toxic as any. pi is the share of toxic rows
among all training labels. P and U are bounded samples of the *labelled* rows
(``POSITIVES``, ``UNLABELLED``; U takes all of them alike), chosen by a hash of
the id, so the fit costs the same at any size; scoring is a narrow map over every
document, with weights of a fixed size as the only thing broadcast.

Defined results: null and empty texts get the score of the intercept; a null id
counts as held out; with no toxic training label, or none whose text is known,
every score is 0; rows that repeat an id are scored each; a null label is no
label; an empty table has no rows; a very long text counts once for each of its
distinct words; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from notelake.llm.common import id_and_text, packed

#: Bounds of the training samples, in rows.
POSITIVES, UNLABELLED = 3_000, 9_000
#: Hashed features; words beginnings of these lengths count besides the words (bytes).
SIZE, BEGINNINGS = 1 << 18, (3, 4, 5, 6, 7)
#: Share that toxic texts count for, weight of the L1 term, epochs and rate of the fit.
SHARE, L1 = 0.5, 5e-4
EPOCHS, RATE = 100, 0.05
#: Features that one step of the fit holds as floats.
CHUNK = 1_000_000
FOLDS, HELD_OUT = 5, 0
#: Words that one worker remembers before it starts anew.
CACHE = 300_000

#: Bytes: A-Z to lower case, other ASCII characters but letters and digits to a space.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def distinct_words(text: str | None) -> set[bytes]:
    return set((text or "").encode().translate(TO_WORDS).split())


def word_features(word: bytes) -> list[int]:
    return [zlib.crc32(word) % SIZE, *(zlib.crc32(word[:n] + b"*") % SIZE for n in BEGINNINGS if len(word) > n)]


def text_features(text: str | None) -> np.ndarray:
    """The distinct features of a text."""
    return np.unique(np.array([f for w in distinct_words(text) for f in word_features(w)], np.int32))


class Rows:
    """Distinct features of texts: all values in one array, and how many each text has."""

    def __init__(self, features: np.ndarray, sizes: np.ndarray):
        self.features, self.sizes, self.n = features, sizes, len(sizes)
        ends = np.cumsum(sizes)
        cuts = np.unique(np.searchsorted(ends, np.arange(CHUNK, int(sizes.sum()), CHUNK)))
        self.parts = [(r[0], r[-1] + 1, int(ends[r[0]] - sizes[r[0]]), int(ends[r[-1]])) for r in np.split(np.arange(self.n), cuts) if len(r)]

    def scores(self, weights: np.ndarray, intercept: float) -> np.ndarray:
        out = np.empty(self.n)
        for i, j, begin, end in self.parts:
            row = np.repeat(np.arange(j - i), self.sizes[i:j])
            out[i:j] = np.bincount(row, weights[self.features[begin:end]], j - i)
        return out + intercept

    def gradient(self, slope: np.ndarray) -> np.ndarray:
        out = np.zeros(SIZE)
        for i, j, begin, end in self.parts:
            out += np.bincount(self.features[begin:end], np.repeat(slope[i:j], self.sizes[i:j]), SIZE)
        return out


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """What the risk grows by per unit of each score. Where the corrected negative risk is below zero: per unit of its opposite alone, so a step brings it back up."""
    c = (1 - SHARE) / (1 - prior)
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    # the loss of z as negative is log(1 + e^z), with slope sigmoid(z); as positive log(1 + e^-z), with slope sigmoid(z) - 1
    slope_u, slope_p = c * sigmoid(zu) / len(zu), -c * prior * sigmoid(zp) / len(zp)
    if negative < 0:
        return -slope_p, -slope_u
    return slope_p + SHARE * (sigmoid(zp) - 1) / len(zp), slope_u


def fit(p: Rows, u: Rows, prior: float) -> tuple[np.ndarray, float]:
    """Weights that minimise the non-negative PU risk, by proximal Adam over all rows, and the intercept that they were fitted with."""
    weights, intercept = np.zeros(SIZE), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(SIZE), np.zeros(SIZE)
    for t in range(1, EPOCHS + 1):
        slope_p, slope_u = slopes(p.scores(weights, intercept), u.scores(weights, intercept), prior)
        g = u.gradient(slope_u) + p.gradient(slope_p)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        rate = RATE / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights = weights - rate * m / (1 - 0.9**t)
        weights = np.sign(weights) * np.maximum(np.abs(weights) - L1 * rate, 0)
    return weights.astype(np.float32), intercept


def held_out(doc_id: Column | str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Fit on training rows (crc32 of the id not in the held-out fold); None if none is confirmed toxic.

    Only the features of the two bounded samples come to the driver.
    """
    docs = id_and_text(docs).filter(~held_out("doc_id"))
    known = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & ~held_out("doc_id"))
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    if not prior:
        return None
    some = lambda ids, most, positive: ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn("positive", F.lit(positive))
    chosen = some(known.filter("toxic = 1"), POSITIVES, True).unionByName(some(known, UNLABELLED, False))
    own = F.pandas_udf(lambda texts: pd.Series([text_features(t) for t in texts]), "array<int>")
    both = chosen.groupBy("doc_id").agg(F.collect_list("positive").alias("sides"))  # a text in both samples is looked at once
    sample = docs.join(F.broadcast(both), "doc_id").select("sides", own("text").alias("f")).toArrow().combine_chunks()
    sides, features = sample.column("sides").to_pylist(), sample.column("f").combine_chunks()

    def rows(positive: bool) -> Rows:
        mine = features.filter(pa.array([positive in s for s in sides], pa.bool_()))
        return Rows(mine.flatten().to_numpy(), mine.value_lengths().to_numpy(zero_copy_only=False))

    p, u = rows(True), rows(False)
    return fit(p, u, min(prior, 0.99)) if p.n and u.n else None


def scorer(spark: SparkSession, model: tuple[np.ndarray, float] | None):
    """A column function: text -> score from 0 to 1."""
    if model is None:
        return lambda text: F.lit(0.0)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, intercept = shared.value
        weights, known = weights.tolist(), {}  # words, with those of their features that have a weight
        for batch in batches:
            out = []
            for text in batch:
                if len(known) > CACHE:
                    known.clear()
                found: set[int] = set()
                for word in distinct_words(text):
                    if (features := known.get(word)) is None:
                        features = known[word] = tuple(f for f in word_features(word) if weights[f])
                    if features:
                        found.update(features)
                out.append(intercept + sum(map(weights.__getitem__, sorted(found))))
            yield pd.Series(sigmoid(np.array(out, np.float64)))

    # the annotations of Iterator make this an iterator-style pandas UDF
    return F.pandas_udf(score, "double")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    score = scorer(docs.sparkSession, train(docs, labels))
    scored = id_and_text(docs).select("doc_id", held_out("doc_id").alias("held_out"), score("text").alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns; nothing is shuffled."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return packed(docs, score=score(F.coalesce("text", F.lit("")))).filter("score < 0.5").select("row.*")
