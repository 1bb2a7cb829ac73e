"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered
thresholds cut the score into grades: P(grade <= k) = sigmoid(threshold_k - w.x).
From it come the expected grade and the tail probability P(grade >= ``CUT``) by
which documents are selected. The grades are the distinct values of the rating
column. The fit takes a bounded sample of rated rows (``RATED``, chosen by a hash
of the id, so the same at any size); scoring is a narrow map, and weights of a
fixed size are the only thing broadcast.

Features of a text: its distinct words, the shapes of neighbouring words
(letters, capitals, digits, punctuation), and the buckets of a few shares (words
that repeat their neighbour, repeated lines, capitals, lone punctuation) and of
the length.

Defined results: null and empty texts have their own bucket features only; with
fewer than two grades among the ratings every expected grade is that grade (0 if
there is none); null ratings count as none; of ratings that share an id the
lowest counts; rows that repeat an id, or have none, are scored each; an empty
table has no rows; a very long text counts once for each of its distinct
features; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.common import id_and_text

#: Bound of the training sample, in rows.
RATED = 8_000
#: Hashed features, fit settings.
SIZE = 1 << 18
EPOCHS, RATE, DECAY = 150, 0.05, 1e-3
#: Words whose features one worker remembers before it starts anew.
CACHE = 300_000
#: Rows whose labels may be learned: as for every classifier here, not the held-out fold.
FOLDS, HELD_OUT = 5, 0

_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+"), re.compile(r"\d+")


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) % SIZE


def _shape(word: str) -> str:
    return _DIGIT.sub("9", _LOWER.sub("a", _UPPER.sub("A", word)))[:6]


def _bucket(name: str, share: float) -> int:
    return _hash(f"{name}={min(9, int(share * 10))}")


class Features:
    """Features of texts, with a bounded memory of words."""

    def __init__(self):
        self.words: dict[str, tuple[int, str]] = {}

    def _word(self, word: str) -> tuple[int, str]:
        if len(self.words) > CACHE:
            self.words.clear()
        found = self.words[word] = (_hash("w " + word.lower()), _shape(word))
        return found

    def of(self, text: str | None) -> np.ndarray:
        text = text or ""
        words = text.split()
        n = max(1, len(words))
        known = self.words
        distinct = {w: known.get(w) or self._word(w) for w in set(words)}
        shapes = [distinct[w][1] for w in words]
        out = {h for h, _ in distinct.values()}
        out |= {_hash(f"s {a} {b}") for a, b in set(zip(shapes, shapes[1:], strict=False))}
        lines = text.split("\n")
        out |= {
            _bucket("repeat", sum(map(str.__eq__, words, words[1:])) / n),
            _bucket("distinct", len(distinct) / n),
            _bucket("lines", 1 - len(set(lines)) / len(lines)),
            _bucket("capital", sum(s.startswith("AA") or s.strip("!.,?") == "A" for s in shapes) / n),
            _bucket("lone", sum("a" not in s and "A" not in s for s in shapes) / n),
            _bucket("upper", sum(map(str.isupper, words)) / n),
            _hash(f"length={len(words).bit_length()}"),
        }
        return np.fromiter(out, np.int32, len(out))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Shared weights and ordered thresholds over the grades."""

    def __init__(self, grades: list[float], weights: np.ndarray, thresholds: np.ndarray):
        self.grades, self.weights, self.thresholds = grades, weights, thresholds

    def chances(self, score: np.ndarray) -> np.ndarray:
        """P(grade) of each score, a column per grade."""
        below = _sigmoid(self.thresholds[None, :] - score[:, None])
        return np.diff(np.hstack((np.zeros((len(score), 1)), below, np.ones((len(score), 1)))), axis=1)


def thresholds_of(cut: np.ndarray) -> np.ndarray:
    """Ordered thresholds from the first one and the logarithms of the gaps after it."""
    return np.cumsum(np.concatenate((cut[:1], np.exp(cut[1:]))))


def slopes(score: np.ndarray, y: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How the mean negative log likelihood of grades ``y`` grows by each score and by each entry of ``cut``."""
    n, rows = len(score), np.arange(len(score))
    below = np.hstack((np.zeros((n, 1)), _sigmoid(thresholds_of(cut)[None, :] - score[:, None]), np.ones((n, 1))))
    slope = below * (1 - below)  # d below / d threshold, also -d below / d score
    chance = np.maximum(below[rows, y + 1] - below[rows, y], 1e-9)
    high, low = slope[rows, y + 1] / chance / n, slope[rows, y] / chance / n
    by_threshold = np.bincount(y, low, len(cut) + 2) - np.bincount(y + 1, high, len(cut) + 2)
    later = np.cumsum(by_threshold[1 : len(cut) + 1][::-1])[::-1]  # a gap moves its threshold and all later ones
    return high - low, np.concatenate((later[:1], later[1:] * np.exp(cut[1:])))


def fit(features: np.ndarray, sizes: np.ndarray, ratings: np.ndarray) -> Model:
    """Maximum likelihood with weight decay, by Adam over all rows. ``features``: those of all texts, one after the other; ``sizes``: how many each has."""
    grades = sorted(set(ratings.tolist()))
    if len(grades) < 2:
        return Model(grades or [0.0], np.zeros(SIZE, np.float32), np.zeros(0))
    y, n, k = np.searchsorted(grades, ratings), len(sizes), len(grades) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), sizes)
    share = np.clip([(y <= j).mean() for j in range(k)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    cut = np.concatenate((first[:1], np.log(np.maximum(np.diff(first), 1e-3))))
    weights, m, v = np.zeros(SIZE), np.zeros(SIZE + k), np.zeros(SIZE + k)
    for t in range(1, EPOCHS + 1):
        by_score, by_cut = slopes(np.bincount(row, weights[features], n), y, cut)
        g = np.append(np.bincount(features, by_score[row], SIZE) + DECAY * weights, by_cut)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights, cut = weights - step[:SIZE], cut - step[SIZE:]
    return Model(grades, weights.astype(np.float32), thresholds_of(cut))


def train(docs: DataFrame, ratings: DataFrame, rating: str) -> Model:
    """ratings: doc_id and the rating column; only rows outside the held-out fold are learned."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT
    rated = ratings.select("doc_id", F.col(rating).cast("double").alias("rating")).filter(F.col("rating").isNotNull() & ~held)
    rated = rated.groupBy("doc_id").agg(F.min("rating").alias("rating")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(RATED)
    own_features = Features()
    own = F.pandas_udf(lambda texts: pd.Series([own_features.of(t) for t in texts]), "array<int>")
    rows = id_and_text(docs).join(F.broadcast(rated), "doc_id").select("rating", own("text").alias("f")).toArrow().combine_chunks()
    lists = rows.column("f").combine_chunks()
    return fit(lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False), rows.column("rating").to_numpy())


def rate(docs: DataFrame, model: Model, cut: float) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, selected) of every document; the tail is P(grade >= cut)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, features = shared.value, Features()
        for batch in batches:
            yield pd.Series([float(model.weights[features.of(t)].sum()) for t in batch])

    def expected(scores: pd.Series) -> pd.DataFrame:
        chances, grades = shared.value.chances(scores.to_numpy(float)), np.array(shared.value.grades)
        return pd.DataFrame({"grade": chances @ grades, "tail": chances[:, grades >= cut].sum(axis=1)})

    scored = id_and_text(docs).select("doc_id", F.pandas_udf(score, "double")("text").alias("score"))
    out = scored.select("doc_id", F.pandas_udf(expected, "grade double, tail double")("score").alias("e"))
    return out.select("doc_id", F.col("e.grade").alias("expected_grade"), F.col("e.tail").alias("tail_probability"), (F.col("e.tail") >= 0.5).alias("selected"))
