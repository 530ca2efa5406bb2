"""Quality by ordinal cumulative-link regression on graded ratings.

A text is a vector of hashed words, as they stand and in lower case, of the
first six letters of longer words, of pairs of token shapes (small, capital, all
capitals, digit, sign: 25 pairs) and of a few surface shares; which words stand
side by side isn't seen beyond their shapes.  All grades share one weight
vector; ordered thresholds cut the weighted sum, so
P(grade > j) = sigmoid(w x - t_j) with t_0 < t_1 < ...  The thresholds are kept
in order by training the first and the logarithms of the gaps.  Each grade has
the same weight in training, however many texts have it, so tails are chances
where grades are equally frequent.  The model gives the expected grade and the
chance of each tail, by which texts are selected.

Training takes at most ``TRAIN_DOCS`` labelled keys (those of least hash), as
far as their whole texts hold ``_shared.TRAIN_BYTES`` together; scoring reads
all words of every text.

Defined cases: null text is empty text, which has the offset's grade; rows of
null grade or null key are not learned from, nor keys with several texts or
several grades; repeated rows are learned from once and scored each; grades may
be any integers and are ranked; with one grade or none every text has it (or
null); an empty table gives no row; other columns are kept and columns named
like the results replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import add
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import pieces, small_batches, table, texts, training_rows

TRAIN_DOCS = 6000
BITS = 16
EPOCHS = 300
PENALTY = 1e-4
SURFACE = 8
PREFIX = 6
TOKENS = re.compile(r"\w+|[^\w\s]+").findall


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values: shares of hashed token shapes, and surface shares."""
    tokens = TOKENS(text)
    n = len(tokens) or 1
    counts = Counter(tokens)
    kinds: dict[int, int] = {}
    shapes, of, signs = {}, dict.fromkeys("UTl0s", 0), 0
    for token, times in counts.items():
        first = token[0]
        if first.isalpha():
            shape = "l" if first.islower() else "U" if token.isupper() and len(token) > 1 else "T"
        elif first.isdigit():
            shape = "0"
        else:
            shape, signs = "s", signs + len(token) * times
        shapes[token] = shape
        of[shape] += times
        bucket = crc32(token.encode()) >> 32 - BITS
        kinds[bucket] = kinds.get(bucket, 0) + times
    order = "".join(map(shapes.__getitem__, tokens))
    for pair, times in Counter(map(add, order, order[1:])).items():
        bucket = crc32(pair.encode(), 1) >> 32 - BITS
        kinds[bucket] = kinds.get(bucket, 0) + times
    low: dict[int, int] = {}
    for token, times in Counter(map(str.lower, tokens)).items():
        parts = (token, token[:PREFIX]) if len(token) > PREFIX else (token,)
        for seed, part in enumerate(parts, 2):
            bucket = crc32(part.encode(), seed) >> 32 - BITS
            low[bucket] = low.get(bucket, 0) + times
    lines = text.split("\n")
    chars = len(text) or 1
    surface = [
        of["U"] / n,
        of["s"] / n,
        signs / chars,
        1 - len(counts) / n,
        1 - len(set(lines)) / len(lines),
        of["0"] / n,
        min(1.0, math.log1p(len(tokens)) / 10),
        0.0 if tokens else 1.0,
    ]
    buckets = np.array([*kinds, *low, *range(1 << BITS, (1 << BITS) + SURFACE)], np.int64)
    values = np.array([*kinds.values(), *low.values(), *surface], np.float64)
    values[: len(kinds)] = np.sqrt(values[: len(kinds)] / n)
    # by presence more than by share: a word that tells may stand once in a long text
    part = slice(len(kinds), len(kinds) + len(low))
    values[part] = np.sqrt(np.minimum(values[part], 3) / (len(low) + 1))
    return buckets, values


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Ordinal:
    grades: list[int]
    weights: np.ndarray
    cuts: np.ndarray  # ascending, one fewer than grades

    def tails(self, text: str) -> np.ndarray:
        """P(grade > j-th) for all but the last grade."""
        buckets, values = features(text)
        return _sigmoid(self.weights[buckets] @ values - self.cuts)


@dataclass
class Sample:
    """Training texts as one sparse matrix."""

    rows: np.ndarray
    place: np.ndarray
    values: np.ndarray
    y: np.ndarray
    weight: np.ndarray  # of each text, one on average


def cuts_of(base: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    return np.concatenate([base, base + np.cumsum(np.exp(gaps))])


def objective(params: list[np.ndarray], sample: Sample) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood with the penalty, and its slopes in the
    weights, the first threshold and the logarithms of the gaps."""
    w, base, gaps = params
    y, at, n = sample.y, np.arange(len(sample.y)), len(sample.y)
    cuts = cuts_of(base, gaps)
    tail = _sigmoid(np.bincount(sample.rows, sample.values * w[sample.place], n)[:, None] - cuts)
    # P(y = j) = tail[j-1] - tail[j]; slope of its logarithm in the sum and in the cuts
    wide = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
    chance = np.maximum(wide[at, y] - wide[at, y + 1], 1e-12)
    loss = -(sample.weight * np.log(chance)).mean() + PENALTY * (w @ w) / 2
    bend = wide * (1 - wide)
    upper, lower = sample.weight * bend[at, y] / chance, sample.weight * bend[at, y + 1] / chance
    dcuts = np.zeros((n, len(cuts) + 2))
    dcuts[at, y] += upper
    dcuts[at, y + 1] -= lower
    dcuts = dcuts[:, 1:-1].sum(0) / n
    dgaps = np.array([dcuts[j + 1 :].sum() * np.exp(gaps[j]) for j in range(len(gaps))])
    dz = (lower - upper) / n
    return loss, [np.bincount(sample.place, sample.values * dz[sample.rows], len(w)) + PENALTY * w, np.array([dcuts.sum()]), dgaps]


def train(samples: list[tuple[str, int]]) -> Ordinal | None:
    """Adam on the whole sample."""
    grades = sorted({g for _, g in samples})
    size = (1 << BITS) + SURFACE
    if len(grades) < 2:
        return Ordinal(grades, np.zeros(size), np.zeros(0)) if grades else None
    y = np.array([grades.index(g) for _, g in samples])
    parts = [features(t) for t, _ in samples]
    rows = np.repeat(np.arange(len(y)), [len(b) for b, _ in parts])
    used, place = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True)
    weight = len(y) / (len(grades) * np.bincount(y))
    sample = Sample(rows, place, np.concatenate([v for _, v in parts]), y, weight[y])
    start = -np.log([(len(grades) - j) / j for j in range(1, len(grades))])
    params = [np.zeros(len(used)), start[:1].copy(), np.log(np.maximum(np.diff(start), 0.1))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, EPOCHS + 1):
        for p, g, a, b in zip(params, objective(params, sample)[1], first, second, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    w, base, gaps = params
    weights = np.zeros(size)
    weights[used] = w
    return Ordinal(grades, weights, cuts_of(base, gaps))


def fit(docs: DataFrame, graded: DataFrame, text: str = "text", grade: str = "grade", key: str = "doc_id", limit: int = TRAIN_DOCS) -> Ordinal | None:
    """Train on at most ``limit`` graded rows, taken by the hash of ``key``."""
    return train([(t, int(y)) for t, y in training_rows(docs, graded, key, text, grade, limit)])


def predict(docs: DataFrame, model: Ordinal | None, column: str = "text") -> DataFrame:
    """``docs`` with ``expected_grade`` and ``tails``, P(grade > j) in order."""
    small_batches(docs.sparkSession)
    docs = docs.drop("expected_grade", "tails")
    place = docs.columns.index(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("expected_grade", T.DoubleType()), T.StructField("tails", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        steps = np.diff(model.grades) if model else []
        for batch in pieces(batches):
            tails = [model.tails(t) if model else np.zeros(0) for t in texts(batch.column(place))]
            grades = [float(model.grades[0] + t @ steps) if model else None for t in tails]
            new = [pa.array(grades, pa.float64()), pa.array([t.tolist() for t in tails], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "expected_grade", "tails"])

    return docs.mapInArrow(run, schema)


SELECT_TAIL = 0.5


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Grades where both ratings are known, or quality is 0: 0 low quality, 1
    good but toxic, 2 good and not; selected by the chance of a grade over 0."""
    from .language import held_out

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rated = table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    good = F.col("quality") == 1
    grade = F.when(F.col("quality") == 0, 0).when(good & (F.col("toxic") == 1), 1).when(good & (F.col("toxic") == 0), 2)
    model = fit(docs, rated.where(~held_out("doc_id", 5, 3)).select("doc_id", grade.alias("grade")))
    found = predict(docs, model).drop("text")
    tail = F.coalesce(F.get("tails", F.lit(0)), F.lit(1.0))
    return found.select("doc_id", held_out("doc_id", 5, 3).alias("held_out"), "expected_grade", tail.alias("tail_over_0"), F.coalesce(F.get("tails", F.lit(1)), F.lit(0.0)).alias("tail_over_1"), (tail >= SELECT_TAIL).alias("selected"))
