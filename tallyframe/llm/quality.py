"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Every text becomes some twenty statistics that do not depend on its language. Cosines of random projections of them
approximate a Gaussian kernel, so a linear fit in them is a kernel ridge regression. The fit needs only the normal
equations, which every partition sums over its labelled rows and which are added up in a tree; no row leaves its task.
They are kept by fold, so that a model without a fold is a difference of sums: the penalty is chosen, and the scores are
calibrated, on rows that the model at hand has not seen. Calibration is isotonic regression over bins of raw scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import ship, stage, text_of
from .language import held_out

FEATURES = 256
BANDWIDTH = 1.5  # of the kernel, times the root of the number of statistics, in standard deviations
SEED = 20_011
FOLDS = 3
PENALTIES = (1e-4, 1e-3, 1e-2, 1e-1, 1.0)  # for each labelled row
BINS = 2048  # for one unit of raw score; raw scores are cut to LOW..HIGH first
LOW, HIGH = -1.0, 2.0
ACCEPT = 0.7
FAN_IN = 16
LAST = 4  # so many sums of normal equations reach the driver

STATISTICS = (
    "bytes", "words", "letters", "upper", "digits", "blanks", "ends", "marks", "bars", "word_length", "word_spread", "distinct", "distinct_pairs", "most_frequent",
    "repeated_next", "ended_words", "marked_words", "line_words", "repeated_lines", "longest_word",
)
_CLASS = np.zeros(256, np.int64)  # of a byte: 0 other marks, 1 letters, 2 capitals, 3 digits, 4 blanks, 5 ends of sentences, 6 bars
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 1 if _b >= 128 or _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 4 if _c in " \t\n\x0b\x0c\r" else 5 if _c in ".,;:!?" else 6 if _c in "|<>{}[]=\\/_" else 0
_ENDS = tuple(bytes([c]) for c in b".,;:!?")


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a text in UTF-8; zeros where there is nothing to measure."""
    raw = np.frombuffer(text, np.uint8)
    n = max(1, len(raw))
    kinds = np.bincount(_CLASS[raw], minlength=7) / n
    words = text.split()
    w = len(words)
    if not w:
        return [math.log1p(len(raw)), 0.0, *kinds[[1, 2, 3, 4, 5, 0, 6]].tolist(), *[0.0] * 11]
    lengths = np.fromiter(map(len, words), np.int64, w)
    counted = Counter(words)
    lines = [line for line in text.split(b"\n") if line.strip()]
    # Distinct words grow with about a root of the length; logarithms make texts of all lengths alike.
    grown = lambda k, total: math.log(k + 1) / math.log(total + 1)
    return [
        math.log1p(len(raw)), math.log1p(w), *kinds[[1, 2, 3, 4, 5, 0, 6]].tolist(), float(lengths.mean()), float(lengths.std()), grown(len(counted), w), grown(len(set(zip(words, words[1:]))), w),
        max(counted.values()) / w, sum(map(eq, words, words[1:])) / w, sum(x.endswith(_ENDS) for x in words) / w, sum(not x[-1:].isalnum() and x[-1] < 128 and not x.endswith(_ENDS) for x in words) / w,
        math.log1p(w / len(lines)), 1 - len(set(lines)) / len(lines), math.log1p(int(lengths.max())),
    ]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and stats (in the order of STATISTICS) per row of `docs` (doc_id, text; null: empty), already written."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(t.as_py()) for t in batch.column("text").cast(pa.binary())], np.float64).reshape(-1, len(STATISTICS))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(STATISTICS), pa.int32()), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "stats"])

    ship(docs.sparkSession)
    inner = docs.select("doc_id", text_of().alias("text"))
    return stage(inner.mapInArrow(measure, inner.drop("text").schema.add("stats", ArrayType(DoubleType()))), "statistics")


@dataclass
class Fourier:
    """Random Fourier features of standardised statistics, and a constant."""

    mean: np.ndarray
    scale: np.ndarray

    def __post_init__(self):
        draw = np.random.default_rng(SEED)
        d = len(self.mean)
        self.omega = draw.normal(size=(d, FEATURES)) / (BANDWIDTH * math.sqrt(d))
        self.phase = draw.uniform(0, 2 * np.pi, FEATURES)

    def of(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([math.sqrt(2 / FEATURES) * np.cos(z @ self.omega + self.phase), np.ones((len(z), 1))], axis=1)


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


def fourier(rows: DataFrame) -> Fourier:
    """Features standardised over all `rows` (stats)."""
    each = [F.element_at("stats", i + 1) for i in range(len(STATISTICS))]
    found = rows.agg(*[F.avg(x) for x in each], *[F.stddev_pop(x) for x in each]).first()
    mean, spread = (np.array([x or 0.0 for x in part]) for part in (found[: len(each)], found[len(each) :]))
    return Fourier(mean, np.where(spread > 1e-9, spread, 1.0))


def normal_equations(labelled: DataFrame, features: Fourier) -> np.ndarray:
    """For each fold the sums of z'z, z'y, y'y and the number of rows over `labelled` (stats, y, fold), as one square matrix: z then y.

    A partition sends one matrix a fold; they are added FAN_IN at a time until LAST are left, which the driver adds.
    """
    size = FEATURES + 2

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size, size))
        seen = False
        for batch in batches:
            seen = seen or batch.num_rows > 0
            z = np.concatenate([features.of(_stats(batch)), batch.column("y").to_numpy()[:, None]], axis=1)
            fold = batch.column("fold").to_numpy()
            for f in range(FOLDS):
                sums[f] += z[fold == f].T @ z[fold == f]
        if seen:
            yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((FOLDS, size, size))
        for batch in batches:
            for s in batch.column("sums"):
                sums += np.frombuffer(s.as_py()).reshape(sums.shape)
        yield pa.RecordBatch.from_pydict({"sums": [sums.tobytes()]})

    ship(labelled.sparkSession)
    parts, left = labelled.mapInArrow(summed, "sums binary"), int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while left > LAST:
        left = max(LAST, left // FAN_IN)
        parts = parts.repartition(left).mapInArrow(added, "sums binary")
    total = np.zeros((FOLDS, size, size))
    for r in parts.collect():
        total += np.frombuffer(r.sums).reshape(total.shape)
    return total


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    """Weights of the features and the constant (which is not shrunk) from normal equations as above."""
    a, b = sums[:-1, :-1], sums[:-1, -1]
    shrink = penalty * max(1.0, a[-1, -1]) * np.eye(len(a)) / FEATURES
    shrink[-1, -1] = 1e-9
    return np.linalg.solve(a + shrink, b)


def isotonic(at: np.ndarray, ones: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best rising fit of ones / number over `at` (ascending): the middle of each level and the level."""
    levels: list[list[float]] = []  # sum of at, ones, number
    for x, one, n in zip(at, ones, number):
        levels.append([x * n, one, n])
        while len(levels) > 1 and levels[-2][1] * levels[-1][2] >= levels[-1][1] * levels[-2][2]:
            last = levels.pop()
            levels[-1] = [p + q for p, q in zip(levels[-1], last)]
    found = np.array(levels)
    return found[:, 0] / found[:, 2], found[:, 1] / found[:, 2]


@dataclass
class Model:
    features: Fourier
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.features.of(stats) @ self.weights, self.at, self.level)


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """stats, y and fold of the rows that may be learned from: not held out, with a quality label (several: their mean)."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    return rows.filter(~held_out()).join(marks, "doc_id").select("stats", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


def train(rows: DataFrame, labels: DataFrame) -> Model | None:
    """A model from `measured` rows and labels (doc_id, quality: 0 or 1), learned from every labelled row that is not held out; None where there is none."""
    known = stage(labelled(rows, labels), "labelled")
    features = fourier(rows)
    sums = normal_equations(known, features)
    whole = sums.sum(axis=0)
    if whole[-2, -2] == 0:
        return None

    def missed(penalty: float) -> float:
        """The squared error on the folds, each by a model of the others."""
        left = [(s, np.append(ridge(whole - s, penalty), -1.0)) for s in sums]
        return sum(float(w @ s @ w) for s, w in left)

    penalty = min(PENALTIES, key=missed)
    without = np.array([ridge(whole - s, penalty) for s in sums])

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.einsum("ij,ij->i", features.of(_stats(batch)), without[batch.column("fold").to_numpy()])
            places = np.round((np.clip(score, LOW, HIGH) - LOW) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(places), batch.column("y")], ["bin", "y"])

    # At most (HIGH - LOW) * BINS + 1 rows.
    bins = known.mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.sum("y").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()
    at, level = isotonic(np.array([r.bin / BINS + LOW for r in bins]), np.array([r.ones for r in bins]), np.array([float(r.n) for r in bins]))
    return Model(features, ridge(whole, penalty), at, level)


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """`measured` rows with score, 0 to 1; 0.5 for all without a model."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(_stats(batch)) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    ship(rows.sparkSession)
    return rows.mapInArrow(score, rows.drop("stats").schema.add("score", "double"))


def predicted(score: Column) -> Column:
    return (score >= ACCEPT).cast("int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from ACCEPT on) for every row of `docs` (doc_id, text).

    Null texts are empty and scored as such. Repeated rows are scored alike and learned from as often as they are there.
    Without labels to learn from all scores are 0.5; no documents give no rows.
    """
    rows = measured(docs)
    return scored(rows, train(rows, labels)).select("doc_id", held_out().alias("held_out"), "score", predicted(F.col("score")).alias("predicted"))
