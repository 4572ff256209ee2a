"""Language identification by string kernels.

The kernel of two texts is the number of character n-grams of length 1 to 4 that both contain (presence, not counts),
all lengths blended, over the root of the product of their own numbers: a blended-spectrum presence kernel. It is
approximated by the Nystroem method over landmark texts, and one ridge regression per language, against the rest, is
fitted in that space. A text is scored in batches: a presence matrix times the grams of the landmarks times the fitted
weights. n-grams are hashed into a fixed number of columns.

The fit takes a bounded sample of labelled rows (TRAIN_PER_LANGUAGE of each language, by a hash of their ids) and their
whole texts; scoring takes every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import give_back, ship, stage

COLUMNS = 1 << 14
LENGTHS = 4
TRAIN_PER_LANGUAGE = 300
TRAIN_ROWS = 4000
LANDMARKS_PER_LANGUAGE = 48
RIDGE = 1e-3
SHARPNESS = 3.0
TEXTS_AT_ONCE = 128
CHARACTERS_AT_ONCE = 1 << 20
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_STEP = np.uint32(0x9E3779B1)  # an odd multiplier, from the golden ratio


def grams(text: str) -> np.ndarray:
    """The distinct columns of the n-grams of a text: lower case, runs of anything but letters as one space, a space at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(COLUMNS, bool)
    for start in range(0, len(codes), CHARACTERS_AT_ONCE):
        part = codes[max(0, start - LENGTHS + 1) : start + CHARACTERS_AT_ONCE]
        part = np.where(_letters(part), part, np.uint32(32))
        keep = np.ones(len(part), bool)
        keep[1:] = (part[1:] != 32) | (part[:-1] != 32)
        part = part[keep]
        h = np.zeros(len(part), np.uint32)
        for n in range(1, LENGTHS + 1):
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * _STEP
            h ^= h >> np.uint32(15)
            seen[(h + np.uint32(n)) & np.uint32(COLUMNS - 1)] = True
    return np.flatnonzero(seen)


_ALPHABETIC = np.zeros(0x110000, bool)


def _letters(codes: np.ndarray) -> np.ndarray:
    if not _ALPHABETIC[97]:
        _ALPHABETIC[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return _ALPHABETIC[codes]


def presence(texts: list[np.ndarray]) -> np.ndarray:
    """A row of unit length for each text's `grams`, so that products of rows are kernels."""
    x = np.zeros((len(texts), COLUMNS), np.float32)
    for i, columns in enumerate(texts):
        x[i, columns] = 1 / np.sqrt(max(1, len(columns)))
    return x


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # landmarks x COLUMNS
    weights: np.ndarray  # landmarks x languages: whitening of the landmarks' kernel times the ridge solution
    bias: np.ndarray

    def scorer(self) -> Scorer:
        """What tasks need. A presence matrix times the landmarks, times the weights, is the same as times their product."""
        return Scorer(self.languages, np.ascontiguousarray(self.landmarks.T @ self.weights), self.bias)


@dataclass
class Scorer:
    languages: list[str]
    projected: np.ndarray
    bias: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        batches = (presence([grams(t) for t in texts[i : i + TEXTS_AT_ONCE]]) for i in range(0, len(texts), TEXTS_AT_ONCE))
        return np.concatenate([x @ self.projected + self.bias for x in batches])


def fit(texts: list[np.ndarray], labels: list[str]) -> Model:
    """texts: the `grams` of each, in a fixed order; the first of each language are its landmarks."""
    languages = sorted(set(labels))
    taken: dict[str, int] = {}
    marks = []
    for i, lang in enumerate(labels):
        taken[lang] = taken.get(lang, 0) + 1
        if taken[lang] <= LANDMARKS_PER_LANGUAGE:
            marks.append(i)
    z = presence([texts[i] for i in marks])
    values, vectors = np.linalg.eigh((z @ z.T).astype(np.float64))
    white = vectors / np.sqrt(np.maximum(values, 1e-6))
    features = np.concatenate([presence(texts[i : i + TEXTS_AT_ONCE]) @ z.T for i in range(0, len(texts), TEXTS_AT_ONCE)]).astype(np.float64) @ white
    targets = np.array([[1.0 if lang == k else -1.0 for k in languages] for lang in labels])
    # Each row counts by the inverse of its language's number of rows, so rare languages are fitted as well as others.
    weight = np.array([len(labels) / len(languages) / labels.count(lang) for lang in labels])[:, None]
    design = np.concatenate([features, np.ones((len(labels), 1))], axis=1)
    penalty = RIDGE * len(labels) * np.eye(design.shape[1])
    penalty[-1, -1] = 1e-9
    solved = np.linalg.solve(design.T @ (weight * design) + penalty, design.T @ (weight * targets))
    return Model(languages, z, (white @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32))


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame) -> Model | None:
    """A model from labelled rows that are not held out; None where there are none.

    Every language is learned that has such a row with a letter. At most TRAIN_PER_LANGUAGE rows of each, and TRAIN_ROWS
    in all but for one of each, are chosen by a hash of their ids; of repeated ids any one row is read. The driver gets
    one bit for each of COLUMNS n-gram columns of their texts, whatever their length.
    """
    labelled = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
    lettered = stage(labelled.select("lang", "doc_id"), "lettered")
    counted = stage(lettered.groupBy("lang").agg(F.count("*").alias("rows")), "languages")
    languages = counted.count()
    if not languages:
        return None
    each = min(TRAIN_PER_LANGUAGE, max(1, TRAIN_ROWS // languages))
    # Rows with a low hash are enough to choose from: some four times as many as are wanted meet in the window.
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = lettered.join(counted, "lang").select("lang", "doc_id", "rows", lot.alias("lot")).filter(F.col("lot") * F.col("rows") < 4.0 * each)
    chosen = drawn.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("lot", "doc_id"))).filter(F.col("n") <= each).select("lang", "doc_id").distinct()
    ship(docs.sparkSession)
    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
    bits = F.udf(lambda text: np.packbits(np.isin(np.arange(COLUMNS), grams(text))).tobytes(), BinaryType(), useArrow=True)
    sample = rows.select("doc_id", "lang", bits("text").alias("grams")).groupBy("doc_id", "lang").agg(F.min("grams").alias("grams")).orderBy(F.xxhash64("doc_id"), "doc_id", "lang").collect()
    return fit([np.flatnonzero(np.unpackbits(np.frombuffer(r.grams, np.uint8))) for r in sample], [r.lang for r in sample]) if sample else None


def predict(docs: DataFrame, model: Model | None, name: str = "_language") -> DataFrame:
    """docs with a struct column `name` of lang_pred and score (0 to 1). Null texts, texts without a letter and all texts without a model are `und`, with score 0."""

    ship(docs.sparkSession)
    scorer = model.scorer() if model else None

    @F.pandas_udf("lang_pred string, score double")
    def classified(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            usable = np.array([t is not None and scorer is not None and bool(_LETTER.search(t)) for t in texts], bool)
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if usable.any():
                s = SHARPNESS * scorer.scores([t for t, u in zip(texts, usable) if u]).astype(np.float64)
                likely = np.exp(s - s.max(axis=1, keepdims=True))
                likely /= likely.sum(axis=1, keepdims=True)
                lang[usable] = np.array(scorer.languages, object)[likely.argmax(axis=1)]
                score[usable] = likely.max(axis=1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})
        give_back()

    # Called so, a filter on the result does not score the texts a second time.
    return docs.withColumn(name, classified.asNondeterministic()(F.col("text")))


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all their columns, whose language can be told; where lang is null it becomes the language told.

    Rejected are texts that the model finds no language for: null, empty and white texts and those without a letter. The
    model is learned from `docs` itself; where there is nothing to learn from, a letter is all that is asked for and lang
    stays null. Repeated rows are all kept. No rows give no rows.
    """
    own, model = docs.columns, train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    scored = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row"), "text"), model)
    told = F.coalesce("_row.lang", F.col("_language.lang_pred"))
    return scored.filter(F.col("_language.lang_pred") != UNKNOWN).select(*[told.alias("lang") if c == "lang" else F.col(f"_row.`{c}`") for c in own])
