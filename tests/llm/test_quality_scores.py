import math
import random
from zlib import crc32

import numpy as np
import pytest

from tallyframe.llm import quality, queries

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op12_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.score, r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, _, q in judged if q == k] for k in (1, 0))
    assert sum(p == q for _, p, q in judged) >= 0.95 * len(judged)
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) >= 0.97 * len(good) * len(bad)


def test_held_out_labels_and_ids_are_not_used(spark):
    """Flipped labels of held-out rows, other ids of the same fold and other languages change nothing."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) as quality")
    first, second = ({r.doc_id: r.score for r in quality.quality(docs, x).collect()} for x in (labels, flipped))
    assert first.keys() == second.keys() and all(abs(first[d] - second[d]) < 1e-6 for d in first)


def test_sums_of_partitions_are_those_of_all_rows(spark):
    draw = random.Random(4)
    rows = [([draw.random() for _ in quality.STATISTICS], float(draw.random() < 0.5), draw.randrange(3)) for _ in range(200)]
    frame = spark.createDataFrame(rows, "stats array<double>, y double, fold int").repartition(7)
    features = quality.fourier(frame)
    got = quality.normal_equations(frame, features)
    stats, y, fold = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert np.allclose(features.mean, stats.mean(axis=0)) and np.allclose(features.scale, stats.std(axis=0))
    z = np.concatenate([features.of(stats), y[:, None]], axis=1)
    assert all(np.allclose(got[f], z[fold == f].T @ z[fold == f]) for f in range(3))
    whole, penalty = got.sum(axis=0), 1e-2
    shrink = np.diag([penalty * len(y) / quality.FEATURES] * quality.FEATURES + [1e-9])
    assert np.allclose(quality.ridge(whole, penalty), np.linalg.solve(z[:, :-1].T @ z[:, :-1] + shrink, z[:, :-1].T @ y))


def test_features_approximate_a_gaussian_kernel():
    draw = np.random.default_rng(1)
    stats = draw.normal(size=(40, len(quality.STATISTICS)))
    features = quality.Fourier(np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    z = features.of(stats)[:, :-1]
    gap = ((stats[:, None] - stats[None]) ** 2).sum(axis=2)
    kernel = np.exp(-gap / (2 * quality.BANDWIDTH**2 * stats.shape[1]))
    assert abs(z @ z.T - kernel).mean() < 0.1


def test_isotonic_against_brute_force():
    """The best rising fit is, at each place, the largest over starts of the least mean over ends."""
    draw = random.Random(9)
    for _ in range(20):
        n = draw.randint(1, 12)
        number = [float(draw.randint(1, 5)) for _ in range(n)]
        ones = [float(draw.randint(0, int(k))) for k in number]
        at, level = quality.isotonic(np.arange(n, dtype=float), np.array(ones), np.array(number))
        want = [max(min(sum(ones[a : b + 1]) / sum(number[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert sorted(set(np.round(level, 9))) == sorted(set(np.round(want, 9))) and (np.diff(level) >= 0).all() and (np.diff(at) > 0).all()


@pytest.mark.parametrize("text", ["", " \n\t", "x", "a b", "é ñ\n\n\nß", "### !!! |||", "\x00 \x1f", "word " * 50_000, "x" * 300_000])
def test_statistics_of_odd_texts(text):
    found = quality.statistics(text.encode())
    assert len(found) == len(quality.STATISTICS) and all(math.isfinite(x) for x in found)


def test_edges(spark, make_docs):
    texts = [(i, t) for i, t in enumerate([None, "", "good plain text, here. " * 4, "%%% ### $$$ !!! " * 9, "x" * 100_000])] + [(2, "twice"), (2, "twice"), (None, "no id")]
    docs = make_docs(texts)
    empty = spark.createDataFrame([], LABELS)
    got = quality.quality(docs, empty).collect()
    assert len(got) == len(texts) and {(r.score, r.predicted) for r in got} == {(0.5, 0)}
    assert quality.quality(make_docs([]), empty).collect() == []
    assert quality.quality(make_docs([]), spark.createDataFrame([(1, 1, 0)], LABELS)).collect() == []
    # One class only, nulls and contradictions among the labels.
    odd = spark.createDataFrame([(0, 1, 0), (2, 1, None), (2, None, 1), (None, 0, 0), (3, 1, 0), (99, 0, 0)], LABELS)
    got = quality.quality(docs, odd).collect()
    assert len(got) == len(texts) and all(r.score == 1 for r in got)
    mixed = spark.createDataFrame([(i, i % 2, 0) for i in range(8)] + [(2, 1, 0)], LABELS)
    assert all(0 <= r.score <= 1 for r in quality.quality(docs, mixed).collect())
