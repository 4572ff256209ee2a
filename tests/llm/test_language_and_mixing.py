import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import language, mixing, queries

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"


def kernel(a, b):
    """The kernel by definition, over hashed n-grams."""
    x, y = set(language.grams(a).tolist()), set(language.grams(b).tolist())
    return len(x & y) / (len(x) * len(y)) ** 0.5


def test_products_of_presence_are_kernels():
    texts = ["der Hund und die Katze", "le chien et le chat", "The dog, the cat!"]
    x = language.presence([language.grams(t) for t in texts])
    want = [[kernel(a, b) for b in texts] for a in texts]
    assert np.allclose(x @ x.T, want, atol=1e-5)


def test_scorer_is_the_nystroem_map_times_the_weights():
    texts = [f"{w} {w}s number {i}" for i, w in enumerate(["haus", "maison", "house", "casa"] * 6)]
    held = [language.grams(t) for t in texts]
    model = language.fit(held, ["de", "fr", "en", "es"] * 6)
    two_steps = (language.presence(held) @ model.landmarks.T) @ model.weights + model.bias
    assert np.allclose(model.scorer().scores(texts), two_steps, atol=1e-3)
    assert [model.languages[i] for i in two_steps.argmax(axis=1)] == ["de", "fr", "en", "es"] * 6


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, SF_MORE).collect()}
    docs = spark.read.parquet(f"{SF_MORE}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out and r.lang_pred != "und":
            right.append(r.lang_pred == d.lang)
    assert len(right) > 200 and np.mean(right) > 0.98


def test_texts_without_letters(spark, make_docs):
    rows = [(i, f"der die und {i}" if i % 2 else f"the and of {i}", "de" if i % 2 else "en") for i in range(40)]
    odd = [(100, None, "de"), (101, "", "de"), (102, "12 -- 3 \n", None), (None, "der und die", None), (103, "und " * 300_000, None), (103, "und " * 300_000, None), (104, "ж" * 50, None)]
    docs = make_docs(rows + odd)
    got = language.predict(docs, language.train(docs)).select("doc_id", "_language.*").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert {by[i].lang_pred for i in (100, 101, 102)} == {"und"} and {by[i].score for i in (100, 101, 102)} == {0.0}
    assert by[None].lang_pred == "de" and by[103].lang_pred == "de" and by[104].lang_pred in ("de", "en")
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + len(odd) - 3
    bare = make_docs([(1, "text", None), (2, None, "de")])
    assert language.train(bare) is None
    assert {r[0] for r in language.predict(bare, None).select("_language.lang_pred").collect()} == {"und"}
    assert language.accepted(make_docs([])).collect() == []


def test_every_language_is_learned_and_told(make_docs, monkeypatch):
    """More languages than rows to learn from; a language whose first rows have no letter; languages told where none is stated."""
    monkeypatch.setattr(language, "TRAIN_ROWS", 10)
    names = [f"l{i:02d}" for i in range(26)]
    rows = [(100 * i + k, ("1 2 3" if k < 30 and i == 0 else chr(97 + i) * 3 + " " + chr(97 + i) * (k % 5 + 1)), n) for i, n in enumerate(names) for k in range(40)]
    rows += [(9000 + i, chr(97 + i) * 4, None) for i in range(26)] + [(9100, "12", None), (9101, None, None)]
    docs = make_docs(rows)
    assert language.train(docs).languages == names
    kept = {r.doc_id: r.lang for r in language.accepted(docs).collect()}
    assert kept == {d: lang or names[d - 9000] for d, t, lang in rows if t and any(c.isalpha() for c in t)}


def test_texts_of_a_table_without_labels_are_kept(make_docs):
    docs = make_docs([(1, "text", None), (2, "é 1", None), (3, "12 -- 3", None), (4, None, None), (5, "", None), (None, "ж", None), (1, "text", None)])
    assert language.train(docs) is None
    kept = language.accepted(docs)
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["text", "text", "é 1", "ж"]
    only_numbers = make_docs([(1, "12", "de"), (3, "34", "de"), (7, "word", None)])
    assert [r.doc_id for r in language.accepted(only_numbers).collect()] == [7]


def test_only_the_allowed_rows_are_learned_from(spark, make_docs):
    """Labels of held-out rows change nothing."""
    rows = [(i, f"der die und {i}" if i % 2 else f"the and of {i}", "de" if i % 2 else "en") for i in range(60)]
    lied = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    a, b = (language.train(make_docs(r)) for r in (rows, lied))
    assert a.languages == b.languages == ["de", "en"] and np.array_equal(a.weights, b.weights)


def brute_targets(sizes, share=1.0, most=3):
    """Reshares what is over, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, budget = {}, set(order), sum(sizes.values()) * share
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if budget * weight[s] / total > most * sizes[s]]
        if not over:
            target |= {s: budget * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            free.remove(s)
        budget -= sum(target[s] for s in over)
    return target


def test_targets_against_resharing(spark):
    for case in ({"a": 100, "b": 1, "c": 50, "d": 3, None: 7, "é": 900, "": 20}, {"a": 5}, {"a": 0, "b": 0}, {"x": 10, "y": 0, "z": 1000}):
        df = spark.createDataFrame(list(case.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute_targets(case)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) < 1e-6 for s in want), case
    assert mixing.targets(spark.createDataFrame([], "source string, source_size long")).collect() == []


def test_sources_come_near_their_targets(spark):
    rows = queries.op4_mixing(spark, SF_MORE).collect()
    again = queries.op4_mixing(spark, SF_MORE).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_MORE}/documents.parquet").select("doc_id", "source").collect()}
    taken, target, largest = Counter(), {}, Counter()
    for r in rows:
        s = source[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sum(target.values()) * 0.99 < sum(taken.values()) <= sum(target.values()) * (1 + 1e-9)


def test_mixing_edges(make_docs):
    rows = [(1, "a b c", None, "s1"), (1, "a b c", None, "s1"), (2, None, None, "s1"), (3, "", None, None), (4, "x " * 100_000, None, "s2"), (None, "q w", None, None), (5, "one two", None, "s3"), (6, " \t\n", None, "s4")]
    docs = make_docs(rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for d, t, _, s in rows:
        sizes[s] += len((t or "").split())
    assert {r.source: r.source_size for r in got} == dict(sizes)
    assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in got)
    mixed = mixing.mixture(docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in got:
        want[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixed.collect()) == +want
    assert mixing.mixture(make_docs([])).collect() == []
