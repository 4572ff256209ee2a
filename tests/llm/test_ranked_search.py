import math
import random
import re
from collections import Counter

import numpy as np

from tallyframe.llm import queries, ranked_search
from tallyframe.llm.ranked_search import Block, index, search, terms_of

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    """(item_id, rank, doc_id, score) by scoring every document for every item."""
    held = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    number, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts in held:
            m = 75 + (25 * sum(counts.values()) * number) // length
            score = sum(math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms(text) if t in counts)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, n + 1, s[2], -s[0]) for n, s in enumerate(sorted(scores, key=lambda s: (s[0], s[1], s[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, k=20, **given):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in search(index(frame, **given), asked, k).collect()), key=repr)


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op11_ranked_search(spark, SF).collect()), key=repr) == brute(docs, items)


def test_many_small_blocks_and_short_intervals(spark, monkeypatch):
    draw = random.Random(5)
    docs = [(i, " ".join(draw.choice("abcdefghijklmnop") * draw.randint(1, 2) for _ in range(draw.randint(0, 60)))) for i in range(300)]
    items = [(i, " ".join(draw.choices("abcdefghq", k=6))) for i in range(8)]
    assert found(spark, docs, items, 7, block_bytes=2000) == brute(docs, items, 7)


def test_edges(spark):
    docs = [(3, None), (1, ""), (2, "...!"), (4, "Ärger ÄRGER x1"), (4, "Ärger ÄRGER x1"), (None, "x1 x1"), (5, "x1"), (6, "x1"), (7, "word " * 200_000), (8, "nul\x00word")]
    items = [(1, "X1"), (2, None), (3, ""), (4, "nowhere"), (5, "Ärger"), (5, "Ärger"), (None, "word word, nul"), (6, "𝒳 x1")]
    assert found(spark, docs, items) == brute(docs, items)
    assert found(spark, [], items) == [] == found(spark, docs, [])
    assert found(spark, [(1, None)], items) == []


def test_queries_in_turns(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 2)
    docs, items = [(i, f"a b{i % 3} c{i}") for i in range(20)], [(i, f"a b{i} c{i}") for i in range(5)]
    assert found(spark, docs, items, 4) == brute(docs, items, 4)


def test_terms_are_those_of_the_pattern():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("aZ09 _-\x00\x7f{`[@:/ßÄ€ \xa0😀\n\t") for _ in range(30))
        assert [t.decode() for t in terms_of(text.encode())] == terms(text)


def test_greatest_impact_of_every_stretch():
    draw = np.random.default_rng(2)
    impact = draw.integers(0, 9, 77)
    block = Block(np.array([0, 40, 41, 77]), np.concatenate([np.arange(40), [5], np.arange(36)]), impact, 40)
    for start, end in ((0, 40), (40, 41), (41, 77)):
        for i in range(start, end):
            for j in range(i + 1, end + 1):
                top = block.greatest(np.array([i]), np.array([j]))[0]
                assert i <= top < j and impact[top] == impact[i:j].max()


def test_search_leaves_documents_unscored(monkeypatch):
    """One document far above the rest: a few intervals are enough, whatever the size of the block."""
    monkeypatch.setattr(ranked_search, "SHORT", 4)
    size = 4096
    impact = np.full(2 * size, 10)
    impact[[100, size + 100]] = 1000
    block = Block(np.array([0, size, 2 * size]), np.tile(np.arange(size), 2), impact, size)
    looks = []
    whole = Block.greatest
    monkeypatch.setattr(Block, "greatest", lambda self, i, j: looks.append(1) or whole(self, i, j))
    assert block.search(np.array([0, 1]), np.array([1, 1]), 1, np.arange(size)) == [(2000, 100)]
    assert len(looks) == 1 + 2
