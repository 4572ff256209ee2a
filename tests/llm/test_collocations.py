import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyframe.llm import collocations, queries
from tallyframe.llm.collocations import Shard, _packed, unpacked, words_of

SF = "/root/testdata/sf0.001"


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in (re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)) if w]


def brute(rows, most=2000, minimum=30):
    """(lang, rank, phrase, a, l, r, n, score) by counting every phrase of every text."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for words in pieces(text):
            n["und" if lang is None else lang] += len(words)
            for m in range(1, 5):
                f["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, counts in f.items():
        some = {p: a for p, a in counts.items() if len(p) > 1 and a >= minimum}
        inside = defaultdict(int)
        for p, a in some.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in some.items():
            if 100 * inside[p] < 80 * a:
                score, k = min(((2_000_000 * a) // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:most])]
    return sorted(out)


def mined(spark, rows, most=2000, minimum=30):
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    return sorted(tuple(r) for r in collocations.collocations(frame, most, minimum).collect())


def test_query_against_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op13_collocations(spark, SF)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_many_shards_and_ranges(spark, monkeypatch):
    """Phrases that are frequent over all shards and in none; ties in score and count; few words, so that phrases overlap themselves."""
    monkeypatch.setattr(collocations, "RANGE_WORDS", 64)
    monkeypatch.setattr(collocations.shards, "__defaults__", (collocations.LONGEST, 60))
    draw = random.Random(8)
    rows = [(draw.choice(["x", "y", None, "und"]), " ".join(draw.choices(["a", "b", "c", "d.", "ee,", "B"], [5, 4, 3, 1, 1, 1], k=draw.randint(0, 40)))) for _ in range(150)]
    assert mined(spark, rows, 25, 6) == brute(rows, 25, 6)


def test_edges(spark):
    long = "one two three four five " * 20_000
    rows = [("a", None), ("a", ""), ("a", " \t.\n!"), (None, "x y " * 40), ("b", "word"), ("", "Ä B\xa0c, " * 31), ("c", long), ("d", "n\x00l x\x1cy\x85z " * 30), ("e", "u u u u u u " * 9)] + [("f", "same same row")] * 31
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] == mined(spark, [("a", None)])


def test_words_are_those_of_the_patterns():
    draw = random.Random(2)
    for _ in range(200):
        text = "".join(draw.choice("aZ é.,;:!?\t\n\x0b\x0c\r\x00\x1c\x85\xa0😀|") for _ in range(30))
        split = [[]]
        for word in words_of(text.encode()):
            split.append([]) if word == b"\xff" else split[-1].append(word.decode())
        assert [p for p in split if p] == pieces(text)


@pytest.mark.parametrize("letters", [2, 3, 40])
def test_extensions_on_both_sides_against_counts(letters):
    draw = random.Random(letters)
    words = [f"w{i}".encode() for i in range(letters)]
    texts = [[draw.randrange(letters) + 1 for _ in range(draw.randint(1, 30))] for _ in range(40)]
    codes = [np.array([*t, 0], np.int32) for t in texts]
    shard = unpacked(_packed(codes, words, 4), "x")
    want = [Counter(tuple(t[i : i + m]) for t in texts for i in range(len(t) - m + 1)) for m in range(5)]

    def as_counts(found):
        return {tuple(w): n for w, n in zip(found.words.tolist(), found.count.tolist())}

    level = {1: shard.single()}
    assert as_counts(level[1]) == {(i + 1,): want[1][(i + 1,)] for i in range(letters)}
    for steps in ("rrr", "lll", "rlr", "lrl", "rrl", "llr"):
        found = level[1]
        for n, side in enumerate(steps):
            found = shard.right(found) if side == "r" else shard.left(found)
            assert as_counts(found) == want[n + 2]
