import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallyframe.llm import fingerprints, queries, sharding

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_sketch(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    if not words:
        return []
    hashed = [signed(xxh64_intdigest(w.encode(), 42)) for w in words]
    all_ = set()
    for i in range(max(1, len(words) - 4)):
        h = 42
        for x in hashed[i : i + 5]:  # a hash of an array feeds each element's hash on as the seed
            h = xxh64_intdigest((x % 2**64).to_bytes(8, "little"), h)
        all_.add(signed(h) >> 32)
    return sorted({h for h in all_ if h < -(2**31) + 2**30} | {min(all_)})


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def hexes(sketch):
    return "".join(f"{h % 2**32:08x}" for h in sketch)


def test_query_against_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in queries.op7_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        text, after = d.text or "", docs[(i + 1) % len(docs)].text or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c, r = brute_sketch(text), brute_sketch(edited), brute_sketch(after), got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (hexes(a), hexes(b))
        assert abs(r.near_edited - jaccard(a, b)) < 1e-12 and abs(r.near_next - jaccard(a, c)) < 1e-12


@pytest.mark.parametrize("ids", [[5], [3, 1, 2], [10**12, -5, 7, 0, 8], [1, 1, 2, 2, None, None], [None], list(range(500))])
def test_next_document(spark, make_docs, monkeypatch, ids):
    monkeypatch.setattr(fingerprints, "ROWS_IN_RANGE", 1)  # many ranges even here
    rows = [(d, None if i == 1 else f"text {i:04d}") for i, d in enumerate(ids)]
    got = fingerprints.fingerprints(make_docs(rows)).select("doc_id", "text", "next.text").collect()
    order = sorted(((d is not None, d or 0, t or "") for d, t in rows))
    want = [((d if known else None), t, order[(i + 1) % len(order)][2]) for i, (known, d, t) in enumerate(order)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_no_documents(make_docs):
    assert fingerprints.fingerprints(make_docs([])).collect() == []
    assert sharding.shard(make_docs([])).collect() == []


def test_sketches_of_odd_texts(spark):
    texts = ["", " \t", "one", "a b c d e", "é " * 50, "x y " * 100_000, " ".join(map(str, range(3000)))]
    rows = fingerprints.with_sketch(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "text", "s").collect()
    assert {r.id: r.s for r in rows} == {i: brute_sketch(t) for i, t in enumerate(texts)}


def test_containment_between_unequal_texts_and_merging(spark):
    words = [str(i * 7919 % 100003) for i in range(40_000)]
    rows = [("small", " ".join(words[1000:3000])), ("rest", " ".join(words[3000:])), ("large", " ".join(words)), ("other", " ".join(words[:2000]))]
    df = fingerprints.with_sketch(spark.createDataFrame(rows, "name string, text string"), "text", "s").drop("text")
    pairs = df.alias("a").join(df.select(F.col("name").alias("other"), F.col("s").alias("t")))
    got = {(r.name, r.other): r.c for r in pairs.select("name", "other", fingerprints.containment("s", "t").alias("c")).collect()}
    assert got["small", "large"] == 1.0 and abs(got["large", "small"] - 0.05) < 0.01 and abs(got["small", "other"] - 0.5) < 0.1
    joint = df.filter("name in ('small', 'rest')").agg(fingerprints.merged("s").alias("m")).first().m
    by = {r.name: r.s for r in df.collect()}
    assert joint == sorted({*by["small"], *by["rest"]})


def test_merged_sketches_are_the_sketch_of_all_shingles(spark):
    """Short texts keep a hash for want of others; together with longer ones they do not."""
    texts = [f"a{i} b{i} c{i} d{i} e{i}" for i in range(40)] + ["", "one", " ".join(f"w{i}" for i in range(300))]
    limit = int(-(2**31) + fingerprints.FRACTION * 2**32)
    df = fingerprints.with_sketch(spark.createDataFrame([(t,) for t in texts], "text string"), "text", "s")
    by = {r.text: r.s for r in df.collect()}
    full = {r.text: r.s for r in fingerprints.with_sketch(df.select("text"), "text", "s", fraction=1.0).collect()}
    for group in (texts, texts[:2], texts[:1], ["", "one"], texts[-1:], [""]):
        got = df.filter(F.col("text").isin(group)).agg(fingerprints.merged("s").alias("m")).first().m
        every = sorted({h for t in group for h in full[t]})
        assert got == ([h for h in every if h < limit] or every[:1])
    assert any(by[t][0] >= limit for t in texts[:40])


def checked(rows, texts):
    """The contract of a placement by bytes; returns bytes by shard and shards by text."""
    size, slots, where = Counter(), defaultdict(list), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[texts[r.doc_id]].append(r.shard)
        body = texts[r.doc_id].encode()
        assert r.size == len(body) + 16 and r.text_crc32 == zlib.crc32(body)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(size) <= set(range(40))
    return size, where


def test_shards_of_documents(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op5_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    size, where = checked(rows, texts)
    assert len(size) == 40 and max(size.values()) < 1.03 * np.mean(list(size.values()))
    assert all(len(set(s)) == 1 for s in where.values())  # no text is cut


def test_hot_text_is_spread_and_others_stay_together(spark, make_docs):
    """One text has a third of all rows: it must be cut, but into few shards; pairs are not."""
    rows = [(i, "copy " * 20) for i in range(1000)] + [(1000 + i, f"pair {i // 2} " * 10) for i in range(400)] + [(2000 + i, f"single {i} " * (1 + i % 17)) for i in range(1600)]
    rows += [(5000, None), (5001, ""), (None, "nobody"), (5002, "long " * 4000)]
    got = sharding.shard(make_docs(rows)).collect()
    assert len(got) == len(rows)
    size, where = checked(got, {d: t or "" for d, t in rows})
    mean = sum(size.values()) / 40
    assert all(s < 1.05 * mean for k, s in size.items() if k != next(r.shard for r in got if r.doc_id == 5002))
    whole = [len(set(s)) == 1 for t, s in where.items() if t.startswith("pair")]
    assert np.mean(whole) > 0.95
    hot = sum(r.size for r in got if r.doc_id is not None and r.doc_id < 1000)
    assert len(set(where["copy " * 20])) <= math.ceil(hot / mean) + 1 and len(set(where[""])) == 1


def brute_propagation(cells, share):
    """cells: {(group, shard): n} and the unit of each group; the same rounds, one document at a time where it matters."""
    n, unit = dict(cells[0]), cells[1]
    while True:
        room = {s: share - sum(k * unit[g] for (g, t), k in n.items() if t == s) for _, s in n}
        total = {g: sum(k for (h, _), k in n.items() if h == g) for g in unit}
        most = lambda g, s: min(total[g], n[g, s] + int(max(room[s], 0) // unit[g]))
        order = {g: sorted((s for h, s in n if h == g), key=lambda s: (-most(g, s), -n[g, s], s)) for g in unit}
        want = {}
        for g, shards in order.items():
            left = sum(n[g, s] for s in shards)
            for s in shards:
                fits = n[g, s] + int(max(room[s], 0) // unit[g])
                want[g, s] = max(min(left, fits) - n[g, s], 0)
                left = max(left - fits, 0)
        granted = Counter()
        for s in room:
            free = room[s]
            for g in sorted((g for g in unit if want.get((g, s))), key=lambda g: (-n[g, s], g)):
                granted[g, s] = int(max(min(free // unit[g], want[g, s]), 0))
                free -= want[g, s] * unit[g]
        new, moved = Counter(n), False
        for g, shards in order.items():
            coming = sum(granted[g, s] for s in shards)
            for s in shards:
                new[g, s] += granted[g, s]
            for s in reversed(shards):
                leaving = min(coming, n[g, s])
                new[g, s] -= leaving
                coming -= leaving
            if sum(new[g, s] ** 2 for s in shards) > sum(n[g, s] ** 2 for s in shards):
                moved = True
            else:
                new.update({(g, s): n[g, s] - new[g, s] for s in shards})
        if not moved:
            return n
        n = {k: v for k, v in new.items() if v}


def test_propagation_against_brute_force(spark):
    draw = random.Random(6)
    for groups, shards, copies, share in ((12, 4, 6, 400.0), (5, 6, 40, 300.0), (30, 5, 3, 90.0)):
        unit = {f"g{i:02d}": draw.randint(1, 12) for i in range(groups)}
        n = Counter((g, draw.randrange(shards)) for g in unit for _ in range(draw.randint(2, copies)))
        frame = spark.createDataFrame([(g, unit[g], s, k) for (g, s), k in n.items()], "group string, unit long, shard int, n long")
        got = {(r.group, r.shard): r.n for r in sharding.propagate(frame, share).collect()}
        assert got == brute_propagation((n, unit), share)
        per = lambda x: {g: sum(k for (h, _), k in x.items() if h == g) for g in unit}
        assert per(got) == per(n) and sum(k * k for k in got.values()) >= sum(k * k for k in n.values())
        before, after = ({s: sum(k * unit[g] for (g, t), k in x.items() if t == s) for s in range(shards)} for x in (n, got))
        assert all(after[s] <= max(before[s], share) for s in range(shards))
