import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import packing
from tallyframe.llm.queries import op2_best_fit_packing, vocabulary
from tallyframe.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
ODD = [
    "", "  \t\n", "Don't WE'LL o'clock 'S ''s x''s '''d", "É1½² ª İstanbul ΣΑΣ <|endoftext|>x", "A\x1cb\x85c\xa0d 日本語 👍🏽 \x00 ﬁ ſ K", "ä ̈a\r\nb",
    "x" * 3000 + "É" * 2000, "²3½ _x_ ˀ ɏ ǅ ẞ Ǆ ÿ Ÿ", "...!!! a,b;c 10,000.5 naïve-café",
]


@pytest.fixture(scope="module")
def direct():
    return Tokenizer.from_file(vocabulary())


def ids_of(direct, text):
    return direct.encode(text or "", add_special_tokens=False).ids


def test_encoder_gives_the_tokenizers_ids(direct):
    import pyarrow as pa

    texts = [None, *ODD, " ".join(ODD)]
    got = [ids[ends[i] : ends[i + 1]].tolist() for _, ids, ends in encoder(vocabulary()).batch(pa.array(texts)) for i in range(len(ends) - 1)]
    assert got == [ids_of(direct, t) for t in texts]


def check_layout(rows, capacity=packing.SEQUENCE):
    """Every sequence is filled from 0 without gaps or overlaps."""
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def check_pieces(rows, texts, direct):
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    for doc_id, text in texts.items():
        ids = np.array([*ids_of(direct, text), 0], "<u4")
        held = sorted(by.pop(doc_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in held] == list(range(-(-len(ids) // 2048)))
        for r in held:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and r["ids_crc32"] == zlib.crc32(part.tobytes())
        assert sum(r["length"] for r in held) == len(ids)
    assert not by


def test_query_on_documents(spark, direct):
    rows = [r.asDict() for r in op2_best_fit_packing(spark, SF).collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_pieces(rows, texts, direct)
    used = check_layout(rows)
    assert used <= 1 + -(-sum(r["length"] for r in rows) // 2048)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_a_packing_near_the_bound(seed):
    """Against brute force: every piece is placed once, nothing overlaps, and no more sequences than first-fit decreasing needs."""
    draw = random.Random(seed)
    capacity = draw.choice([12, 30, 100])
    counts = {s: draw.randint(1, 9) for s in draw.sample(range(1, capacity + 1), draw.randint(1, min(12, capacity)))}
    made = packing.plan(counts, capacity)
    keys, each, sequence, offset = made.arrays()
    rows = []
    for size, n in counts.items():
        for number in range(n):
            rule = np.searchsorted(keys, (size << 40) | number, "right") - 1
            behind = number - (keys[rule] & ((1 << 40) - 1))
            rows.append({"sequence_id": sequence[rule] + behind // each[rule], "offset": offset[rule] + behind % each[rule] * size, "length": size})
    assert check_layout(rows, capacity) == made.sequences
    bins = []
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        at = next((i for i, used in enumerate(bins) if used + size <= capacity), None)
        if at is None:
            bins.append(size)
        else:
            bins[at] += size
    assert made.sequences <= len(bins)


def test_plan_for_very_many_pieces_has_few_rules():
    draw = random.Random(5)
    counts = {s: draw.randint(1, 10**9) for s in range(1, 2049)}
    made = packing.plan(counts)
    assert len(made.rows) < 60_000
    assert made.sequences * 2048 >= sum(s * n for s, n in counts.items())


def test_nulls_repeats_and_long_texts(make_docs, direct):
    long = " ".join(f"word{i}" for i in range(9000))
    texts = {1: None, 2: "", 3: " \n", 4: "one two", 5: long, 6: "one two"}
    packed = packing.pack_documents(make_docs([*texts.items(), (None, "no id"), (4, "one two")]), vocabulary(), with_ids=True)
    rows = [r.asDict() for r in packed.collect()]
    check_layout(rows)
    assert sum(r["doc_id"] == 4 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    twice = next(r for r in rows if r["doc_id"] == 4)
    rows.remove(twice)
    check_pieces([r for r in rows if r["doc_id"] is not None], texts, direct)
    for r in packing.sequences(packed).collect():
        assert len(r.input_ids) <= 2048 and r.input_ids[-1] == 0 or len(r.input_ids) == 2048


def test_no_rows(make_docs):
    assert packing.pack_documents(make_docs([]), vocabulary()).collect() == []
