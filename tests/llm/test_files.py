import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import files, queries, token_files, warc

SF = "/root/testdata/sf0.001"
END = 7


def brute_counts(ids):
    """start, tokens per document of a list of ids."""
    out, start = [], 0
    for i, x in enumerate(ids):
        if x == END:
            out.append((start, i - start))
            start = i + 1
    if start < len(ids):
        out.append((start, len(ids) - start))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_counts_of_any_blocks_against_brute_force(spark, tmp_path, seed):
    draw = random.Random(seed)
    want, paths = {}, []
    cases = [[], [END], [1], [END, END], [1, 2, END, 3], [1] * 100, [1] * 99 + [END], [END] * 50]
    cases += [[END if draw.random() < p else draw.randint(8, 60000) for _ in range(draw.randint(1, 400))] for p in (0.5, 0.1, 0.01)]
    for i, ids in enumerate(cases):
        path = tmp_path / f"f{i}.tok"
        path.write_bytes(np.array(ids, "<u2").tobytes())
        paths.append((f"file://{path}",))
        want |= {(f"f{i}.tok", n): found for n, found in enumerate(brute_counts(ids))}
    df = spark.createDataFrame([*paths, paths[4]], "path string")
    got = token_files.counts(df, END, block_bytes=draw.choice([2, 14, 64])).collect()
    assert {(r.path.split("/")[-1], r.ordinal): (r.start, r.tokens) for r in got} == want and len(got) == len(want)


def test_query_counts_every_document(spark):
    direct = Tokenizer.from_file(queries.vocabulary())
    direct.encode_special_tokens = True
    got = queries.op1_token_counts(spark, SF).collect()
    want = {r.doc_id: len(direct.encode(r.text or "", add_special_tokens=False).ids) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id: r.tokens for r in got} == want and len(got) == len(want)


def test_written_texts_with_gaps(spark, make_docs):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> a"), (None, "b"), (4, "c"), (4, "c"), (5, "d " * 200_000)]
    written = token_files.write(make_docs(rows), files.new_folder(spark, "tok"), queries.vocabulary(), queries.END_OF_DOCUMENT)
    counted = token_files.counts(written.select("path"), queries.END_OF_DOCUMENT, block_bytes=1000).join(written, ["path", "ordinal"]).collect()
    got = sorted((r.doc_id or 0, r.tokens) for r in counted)
    assert len(got) == len(rows) and [t for d, t in got if d in (1, 2, 4, 5)] == [0, 0, 1, 1, 200_000]
    assert dict(got)[3] > 2  # the separator's string in a text is not a separator
    none = token_files.write(make_docs([]), files.new_folder(spark, "tok"), queries.vocabulary(), queries.END_OF_DOCUMENT)
    assert token_files.counts(none.select("path"), queries.END_OF_DOCUMENT).collect() == []


PAGES = "page_id long, url string, html string, payload string, digest string"


@pytest.mark.parametrize("split", [50, 700, 1 << 20])
def test_archives_round_trip_for_any_split(spark, split):
    noise = "".join(chr(random.Random(1).randint(0x20, 0x2FFF)) for _ in range(30_000))
    rows = [(i, f"http://h{i}/", f"<p>{noise[: i * 400]}</p>") for i in range(25)]
    rows += [(50, None, None), (51, "", ""), (52, "http://x/\r\nWARC-Type: warcinfo", "y" * 99), (53, "u", "y" * 99), (60, "a", "z" * 100), (55, "b", "z" * 100), (55, "c", "z" * 100), (None, "d", "z" * 100), (70, "ü", "\x1f\x8b\x08WARC/1.1\r\n\r\n" * 30)]
    pages = spark.createDataFrame([(*r, "p", "q") for r in rows], PAGES).repartition(3)
    written = warc.write(warc.planned(pages), files.new_folder(spark, "warc"))
    got = warc.read(written.select("path"), split_bytes=split).collect()
    assert sorted((r.path, r.position) for r in got) == sorted((r.path, r.position) for r in written.collect())
    by = sorted(((warc_id(r.record_id), r) for r in got), key=lambda x: (x[0] is None, x[0] or 0))
    assert len(by) == len(rows)
    payloads = {}
    for d, _, html in rows:
        payloads.setdefault(d, (html or "").encode())
    for page_id, r in by:
        body = payloads[page_id]
        assert r.payload_digest == hashlib.sha256(body).hexdigest() and r.payload_bytes == len(body)
        assert r.payload == (bytearray(body) if r.record_type == "response" else None)
    types = sorted((i or -1, r.record_type, warc_id(r.refers_to)) for i, r in by if len(payloads[i]) == 100)
    assert types == [(-1, "revisit", 55), (55, "response", None), (55, "revisit", 55), (60, "revisit", 55)]
    assert {r.record_type for i, r in by if i in (50, 51, 52, 53)} == {"response"}


def warc_id(name):
    return int(name.removeprefix(warc.NAME)) if name and name != warc.NAME else None


def test_no_pages(spark):
    written = warc.write(warc.planned(spark.createDataFrame([], PAGES)), files.new_folder(spark, "warc"))
    assert warc.read(written.select("path")).collect() == []


def test_reader_is_not_misled_by_members_inside_payloads(spark, tmp_path):
    """Payloads that are archives themselves, stored without compression so that their signatures show."""
    inner = warc.record(1, "u", b"inner" * 50, "d", "response", None)

    def stored(page_id, payload):
        plain = zlib.decompress(warc.record(page_id, "u", payload, "d", "response", None), 31)
        packer = zlib.compressobj(0, zlib.DEFLATED, 31)
        return packer.compress(plain) + packer.flush()

    members = [stored(i, b"x" * 40 + inner + b"y" * 300) for i in range(10, 30)]
    path = tmp_path / "nested.warc.gz"
    path.write_bytes(b"".join(members))
    df = spark.createDataFrame([(f"file://{path}",)], "path string")
    for split in (37, 211, 5000):
        assert sorted(warc_id(r.record_id) for r in warc.read(df, split_bytes=split).collect()) == list(range(10, 30))


def test_a_broken_archive_is_an_error(spark, tmp_path):
    path = tmp_path / "broken.warc.gz"
    path.write_bytes(warc.record(1, "u", b"a" * 500, "d", "response", None)[:-9])
    with pytest.raises(Exception, match="ends inside"):
        warc.read(spark.createDataFrame([(f"file://{path}",)], "path string")).collect()
