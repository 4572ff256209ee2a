from collections import Counter, defaultdict

import __spark_entry__ as entry
import corpus_pipeline
from test_packing import check_layout

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert all(n in names for n in entry.oracle_sql())


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage's decisions, from what the stage before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        step(spark, docs, SF).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        assert docs.columns == columns
        held[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
    before, after = held["language ID"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if any(c.isalpha() for c in r["text"] or "")}
    before, after = held["exact dedup"]
    groups = defaultdict(list)
    for r in before:
        groups["".join(c for c in r["text"] if c not in " \t\n\r\x0b\x0c")].append((-len(r["text"]), r["doc_id"]))
    assert sorted(r["doc_id"] for r in after) == sorted(min(g)[1] for g in groups.values())
    before, after = held["SimHash near-dedup"]
    least = similar_components({r["doc_id"]: r["text"] for r in before})
    kept, wanted = sorted(r["doc_id"] for r in after), set(least.values())
    # Nothing is dropped that has no similar text; of what should be dropped a few may be missed.
    assert len(kept) == len(set(kept)) and wanted <= set(kept) and len(set(kept) - wanted) <= 0.1 * (len(before) - len(wanted))
    before, after = held["mixing sources to target weights"]
    words = lambda r: len(r["text"].encode().split())
    times = Counter(r["doc_id"] for r in after)
    assert set(times) <= {r["doc_id"] for r in before} and max(times.values()) <= 3
    assert abs(sum(map(words, after)) - sum(map(words, before))) < 3000
    packed = [r.asDict() for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()]
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == times
    check_layout(packed)


def similar_components(texts):
    """All pairs, five words, similarity of 0.8."""
    sets = {}
    for doc_id, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in sets}
    ids = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in ids:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_run_gives_packed_pieces(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0


def test_stages_on_no_documents_and_odd_ones(spark, make_docs, tmp_path):
    for n, docs in enumerate([make_docs([]), make_docs([(None, None), (1, None), (1, None), (2, "12"), (3, "a b", None, "s"), (3, "a b", None, "s"), (4, "a b ", "en", None)])]):
        for k, (_, step) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{n}-{k}")
            step(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
