"""What Python workers hold: batches are bounded in bytes, and an operator's tools go when another operator runs."""

from __future__ import annotations

import pyarrow as pa

from tallyframe.llm import common, language, packing, tokens
from tallyframe.llm.queries import vocabulary


def test_batches_of_texts_are_bounded_in_bytes(spark):
    common.ship(spark)
    docs = spark.range(3000, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes], "rows": [b.num_rows]})

    found = docs.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r.rows for r in found) == 3000
    assert max(r.bytes for r in found) < 2 * common.BATCH_BYTES


def test_a_size_that_the_session_sets_stays(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "123456")
        common.ship(spark)
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "123456"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", before)


def test_tools_of_another_operator_go():
    tool = tokens.encoder(vocabulary())
    common.give_back(tokens.OPERATOR)
    assert tokens.encoder(vocabulary()) is tool
    common.give_back()
    assert not common.kept(tokens.OPERATOR)


def test_results_do_not_depend_on_batches(spark):
    """A cut between batches moves no piece and no language."""
    docs = spark.range(40, numPartitions=1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 300) AS text", "'en' AS lang")
    key, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(key, str(common.BATCH_BYTES))
    try:
        for size in ("4000", str(1 << 26)):
            spark.conf.set(key, size)
            pieces = packing.pieces(docs, vocabulary()).orderBy("doc_id", "piece").collect()
            seen.append((pieces, language.predict(docs, language.train(docs)).orderBy("doc_id").select("doc_id", "_language.lang_pred").collect()))
    finally:
        spark.conf.set(key, before)
    assert seen[0] == seen[1] and len(seen[0][0]) >= 40
