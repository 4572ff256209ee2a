"""Ranked lexical search over an inverted index with a range-maximum sparse table per posting list.

The index is a table: documents are gathered into blocks where they are read, a block's documents are numbered from the
longest to the shortest (so that those next to each other score alike), and there is a row per block and term with the
numbers of the documents that hold the term and how often. Nothing but counts crosses blocks.

A query is answered block by block. For an interval of a block's documents each of its terms gives the greatest impact
that any document in the interval has for it (two looks into the sparse table of its posting list); their sum bounds
every score in the interval. Intervals are taken best bound first and split at the document of the greatest impact,
which is scored exactly; the search of a block ends when no bound reaches the k-th best score found. Short intervals are
scored document by document. The best of all blocks are ranked together.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, ship, stage, text_of

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK_BYTES = 16 << 20  # of text; a longer text is a block of its own
SHORT = 1024  # an interval with at most so many postings of the query is scored document by document
QUERY_TERMS = 1 << 18  # terms of all queries that are searched at once; more queries are searched in turns
SCALE, K1, NORM = 1000, 12, 25  # fixed values of the score: see `impacts`

# Bytes of a text in UTF-8 as they count: A-Z in lower case, what parts terms as a blank.
_AS_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order: what `TERM` matches once A-Z are lower case."""
    return text.translate(_AS_TERM).split()


@dataclass
class Index:
    """documents (block, doc_ids, lengths) and postings (block, term, documents, counts), and N and L of all documents."""

    documents: DataFrame
    postings: DataFrame
    number: int
    length: int


def _block(number: int, ids: list[int | None], codes: list[np.ndarray], terms: list[bytes]) -> pa.RecordBatch:
    """The rows of one block: first its documents (no term), then its terms."""
    sizes = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-sizes, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    keys, counts = np.unique(np.concatenate(codes).astype(np.int64) * len(ids) + np.repeat(place, sizes), return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(terms) + 1) * len(ids))
    none, n = np.zeros(1, np.int64), len(terms) + 1

    def lists(first: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(first, kind))

    columns = [
        pa.array(np.full(n, number)), pa.array([None, *terms], pa.binary()).cast(pa.string()), lists([ids[i] for i in order], np.concatenate([none, np.full(n, len(ids))]), pa.int64()),
        lists(np.concatenate([sizes[order], counts]), np.concatenate([none, len(ids) + starts]), pa.int32()), lists(keys % len(ids), np.concatenate([none, starts]), pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, ["block", "term", "doc_ids", "counts", "documents"])


def index(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> Index:
    """Index of `docs` (doc_id, text). Every row is a document of its own; texts without terms (null ones too) are not in it.

    A block holds about `block_bytes` of text and belongs to one task, which holds one block at a time.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        held = 0
        ids, codes, known = [], [], defaultdict()
        known.default_factory = known.__len__
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                raw = text.as_py()
                if ids and held + len(raw) > block_bytes:
                    yield _block(block, ids, codes, list(known))
                    block, held = block + 1, 0
                    ids.clear(), codes.clear(), known.clear()
                found = terms_of(raw)
                if found:
                    ids.append(doc_id)
                    codes.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    held += len(raw)
        if ids:
            yield _block(block, ids, codes, list(known))

    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(build, "block long, term string, doc_ids array<long>, counts array<int>, documents array<int>")
    rows = stage(rows, "search-index")
    documents = rows.filter("term is null").select(F.col("block").alias("block"), "doc_ids", F.col("counts").alias("lengths"))
    whole = documents.agg(F.sum(F.size("lengths")).alias("number"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)).alias("length")).first()
    return Index(documents, rows.filter("term is not null").select("block", "term", "documents", "counts"), whole.number or 0, whole.length or 0)


def query_terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def weight(number: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * number + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, counts: np.ndarray, lengths: np.ndarray, number: int, length: int) -> np.ndarray:
    """What an occurrence of a term in a query adds to the score of a document: per posting, from the weight of its term,
    its count and the length of its document; in integers, rounding down."""
    m = (100 - NORM) + (NORM * lengths * number) // length
    return weights * ((SCALE * 1_000_000 * counts) // (SCALE * counts + K1 * m))


class Block:
    """The posting lists of one block, one after the other, and sparse tables over them: `table` holds, level by level,
    the place of the greatest impact among the 2**level postings that start at a posting."""

    def __init__(self, starts: np.ndarray, documents: np.ndarray, impact: np.ndarray, size: int):
        self.starts, self.documents, self.impact, self.size = starts, documents, impact, size
        lists = np.diff(starts)
        self.keys = np.repeat(np.arange(len(lists), dtype=np.int64) * size, lists) + documents
        longest = int(lists.max(initial=0))
        self.level = np.zeros(longest + 1, np.int64)
        for n in range(2, longest + 1):
            self.level[n] = n.bit_length() - 1
        levels = [np.arange(len(impact), dtype=np.int32)]
        while 2 << (len(levels) - 1) <= longest:
            below, half = levels[-1], 1 << (len(levels) - 1)
            a, b = below[:-half], below[half:]
            levels.append(np.where(impact[b] > impact[a], b, a))
        self.base = np.concatenate([[0], np.cumsum([len(x) for x in levels])])
        self.table = np.concatenate(levels)

    def greatest(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The place of the greatest impact in each stretch [i, j) of a list; none is empty."""
        level = self.level[j - i]
        base = self.base[level]
        a, b = self.table[base + i], self.table[base + j - (1 << level)]
        return np.where(self.impact[b] > self.impact[a], b, a)

    def search(self, lists: np.ndarray, times: np.ndarray, k: int, order: np.ndarray) -> list[tuple[int, int]]:
        """(score, document) of the k best documents with a score above 0 for the terms of `lists`, each counted `times`
        times; of equal scores those that are first in `order`."""
        best: list[tuple[int, int, int]] = []
        waiting: list[tuple[int, int, tuple]] = []
        serial = 0

        def offer(score: int, document: int) -> None:
            if score > 0:
                entry = (score, -int(order[document]), document)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)

        def wait(at: np.ndarray, i: np.ndarray, j: np.ndarray, times: np.ndarray) -> None:
            nonlocal serial
            some = i < j
            if some.any():
                at, i, j, times = at[some], i[some], j[some], times[some]
                top = self.greatest(i, j)
                part = times * self.impact[top]
                bound = int(part.sum())
                if len(best) < k or bound >= best[0][0]:
                    serial += 1
                    heapq.heappush(waiting, (-bound, serial, (at, i, j, times, int(self.documents[top[part.argmax()]]))))

        wait(lists, self.starts[lists], self.starts[lists + 1], times)
        while waiting:
            bound, _, (at, i, j, times, split) = heapq.heappop(waiting)
            if len(best) == k and -bound < best[0][0]:
                break
            if (n := j - i).sum() <= SHORT:
                places = np.repeat(i - np.cumsum(n) + n, n) + np.arange(n.sum())
                documents, inverse = np.unique(self.documents[places], return_inverse=True)
                scores = np.zeros(len(documents), np.int64)
                np.add.at(scores, inverse, np.repeat(times, n) * self.impact[places])
                least = best[0][0] if len(best) == k else 1
                for x in np.flatnonzero(scores >= least):
                    offer(int(scores[x]), int(documents[x]))
                continue
            middle = np.searchsorted(self.keys, at * self.size + split)
            held = np.zeros(len(at), bool)
            inside = middle < j
            held[inside] = self.documents[middle[inside]] == split
            offer(int((times[held] * self.impact[middle[held]]).sum()), split)
            wait(at, i, middle, times)
            wait(at, middle + held, j, times)
        return [(score, document) for score, _, document in best]


def search(found: Index, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the `k` best documents for each row of `items` (item_id, text).

    Only scores above 0 count, so an item without terms, or whose terms no document has, has no rows. Equal scores are
    ranked by doc_id, null last. Items that are repeated are answered each for itself. No documents give no rows.
    """
    spark = items.sparkSession
    asked = stage(items.select("item_id", query_terms(text_of()).alias("terms")).withColumn("query", F.monotonically_increasing_id()), "queries")
    words = asked.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    words = stage(words, "query-terms")
    turns = max(1, -(-words.count() // QUERY_TERMS))
    answers = [_answers(found, words.filter(F.pmod(F.xxhash64("query"), F.lit(turns)) == turn), k) for turn in range(turns)]
    whole = answers[0]
    for more in answers[1:]:
        whole = whole.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    ranked = whole.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


def _answers(found: Index, words: DataFrame, k: int) -> DataFrame:
    """query, doc_id, score: the k best of each block. words: (query, term, times), of a bounded number of rows."""
    spark = words.sparkSession
    # The terms of one turn's queries: about QUERY_TERMS rows, so they may be broadcast.
    terms = words.select("term").distinct()
    frequency = found.postings.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum(F.size("documents")).alias("df"))
    known = {r.term: (at, weight(found.number, r.df)) for at, r in enumerate(frequency.orderBy("term").collect())}
    asked = defaultdict(list)
    for r in words.collect():
        if r.term in known:
            asked[r.query].append((known[r.term][0], r.times))
    queries = [(q, np.array(sorted(t), np.int64).T) for q, t in sorted(asked.items())]
    weights = np.array([w for _, w in known.values()], np.int64)
    number, length = found.number, found.length

    def answer(postings: pa.Table, documents: pa.Table) -> pa.Table:
        out = ([], [], [])
        if len(postings) and len(documents):
            postings = postings.sort_by("at").combine_chunks()
            ids = documents.column("doc_ids").combine_chunks().values.to_pylist()
            lengths = documents.column("lengths").combine_chunks().values.to_numpy().astype(np.int64)
            at = postings.column("at").to_numpy()
            lists = postings.column("documents").combine_chunks()
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            docs = lists.flatten().to_numpy().astype(np.int64)
            counts = postings.column("counts").combine_chunks().flatten().to_numpy().astype(np.int64)
            block = Block(starts, docs, impacts(np.repeat(weights[at], np.diff(starts)), counts, lengths[docs], number, length), len(ids))
            place = np.full(len(weights), -1)
            place[at] = np.arange(len(at))
            order = np.empty(len(ids), np.int64)
            order[sorted(range(len(ids)), key=lambda x: (ids[x] is None, ids[x] or 0))] = np.arange(len(ids))
            for query, (wanted, times) in queries:
                here = place[wanted] >= 0
                for score, document in block.search(place[wanted][here], times[here], k, order) if here.any() else ():
                    for column, value in zip(out, (query, ids[document], score)):
                        column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["query", "doc_id", "score"])

    ship(spark)
    places = spark.createDataFrame([(t, at) for t, (at, _) in known.items()], "term string, at int")
    matched = found.postings.join(F.broadcast(places), "term").select("block", "at", "documents", "counts")
    return matched.groupBy("block").cogroup(found.documents.groupBy("block")).applyInArrow(answer, "query long, doc_id long, score long")
