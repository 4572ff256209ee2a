"""Best-fit packing of documents into sequences of fixed length by matching large items.

Documents longer than a sequence are cut into pieces; nothing else is. Of the pieces above a third of a sequence at
most two fit into one, so they are paired greedily: each largest with the largest that still fits, which no other
pairing of them can beat. Smaller pieces then go, largest first, where the gap that is left is smallest.

Pieces of one length are alike, so the plan is made over the number of pieces per length: at most as many numbers as a
sequence has tokens, whatever the data. It is a list of rules "pieces number a to b of length s, q to a sequence, into
sequences from c on, at offset o". Every piece is then placed by its number among those of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import give_back, running, ship, stage, text_of
from .tokens import OPERATOR, encoder

SEQUENCE = 2048
SEPARATOR = 0


@dataclass
class Plan:
    """Rules as columns; key is length << 40 | first number, ascending."""

    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # length, first, per sequence, sequence, offset
    sequences: int = 0

    def arrays(self) -> list[np.ndarray]:
        table = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return [(table[:, 0] << 40) | table[:, 1], *(np.ascontiguousarray(table[:, i]) for i in (2, 3, 4))]


def plan(counts: dict[int, int], capacity: int = SEQUENCE) -> Plan:
    """A packing of `counts` pieces per length.

    Gaps are kept as runs of sequences that are filled alike; a rule fills a run or ends a length, and filling a run
    more than halves its gap, so there are at most about (lengths + pairs) times log2(capacity) rules.
    """
    out, left, used = Plan(), {s: n for s, n in counts.items() if n}, dict.fromkeys(counts, 0)
    gaps: list[int] = []  # the gaps there are, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: first sequence, number of sequences

    def put(length: int, each: int, sequence: int, offset: int, number: int) -> None:
        out.rows.append((length, used[length], each, sequence, offset))
        used[length] += number
        left[length] -= number

    def keep(gap: int, sequence: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                insort(gaps, gap)
            runs.setdefault(gap, []).append((sequence, number))

    def opened(number: int) -> int:
        out.sequences += number
        return out.sequences - number

    large = sorted((s for s in left if 3 * s > capacity))
    while large:
        top = large[-1]
        fits = bisect_left(large, capacity - top + 1) - 1  # the largest that fits beside it
        other = large[fits] if fits >= 0 else None
        if other is None:
            number = left[top]
            first = opened(number)
            put(top, 1, first, 0, number)
            keep(capacity - top, first, number)
        elif other == top:
            pairs, single = divmod(left[top], 2)
            first = opened(pairs + single)
            if pairs:
                put(top, 2, first, 0, 2 * pairs)
                keep(capacity - 2 * top, first, pairs)
            if single:
                rest = large[fits - 1] if fits > 0 else None
                put(top, 1, first + pairs, 0, 1)
                if rest is not None:
                    put(rest, 1, first + pairs, top, 1)
                keep(capacity - top - (rest or 0), first + pairs, 1)
        else:
            number = min(left[top], left[other])
            first = opened(number)
            put(top, 1, first, 0, number)
            put(other, 1, first, top, number)
            keep(capacity - top - other, first, number)
        large = [s for s in large if left[s]]
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(gaps, size)
            if at == len(gaps):
                each = capacity // size
                number = -(-left[size] // each)
                keep(capacity, opened(number), number)
                continue
            gap = gaps[at]
            first, number = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            each = gap // size
            full = min(number, left[size] // each)
            if full:
                put(size, each, first, capacity - gap, full * each)
                keep(gap - each * size, first, full)
            some = left[size] if full < number else 0
            if some:  # fewer than a sequence takes: the last of them
                put(size, some, first + full, capacity - gap, some)
                keep(gap - some * size, first + full, 1)
                full += 1
            keep(gap, first + full, number - full)
    return out


def pieces(docs: DataFrame, tokenizer: str, *carried: Column, capacity: int = SEQUENCE, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Per piece of each row: doc_id, `carried`, piece, start, length, ids_crc32 and, if asked for, ids (array of int)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([separator], "<u4")
        for batch in batches:
            held = batch.select(batch.schema.names[:-1])
            for at, ids, ends in enc.batch(batch.column(batch.num_columns - 1)):
                rows, numbers, starts, lengths, crcs, tokens = [], [], [], [], [], []
                for i in range(len(ends) - 1):
                    own = np.concatenate([ids[ends[i] : ends[i + 1]], end])
                    for n, start in enumerate(range(0, len(own), capacity)):
                        piece = own[start : start + capacity]
                        rows.append(at + i), numbers.append(n), starts.append(start), lengths.append(len(piece)), crcs.append(zlib.crc32(piece))
                        if with_ids:
                            tokens.append(piece)
                columns = [c.take(pa.array(rows, pa.int64())) for c in held.columns]
                columns += [pa.array(numbers, pa.int32()), *(pa.array(c, pa.int64()) for c in (starts, lengths, crcs))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(np.concatenate(tokens).astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)
        give_back(OPERATOR)

    ship(docs.sparkSession)
    inner = docs.select("doc_id", *carried, text_of().alias("_text"))
    schema = inner.drop("_text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    schema = schema.add("ids", ArrayType(IntegerType())) if with_ids else schema
    names = schema.names
    return inner.mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """Pieces (doc_id, piece, length, ...) with sequence_id and offset.

    Pieces longer than `capacity` are an error. Repeated rows are pieces of their own. No pieces give no rows.
    """
    ship(cut.sparkSession)
    counts = {int(r.length): r["count"] for r in cut.groupBy("length").count().collect()}  # at most `capacity` rows
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("a piece is empty or longer than a sequence")
    keys, each, sequence, offset = plan(counts, capacity).arrays()
    numbered = running(cut, [F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece")], {"_number": F.lit(1)}, ("length",))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "_number"))
            number = number - 1
            rule = np.searchsorted(keys, (length << 40) | number, "right") - 1
            behind = number - (keys[rule] & ((1 << 40) - 1))
            made = [sequence[rule] + behind // each[rule], offset[rule] + behind % each[rule] * length]
            own = [c for n, c in zip(batch.schema.names, batch.columns) if n != "_number"]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(m, pa.int64()) for m in made)], schema.names)

    schema = numbered.drop("_number").schema.add("sequence_id", "long").add("offset", "long")
    return numbered.mapInArrow(placed, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, doc_ids and input_ids of every sequence, from packed pieces that have their ids."""
    ordered = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return ordered.select("sequence_id", F.col("parts.doc_id").alias("doc_ids"), F.flatten("parts.ids").alias("input_ids"))


def pack_documents(docs: DataFrame, tokenizer: str, *carried: Column, capacity: int = SEQUENCE, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Packed pieces of all rows of `docs`; null texts are empty and hold the separator alone."""
    return pack(stage(pieces(docs, tokenizer, *carried, capacity=capacity, separator=separator, with_ids=with_ids), "pieces"), capacity)
