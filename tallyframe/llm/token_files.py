"""Token counts of flat token files: no index, only ids in a row with an end-of-document id after each document.

Tasks scan blocks of the files for that id with one vectorised comparison each. Which document of its file a separator
ends, and where a document starts that began in an earlier block, follows from a prefix scan over the blocks' counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import running, ship, stage
from .files import opened, ranges, sizes, write_files
from .tokens import encoder

BLOCK_BYTES = 8 << 20
ID_TYPE = "<u2"  # ids below 65,536; "<u4" for larger vocabularies


def write(docs: DataFrame, folder: str, tokenizer: str, separator: int, id_type: str = ID_TYPE) -> DataFrame:
    """Writes the ids of each text (null: empty) and the separator after it. Returns path, ordinal and doc_id, which the files do not hold."""

    def encode(batch: pa.RecordBatch) -> Iterator[tuple[bytes, dict]]:
        enc, end = encoder(tokenizer, special_as_text=True), np.array([separator], id_type).tobytes()
        for at, ids, ends in enc.batch(batch.column("text")):
            flat = ids.astype(id_type)
            for i in range(len(ends) - 1):
                yield flat[ends[i] : ends[i + 1]].tobytes() + end, {"doc_id": batch.column("doc_id")[at + i].as_py()}

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return write_files(rows, folder, ".tok", encode, StructType().add("doc_id", "long")).select("path", "ordinal", "doc_id")


def separators(files: DataFrame, separator: int, id_type: str = ID_TYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, block, place (0 for the first of its block), start (of the document, null for the first of a block), end. A file that does not end with a separator ends its last document all the same."""
    ship(files.sparkSession)
    width = np.dtype(id_type).itemsize

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, own = opened(r["path"])
                with system.open_input_file(own) as f:
                    f.seek(r["start"])
                    ids = np.frombuffer(f.read(r["end"] - r["start"]), id_type)
                first = r["start"] // width
                ends = np.flatnonzero(ids == separator) + first
                if r["end"] == r["size"] and len(ids) and ids[-1] != separator:
                    ends = np.append(ends, first + len(ids))
                starts = pa.array(np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, pa.int64(), mask=np.arange(len(ends)) == 0)
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * n, pa.string()), pa.array(np.full(n, first, np.int64)), pa.array(np.arange(n)), starts, pa.array(ends, pa.int64())], names)

    names = ["path", "block", "place", "start", "end"]
    return ranges(files, block_bytes // width * width).mapInArrow(scan, "path string, block long, place long, start long, end long")


def counts(files: DataFrame, separator: int, id_type: str = ID_TYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, ordinal, start and tokens of every document in `files` (path), separators not counted.

    Two separators in a row enclose an empty document; an empty file has none. A file named twice is read once.
    """
    found = stage(separators(sizes(files.sparkSession, files.select("path").distinct()), separator, id_type, block_bytes), "separators")
    blocks = found.groupBy("path", "block").agg(F.count("*").alias("n"), F.max("end").alias("last"))
    blocks = running(blocks, [F.col("block")], {"upto": F.col("n")}, ("path",))
    blocks = stage(blocks.withColumn("before", F.col("upto") - F.col("n")), "blocks")
    earlier = blocks.select("path", F.col("upto").alias("before"), (F.col("last") + 1).alias("carried"))
    stitched = blocks.select("path", "block", "before").join(earlier, ["path", "before"], "left")
    whole = found.join(stitched, ["path", "block"]).withColumn("start", F.coalesce("start", "carried", F.lit(0)))
    return whole.select("path", (F.col("before") + F.col("place")).alias("ordinal"), "start", (F.col("end") - F.col("start")).alias("tokens"))
