"""Binary files in the shared folder, written and read by tasks: local paths and every address that pyarrow can open."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import shared_folder
from .common import ship, stage


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def opened(address: str) -> tuple[Any, str]:
    """The file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def write_files(rows: DataFrame, folder: str, suffix: str, encode: Callable[[pa.RecordBatch], Iterator[tuple[bytes, dict]]], schema: StructType) -> DataFrame:
    """One file per partition of `rows`; `encode` turns a batch into chunks of bytes and a row of the manifest for each.

    A task writes under a name of its own attempt and renames the file when it is whole, so a repeated task replaces
    its file by an equal one. Returns the manifest: `schema` with path, position (of the chunk in bytes) and ordinal (of
    the row in its file), already written. Files that the manifest does not name are to be ignored.
    """
    ship(rows.sparkSession)
    full = StructType([*schema.fields]).add("path", "string").add("position", "long").add("ordinal", "long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = opened(folder)
        final = f"part-{task.partitionId():06d}{suffix}"
        own = f"{base}/_attempt-{task.taskAttemptId()}-{final}"
        system.create_dir(base, recursive=True)
        position = ordinal = 0
        with system.open_output_stream(own, compression=None) as out:
            for batch in batches:
                held = []
                for chunk, row in encode(batch):
                    held.append(row | {"path": f"{folder}/{final}", "position": position, "ordinal": ordinal})
                    out.write(chunk)
                    position, ordinal = position + len(chunk), ordinal + 1
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)
        if ordinal:
            system.move(own, f"{base}/{final}")
        else:
            system.delete_file(own)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(full)
    return stage(rows.mapInArrow(write, full), "manifest")


def sizes(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """path, size of each file in `paths` (path), asked of the file system by tasks."""
    ship(spark)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [p.as_py() for p in batch.column("path")]
            found = [system.get_file_info(own).size for system, own in map(opened, held)]
            yield pa.RecordBatch.from_pydict({"path": held, "size": found}, schema=pa.schema([("path", pa.string()), ("size", pa.int64())]))

    return paths.select("path").mapInArrow(ask, "path string, size long")


def ranges(files: DataFrame, length: int) -> DataFrame:
    """path, size, start, end: every file (path, size) cut into ranges of `length` bytes, dealt out evenly."""
    spark = files.sparkSession
    cut = files.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(length).cast("long"))).alias("start"))
    return cut.withColumn("end", F.least(F.col("start") + length, F.col("size"))).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
