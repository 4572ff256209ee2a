"""Source adapters: providers of tagged values as a Spark data source, for batch and for streams.

    adapters.register(spark)
    raw = spark.read.format("tagged_values").option("adapters", "my_package.esef:Esef").load("s3://bucket/landing/")
    observations = filings.observations_of(filings.checked(raw))

An adapter says which addresses it reads and turns the bytes of one file into tagged rows of published text. It only
takes a file apart: numbers, dates and units are checked by `filings.checked`, by one rule for all providers. Files are
listed on the driver and dealt to tasks by size; the first adapter that handles a file's address reads it. A file that
cannot be read gives one row that says why in `problem`, so one bad file does not stop the others.
"""

from __future__ import annotations

import heapq
import importlib
import json
import re
from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FIELDS = ("company_id", "taxonomy", "concept", "unit", "start", "end", "val", "accn", "form", "filed", "frame")
TAGGED = ", ".join(f"`{f}` string" for f in (*FIELDS, "url", "adapter", "problem"))
_ARROW = pa.schema([(f, pa.string()) for f in (*FIELDS, "url", "adapter", "problem")])
PARTITION_BYTES = 64 << 20
ROWS_AT_ONCE = 10_000


class UnreadableError(Exception):
    """The bytes are not what the adapter reads."""


class Adapter(ABC):
    """One provider. Instances are made in tasks, so they hold nothing."""

    name: str
    description: str = ""

    @abstractmethod
    def handles(self, url: str) -> bool: ...

    @abstractmethod
    def rows(self, content: bytes, url: str) -> Iterable[tuple[str | None, ...]]:
        """Tagged rows in the order of FIELDS, as published. Raises UnreadableError."""

    def identifier(self, url: str) -> str | None:
        """The company that the address names, where it does: rows of another one are a mistake in the configuration."""
        return None


class CompanyFacts(Adapter):
    """Snapshots of one company's tagged facts: {cik, facts: {taxonomy: {concept: {units: {unit: [row]}}}}}."""

    name = "companyfacts"
    description = "Company facts snapshots (JSON), one company a file"
    _ADDRESS = re.compile(r"(?<!\d)(\d{1,10})\.json$")
    _ROW = ("start", "end", "val", "accn", "form", "filed", "frame")

    def handles(self, url: str) -> bool:
        return bool(self._ADDRESS.search(url))

    def identifier(self, url: str) -> str | None:
        return str(int(self._ADDRESS.search(url)[1]))

    def rows(self, content: bytes, url: str) -> Iterator[tuple[str | None, ...]]:
        try:
            snapshot = json.loads(content, parse_int=str, parse_float=str, parse_constant=str)
            company, facts = str(int(snapshot["cik"])), snapshot["facts"]
            for taxonomy, concepts in facts.items():
                for concept, body in concepts.items():
                    units = (body or {}).get("units") or {}
                    if not units:
                        yield (company, taxonomy, concept, *[None] * 8)
                    for unit, rows in units.items():
                        for row in rows:
                            yield (company, taxonomy, concept, unit, *[row.get(f) if row.get(f) is None else str(row[f]) for f in self._ROW])
        except (ValueError, KeyError, TypeError, AttributeError) as error:
            raise UnreadableError(f"{type(error).__name__}: {error}"[:200]) from error


SHIPPED = ("tallyframe.sources.adapters:CompanyFacts",)


def load(names: Iterable[str]) -> list[Adapter]:
    """Adapters by `module:Class`, in order."""
    return [getattr(importlib.import_module(module), cls)() for module, cls in (n.strip().split(":") for n in names)]


def find(url: str, adapters: list[Adapter]) -> Adapter | None:
    return next((a for a in adapters if a.handles(url)), None)


@dataclass(frozen=True, order=True)
class Landed:
    """A file: when it was last written, its address, its size."""

    at: int
    url: str
    size: int


def _system(path: str) -> tuple[Any, str, str]:
    """The file system of a path, the path in it, and what makes an address of such a path again."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    scheme = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*:(?://)?(?=/|\w)", path)
    return system, inner, scheme[0] if scheme else ""


def listed(path: str) -> list[Landed]:
    """All files below a folder (or the file itself) but hidden ones, in the order in which they were written. None if there is no such folder."""
    from pyarrow import fs

    system, inner, scheme = _system(path)
    info = system.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True)) if info.type == fs.FileType.Directory else []
    shown = [i for i in found if i.type == fs.FileType.File and not any(part[:1] in "._" for part in i.path[len(inner) :].split("/") if part)]
    return sorted(Landed(i.mtime_ns or 0, f"{scheme}{i.path}", i.size or 0) for i in shown)


def dealt(files: Iterable[Landed], most: int, least: int = 1) -> list[Share]:
    """Files in shares of about `most` bytes, largest first into the share with the most room; a larger file has a share of its own.
    There are at least `least` shares, as far as there are files."""
    ordered = sorted(files, key=lambda f: (-f.size, f.url))
    shares = max(1, min(least, len(ordered)), -(-sum(f.size for f in ordered) // most))
    held: list[list] = [[0, n, []] for n in range(shares)]
    for f in ordered:
        size, n, urls = held[0]
        urls.append(f.url)
        heapq.heapreplace(held, [size + f.size, n, urls])
    return [Share(tuple(urls)) for _, _, urls in sorted(held, key=lambda h: h[1]) if urls]


@dataclass
class Share(InputPartition):
    urls: tuple[str, ...]


class _Reading:
    """What batch and stream readers do in a task."""

    def __init__(self, options: dict[str, str]):
        self.path, self.names = options["path"], [n for n in options.get("adapters", ",".join(SHIPPED)).split(",") if n.strip()]
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.least = int(options.get("minpartitions", options.get("minPartitions", 1)))

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        adapters, held = load(self.names), []
        for url in partition.urls:
            for row in tagged(url, adapters):
                held.append(row)
                if len(held) == ROWS_AT_ONCE:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=_ARROW)


def tagged(url: str, adapters: list[Adapter]) -> Iterator[tuple[str | None, ...]]:
    """The rows of one file, or one row with its problem."""
    nothing = [None] * len(FIELDS)
    adapter = find(url, adapters)
    if adapter is None:
        yield (*nothing, url, None, "no adapter")
        return
    named = adapter.identifier(url)
    try:
        system, inner, _ = _system(url)
        with system.open_input_stream(inner) as f:
            content = f.read()
        for row in adapter.rows(content, url):
            yield (*row, url, adapter.name, "other company" if named is not None and row[0] != named else None)
    except UnreadableError as error:
        yield (*nothing, url, adapter.name, f"unreadable: {error}")


class TaggedReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Share]:
        return dealt(listed(self.path), self.most, self.least) or [Share(())]


class TaggedStream(_Reading, DataSourceStreamReader):
    """New files in the order in which they were written. An offset is the last file that was taken, so a restarted query
    goes on behind it and a repeated batch has the files it had; files must not be changed once they have landed."""

    def initialOffset(self) -> dict:
        return {"at": -1, "url": ""}

    def latestOffset(self) -> dict:
        files = listed(self.path)
        return {"at": files[-1].at, "url": files[-1].url} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Share]:
        low, high = ((o["at"], o["url"]) for o in (start, end))
        return dealt([f for f in listed(self.path) if low < (f.at, f.url) <= high], self.most, self.least)


class TaggedValues(DataSource):
    """Format `tagged_values`; options: adapters (module:Class, comma separated; the shipped ones by default), partitionBytes (at most so many a task)
    and minPartitions (at least so many tasks, where there are as many files)."""

    @classmethod
    def name(cls) -> str:
        return "tagged_values"

    def schema(self) -> str:
        return TAGGED

    def reader(self, schema) -> TaggedReader:
        return TaggedReader(dict(self.options))

    def streamReader(self, schema) -> TaggedStream:
        return TaggedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TaggedValues)
