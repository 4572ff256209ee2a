"""WARC archives: one gzip member per record, written by tasks, and read back by tasks that each take a range of bytes.

A reader that does not start a file looks for the signature of a gzip member in its range, and accepts a place only if
a whole member decodes there, begins with record headers, and is followed by another member or the end of the file. From
there it goes from member to member. It owns the records that start inside its range, the last of which may end beyond.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import ship, stage
from .files import opened, ranges, sizes, write_files

SPLIT_BYTES = 16 << 20
READ_BYTES = 1 << 20
LEAST_SHARED = 100  # shorter payloads are stored again each time
SIGNATURE = b"\x1f\x8b\x08"
# Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # the tables have no capture time
NAME = "urn:page:"


def planned(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """page_id, url, payload (null: empty), digest, record_type and refers_to per row of `pages`.

    Of equal payloads of at least `least` bytes the row with the smallest page_id is the response (null last; of
    repeated rows the first by url) and the others revisit it.
    """
    sized = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    ids = sized.filter(F.octet_length("payload") >= least).groupBy("digest", "page_id").count()
    first = F.min_by(F.struct(F.col("page_id").alias("refers_to"), F.col("count").alias("tied")), F.struct(F.col("page_id").isNull(), "page_id")).alias("first")
    groups = stage(ids.groupBy("digest").agg(first, F.sum("count").alias("n")).filter("n > 1").select("digest", "first.*", F.lit(True).alias("shared")), "payloads")
    joined = sized.join(groups, "digest", "left")
    is_first = F.col("page_id").eqNullSafe(F.col("refers_to"))
    plain = "page_id", "url", "payload", "digest"

    def typed(rows: DataFrame, revisit) -> DataFrame:
        return rows.select(*plain, F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("refers_to")).alias("refers_to"))

    if groups.filter("tied > 1").isEmpty():
        return typed(joined, F.col("shared").isNotNull() & ~is_first)
    tied = F.col("shared").isNotNull() & (F.col("tied") > 1) & is_first
    numbered = joined.filter(tied).withColumn("_at", F.row_number().over(Window.partitionBy("digest").orderBy("url")))
    return typed(joined.filter(~tied), F.col("shared").isNotNull() & ~is_first).unionByName(typed(numbered, F.col("_at") > 1))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, record_type: str, refers_to: int | None) -> bytes:
    """A record as a gzip member. A revisit has the response's headers, which tell the payload's length, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    named = [("WARC-Type", record_type), ("WARC-Record-ID", f"<{NAME}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        named.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    named.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if record_type == "revisit":
        named += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{NAME}{'' if refers_to is None else refers_to}>")]
    named += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named).encode("utf-8") + b"\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def write(records: DataFrame, folder: str) -> DataFrame:
    """Writes `planned` rows; returns path, position, ordinal and page_id per record."""

    def encode(batch: pa.RecordBatch) -> Iterator[tuple[bytes, dict]]:
        for row in zip(*(c for c in batch.columns)):
            values = [v.as_py() for v in row]
            yield record(*values), {"page_id": values[0]}

    rows = records.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "payload", "digest", "record_type", F.col("refers_to").cast("long"))
    return write_files(rows, folder, ".warc.gz", encode, StructType().add("page_id", "long"))


class Archive:
    """Members of one open file."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size

    def _read(self, at: int) -> bytes:
        self.file.seek(at)
        return self.file.read(READ_BYTES)

    def member(self, at: int) -> tuple[bytes, int]:
        """The content of the member at a place and where the next one starts; ValueError if no record is there."""
        unpack, out, position = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof:
                data = self._read(position)
                if not data:
                    raise ValueError(f"the file ends inside the member at {at}")
                out.append(unpack.decompress(data))
                position += len(data)
                if len(out) == 1 and out[0] and not out[0].startswith(b"WARC/1."[: len(out[0])]):
                    raise ValueError(f"no record at {at}")
        except zlib.error as error:
            raise ValueError(f"no member at {at}") from error
        return b"".join(out), position - len(unpack.unused_data)

    def first(self, start: int, end: int) -> int | None:
        """The first place from `start` on, before `end`, where a record starts."""
        at = start
        while at < end:
            data = self._read(at)
            found = data.find(SIGNATURE)
            while 0 <= found and at + found < end:
                if self._is_record(at + found):
                    return at + found
                found = data.find(SIGNATURE, found + 1)
            at += max(1, len(data) - len(SIGNATURE) + 1) if data else end
        return None

    def _is_record(self, at: int) -> bool:
        try:
            content, after = self.member(at)
            parse(content)
        except ValueError:
            return False
        return after == self.size or self._read(after)[: len(SIGNATURE)] == SIGNATURE

    def records(self, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        at = 0 if start == 0 else self.first(start, end)
        while at is not None and at < min(end, self.size):
            content, after = self.member(at)
            yield at, content
            at = after


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record, names in lower case, and its block."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not gap or not lines[0].startswith("WARC/1.") or not headers.get("content-length", "").isdigit():
        raise ValueError("the headers of a record are broken")
    return headers, rest[: int(headers["content-length"])]


def _row(path: str, at: int, content: bytes, with_payload: bool) -> dict:
    headers, block = parse(content)
    head, _, payload = block.partition(b"\r\n\r\n")
    original = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8").split("\r\n")[1:])}
    revisit = headers["warc-type"] == "revisit"
    digest = headers["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
    row = {
        "path": path, "position": at, "record_type": headers["warc-type"], "record_id": headers["warc-record-id"].strip("<>"), "url": headers.get("warc-target-uri"),
        "payload_bytes": int(original["content-length"]) if revisit else len(payload), "payload_digest": digest, "refers_to": headers.get("warc-refers-to", "").strip("<>") or None,
    }
    return row | ({"payload": None if revisit else payload} if with_payload else {})


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Every record of the archives in `files` (path): where it is, its type, ids, url, payload and the payload's length and digest.

    The digest of a response is taken from what was read, that of a revisit from its headers. A file named twice is
    read once; a broken file is an error.
    """
    ship(files.sparkSession)
    schema = StructType().add("path", "string").add("position", "long").add("record_type", "string").add("record_id", "string").add("url", "string").add("payload_bytes", "long").add("payload_digest", "string").add("refers_to", "string")
    schema = schema.add("payload", BinaryType()) if with_payload else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                system, own = opened(r["path"])
                with system.open_input_file(own) as f:
                    held, weight = [], 0
                    for at, content in Archive(f, r["size"]).records(r["start"], r["end"]):
                        held.append(_row(r["path"], at, content, with_payload))
                        weight += len(content) if with_payload else 300
                        if weight > READ_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held, weight = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return ranges(sizes(files.sparkSession, files.select("path").distinct()), split_bytes).mapInArrow(scan, schema)


def page_of(name: str):
    """The page id in a record's name; null where it has none."""
    return F.expr(f"try_cast(substring({name}, {len(NAME) + 1}) as bigint)")
