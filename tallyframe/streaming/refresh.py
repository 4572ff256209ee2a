"""Refreshing facts as snapshots arrive: append observations not seen before, keep the latest disclosure current.

Both jobs are restartable. A micro-batch always writes the same folder, so replaying it after a failure changes nothing,
and the current view is a maximum over (filed, accession), so arrival order and late filings do not matter and no
watermark is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..schemas import OBSERVATIONS
from ..sources.sinks import BUCKETS

OBSERVATION_KEY = ["company_id", "taxonomy", "concept", "unit", "value", "period_start", "period_end", "accession", "form", "filed"]


def _observation_hash() -> Column:
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in OBSERVATION_KEY]), 256)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("company_id"), F.lit(BUCKETS)).cast("int")


def append_new_observations(
    snapshots: DataFrame, target: str, checkpoint: str, flatten: Callable[[DataFrame], DataFrame], *, available_now: bool = True
) -> StreamingQuery:
    """Stream of snapshot rows to a table of distinct observations. `flatten` turns a batch into observations.

    A batch only reads the company buckets it touches, of which there are at most BUCKETS, so their numbers are a
    literal filter on folders; its own folder is excluded, so a replay sees what the first attempt saw. A batch without
    good rows writes an empty folder, which the next one reads by the schema it knows.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = flatten(batch).withColumn("obs_hash", _observation_hash()).withColumn("company_bucket", _bucket()).dropDuplicates(["obs_hash"]).persist()
        try:
            touched = [r.company_bucket for r in fresh.select("company_bucket").distinct().collect()]
            rows = fresh
            if number and touched and _exists(spark, target):
                earlier = _stored(spark, target, fresh.schema).filter(F.col("batch") < number).filter(F.col("company_bucket").isin(touched))
                rows = fresh.join(earlier.select("company_bucket", "obs_hash"), ["company_bucket", "obs_hash"], "left_anti")
            rows.hint("rebalance", "company_bucket").write.mode("overwrite").partitionBy("company_bucket").parquet(f"{target}/batch={number}")
        finally:
            fresh.unpersist()

    writer = snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.trigger(processingTime="1 minute").start()


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _stored(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """All batches, by a schema that is known: a folder may hold no file to take one from."""
    names = {"batch", "company_bucket"}
    full = StructType([f for f in schema.fields if f.name not in names]).add("batch", "long").add("company_bucket", "integer")
    return spark.read.schema(full).parquet(target)


def read_observations(spark: SparkSession, target: str, schema: StructType | None = None) -> DataFrame:
    """Every observation stored so far. schema: that of what `flatten` gives; the published one by default."""
    known = schema or spark.createDataFrame([], OBSERVATIONS).schema
    if not _exists(spark, target):
        return spark.createDataFrame([], known)
    return _stored(spark, target, StructType(list(known.fields)).add("obs_hash", "string")).select(*known.names)


def compact_observations(spark: SparkSession, target: str, into: str, schema: StructType | None = None) -> DataFrame:
    """A copy of the table with one set of files per bucket, under a new folder, to read from or to start the next
    checkpoint on. The batches stay as they are, so running streams are not disturbed."""
    compact = _stored(spark, target, (schema or spark.createDataFrame([], OBSERVATIONS).schema).add("obs_hash", "string")).drop("batch")
    compact.hint("rebalance", "company_bucket").write.mode("overwrite").partitionBy("company_bucket").parquet(f"{into}/batch=0")
    return read_observations(spark, into, schema)


# ---- current view: runs, merged in levels --------------------------------------------------------------------------

FAN = 4  # so many runs of one level become one of the next
_MANIFEST = "manifest-"


def current_view_updates(disclosures: DataFrame, keys: list[str], order: list[str], changelog: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Stream of disclosures to a log of each key's newest one, for `read_current_view`.

    The newest per key is streaming state (one row per key, combined map-side within a batch); each batch writes the keys
    it changed as a run. When `fan` runs of a level are there they are merged into one run of the next, with one row a
    key, so a read touches fewer than `fan` runs for each digit of the number of batches, and a row is rewritten once a
    level. A manifest for each batch names its live runs and follows from that of the batch before and the batch's
    number alone: a batch that is replayed writes the same runs and the same manifest again.
    """
    payload = [c for c in disclosures.columns if c not in keys]
    newest = disclosures.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*order)).alias("newest"))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _runs(spark, changelog, number - 1)
        batch.write.mode("overwrite").parquet(f"{changelog}/{_run_name(0, number)}")
        runs, made, level = [*before, _run_name(0, number)], {_run_name(0, number)}, 0
        while len(full := [r for r in runs if _level(r) == level]) >= fan:
            merged = _newest(spark.read.parquet(*[f"{changelog}/{r}" for r in full]), keys, order)
            merged.write.mode("overwrite").parquet(f"{changelog}/{_run_name(level + 1, number)}")
            runs = [*[r for r in runs if r not in full], _run_name(level + 1, number)]
            level += 1
            made.add(_run_name(level, number))
        _put(spark, f"{changelog}/{_MANIFEST}{number:012d}", "\n".join(runs))
        # Runs that neither this manifest nor the one before names are no longer read: a reader has one batch of time.
        for run in (set(_runs(spark, changelog, number - 2)) | made) - set(before) - set(runs):
            _delete(spark, f"{changelog}/{run}")

    return newest.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_current_view(spark: SparkSession, changelog: str, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key over the live runs; earlier versions of a key lose against later ones by the same order."""
    runs = _runs(spark, changelog, None)
    if not runs:
        raise FileNotFoundError(f"no batch has been written to {changelog}")
    return _newest(spark.read.parquet(*[f"{changelog}/{r}" for r in runs]), keys, order).select(*keys, "newest.*")


def _newest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return log.groupBy(*keys).agg(F.max_by("newest", F.struct(*[F.col(f"newest.{c}") for c in order])).alias("newest"))


def _run_name(level: int, number: int) -> str:
    return f"run-{level}-{number:012d}"


def _level(run: str) -> int:
    return int(run.split("-")[1])


def _folder(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _runs(spark: SparkSession, changelog: str, number: int | None) -> list[str]:
    """The live runs after a batch, by default after the last one; none before the first."""
    system, folder = _folder(spark, changelog)
    if not system.exists(folder):
        return []
    if number is None:
        names = [f.getPath().getName() for f in system.listStatus(folder)]
        found = max((n for n in names if n.startswith(_MANIFEST)), default=None)
    else:
        found = f"{_MANIFEST}{number:012d}"
    if found is None or not system.exists(_folder(spark, f"{changelog}/{found}")[1]):
        return []
    stream = system.open(_folder(spark, f"{changelog}/{found}")[1])
    try:
        text = bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
    return text.split("\n") if text else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    system, final = _folder(spark, path)
    draft = _folder(spark, f"{path.rpartition('/')[0]}/.draft-{path.rpartition('/')[2]}")[1]
    out = system.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    system.delete(final, False)
    if not system.rename(draft, final):
        raise OSError(f"cannot write {path}")


def _delete(spark: SparkSession, path: str) -> None:
    system, folder = _folder(spark, path)
    system.delete(folder, True)
