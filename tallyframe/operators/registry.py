"""Versioned sources, status audits, and stage fingerprints."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..session import spec_frame
from . import ordered

# Allowed status changes of a document.
TRANSITIONS = (
    ("registered", "retrieved"), ("registered", "failed"),
    ("retrieved", "parsed"), ("retrieved", "failed"), ("retrieved", "superseded"),
    ("parsed", "extracted"), ("parsed", "failed"), ("parsed", "superseded"),
    ("extracted", "parsed"), ("extracted", "failed"), ("extracted", "superseded"),
    ("failed", "registered"),
)


def source_versions(snapshots: DataFrame, keys: list[str], order: list[str], bucket: Column, hash_column: str = "hash") -> DataFrame:
    """The rows that start a new version of their source, numbered; unchanged snapshots are no-ops.

    A, B, A is three versions. The chain is linear: every version supersedes the one before, and the last is current.
    """
    seen = ordered.with_previous(snapshots, keys, order, bucket, hash_column, "previous_hash")
    starts = seen.filter(F.col("previous_hash").isNull() | (F.col("previous_hash") != F.col(hash_column)))
    numbered = ordered.with_running_sum(starts, keys, order, bucket, F.lit(1), "version")
    last = numbered.groupBy(*keys).agg(F.max("version").alias("versions"))
    return numbered.join(last, keys).withColumn("is_current", F.col("version") == F.col("versions"))


def with_document_ids(versions: DataFrame, company: Column, kind: Column, source: Column, hash_column: str = "hash") -> DataFrame:
    """Document ids along the chain. The first version hashes the source alone; a later one also its own digest, the
    digest before it and its number, so every id can be computed without walking the chain."""
    first = ids.document_id(company, kind, source)

    def later(digest: Column, previous: Column, version: Column) -> Column:
        return ids.document_id(company, kind, F.concat_ws("@", source, digest, F.concat(previous, F.lit("#"), version.cast("string"))))

    own = F.when(F.col("version") == 1, first).otherwise(later(F.col(hash_column), F.col("previous_hash"), F.col("version")))
    return versions.withColumn("document_id", own)


def transition_table(spark: SparkSession) -> DataFrame:
    rows = [{"before": a, "after": b} for a, b in TRANSITIONS]
    return spec_frame(spark, rows, pa.schema([("before", pa.string()), ("after", pa.string())]))


def forbidden_transitions(history: DataFrame, bucket: Column, order: list[str]) -> DataFrame:
    """Status changes of a document outside the allowed table. history: (document_id, status, ...)."""
    steps = ordered.with_previous(history, ["document_id"], order, bucket, "status", "before")
    moved = steps.filter(F.col("before").isNotNull()).withColumn("after", F.col("status"))
    return moved.join(transition_table(history.sparkSession), ["before", "after"], "left_anti")


def registered(documents: DataFrame, *, company: str | None = None, status: str | None = None, kind: str | None = None,
               digest: str | None = None, include_superseded: bool = False) -> DataFrame:
    """Registry lookups as plain filters, so that they reach the scan."""
    for column, wanted in (("company_id", company), ("status", status), ("type", kind), ("hash", digest)):
        if wanted is not None:
            documents = documents.filter(F.col(column) == wanted)
    return documents if include_superseded or status == "superseded" else documents.filter("status <> 'superseded'")


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free content hash per group in one map-side combined pass: a row count and two hash sums."""
    columns = sorted(c for c in df.columns if c not in by)
    h = F.xxhash64(*columns)
    return df.groupBy(*by).agg(
        F.count("*").alias("n_rows"), F.bit_xor(h).alias("xor_hash"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("sum_hash")
    )


def stale(manifest: DataFrame, current: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose data no longer matches what a stage recorded, including groups that vanished or appeared."""
    recorded = manifest.select(*by, F.struct("n_rows", "xor_hash", "sum_hash").alias("recorded"))
    actual = current.select(*by, F.struct("n_rows", "xor_hash", "sum_hash").alias("actual"))
    return recorded.join(actual, by, "full").filter(~F.col("recorded").eqNullSafe(F.col("actual"))).select(
        *by, F.when(F.col("recorded").isNull(), "not_recorded").when(F.col("actual").isNull(), "data_missing").otherwise("changed").alias("why")
    )
