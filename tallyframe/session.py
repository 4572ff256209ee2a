"""Session settings and the two things that depend on where a job runs: stage tables and small broadcasts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spec tables (frameworks, labels, transition tables) are authored by hand. Past this many rows a table is
# treated as data and joined with an ordinary shuffle join instead of a broadcast hint.
MAX_SPEC_ROWS = 20_000

# The JVM does not compile methods larger than this; a stage that would exceed it runs faster without fused code.
JIT_METHOD_LIMIT = 8000


def build_session(app: str = "tallyframe", cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; on a cluster, pass your own session to every function instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # small local data still uses every core
        .config("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_LIMIT))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no Python stack capture per column
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TALLYFRAME_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings the wide per-company expressions need, for sessions built elsewhere."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_METHOD_LIMIT))
    return spark


def spec_frame(spark: SparkSession, rows: list[dict], schema: pa.Schema) -> DataFrame:
    """A hand-authored table as a DataFrame; hinted for broadcast only while it is provably small."""
    df = spark.createDataFrame(pa.Table.from_pylist(rows, schema=schema))
    return F.broadcast(df) if len(rows) <= MAX_SPEC_ROWS else df


# The folder made for each local application that names none.
_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a temporary one only for a local session that names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _OWN_FOLDERS:
        _OWN_FOLDERS[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='tallyframe-')}"
    return _OWN_FOLDERS[context.applicationId]


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate result once and read it back.

    Used where several later branches need the same rows, or where an iteration would otherwise grow the plan. The
    table lives in the shared folder, so it survives lost executors; reading it back gives Spark sizes and columns
    to plan with.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Stage tables of each application, until they are released.
_STAGED: dict[str, list[str]] = {}


def release(spark: SparkSession) -> int:
    """Deletes the stage tables written so far and returns their number. For a job to call when its results are stored;
    DataFrames that still read a stage table cannot be used afterwards."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)
