"""Shared by the operators: tables, words, running sums over a global order, and decisions carried back to whole rows."""

from __future__ import annotations

import ctypes
import shutil
import tempfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()

# Texts reach Python workers in batches of about so many bytes. By rows alone a batch of texts has tens of megabytes, which
# the executor and the worker hold once each, and more while they are turned into strings.
BATCH_BYTES = 4 << 20
_BATCH_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Gives this package to Python workers, once per application, for clusters that were not given it at the start.
    Batches of a session that sets no size of its own get BATCH_BYTES."""
    context = spark.sparkContext
    if spark.conf.get(_BATCH_BYTES_KEY, None) is None:
        spark.conf.set(_BATCH_BYTES_KEY, str(BATCH_BYTES))
    if context.applicationId not in _SHIPPED:
        _SHIPPED.add(context.applicationId)
        package = Path(__file__).resolve().parents[1]
        held = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(held)


# What tasks of an operator keep in their Python worker for its next tasks, by operator.
_KEPT: dict[str, dict] = {}


def kept(operator: str) -> dict:
    return _KEPT.setdefault(operator, {})


def give_back(operator: str | None = None) -> None:
    """Called where a task ends: what other operators kept in this worker goes, and memory that nothing uses returns to
    the system. Workers live on between tasks and stages, and what they hold counts beside the executor's heap."""
    for name in [n for n in _KEPT if n != operator]:
        del _KEPT[name]
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def text_of(column: str = "text") -> Column:
    """Null texts count as empty everywhere."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """Adds, per name in `sums`, the sum of its expression over the rows up to this one in the order (`by`, `order`).

    The rows are sorted by range into parts, each part is summed, and the sums of the parts before are added to what a
    row has inside its own part. So one long group, or the whole table with no `by`, is spread over all parts: the only
    rows that meet are one per part and group. `by` columns must not be null. Returns a table that is already written.
    """
    first = [F.col(b) for b in by] + order
    placed = df.select("*", *[e.alias(f"_v_{n}") for n, e in sums.items()]).repartitionByRange(*first)
    placed = stage(placed.withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part", *by).agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    bases = totals.select("_part", *by, *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = placed.join(bases, ["_part", *by])
    own = [c for c in df.columns if c not in sums]
    return whole.select(*own, *[(F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(inside)).alias(n) for n in sums])


# A filter has FILTER_ROOM positions for each key, up to a bound (64 MB of bits) that may be broadcast. A table with more
# keys gets a fuller filter: it lets more through that has to be compared and never loses anything.
FILTER_ROOM = 16
MOST_POSITIONS = 1 << 29
FILTER_WORDS = 64  # 64-bit words in one row of a filter


def filter_size(keys: int, most: int = MOST_POSITIONS) -> int:
    return min(most, 1 << max(16, (FILTER_ROOM * keys).bit_length()))


def filter_positions(size: int, *key: str) -> list[Column]:
    """Two positions p1 and p2 of a key. Both lie in one row of the filter, so that a key is tested by one lookup."""
    bits = 64 * FILTER_WORDS
    block = F.pmod(F.xxhash64(*key), F.lit(size // bits))
    return [(block * bits + F.pmod(F.xxhash64(*key, F.lit(i)), F.lit(bits))).alias(f"p{i}") for i in (1, 2)]


def filter_rows(positions: DataFrame) -> DataFrame:
    """block, words: a filter with the given positions (p) set."""
    word = positions.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits"))
    entry = F.struct((F.col("w") % FILTER_WORDS).cast("int").alias("w"), "bits")
    rows = word.groupBy((F.col("w") / FILTER_WORDS).cast("long").alias("block")).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    return rows.select("block", F.transform(F.sequence(F.lit(0), F.lit(FILTER_WORDS - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0))).alias("words"))


def with_maybe(df: DataFrame, found: DataFrame, size: int, *key: str) -> DataFrame:
    """df with _maybe: whether the filter (`filter_rows`, of `size` positions) holds the key of a row."""
    bits = 64 * FILTER_WORDS
    placed = df.select("*", *[p.alias(f"_p{i}") for i, p in enumerate(filter_positions(size, *key))])
    tested = placed.withColumn("_block", (F.col("_p0") / bits).cast("long")).join(F.broadcast(found.select(F.col("block").alias("_block"), F.col("words").alias("_words"))), "_block", "left")
    inside = [F.expr(f"(element_at(_words, cast(_p{i} % {bits} div 64 as int) + 1) & shiftleft(1L, cast(_p{i} % 64 as int))) != 0") for i in (0, 1)]
    return tested.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(inside[0] & inside[1], F.lit(False)).alias("_maybe"))


def whole_row(docs: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")


def row_key(df: DataFrame) -> tuple[Column, Column]:
    """128 bits of a row's whole content. Rows with the same key are the same row repeated."""
    # Maps, wherever they are in a column, have no hash; their text does.
    columns = [F.col(f"`{c}`") if "map<" not in t else F.to_json(F.struct(F.col(f"`{c}`").alias("x"))) for c, t in sorted(df.dtypes)]
    # A null adds nothing to the hash, so which columns are null is hashed as well.
    nulls = F.concat(*[F.when(F.col(f"`{c}`").isNull(), "1").otherwise("0") for c, _ in sorted(df.dtypes)])
    return F.xxhash64(nulls, *columns), F.xxhash64(F.lit("second"), *reversed(columns), nulls)


def carry(docs: DataFrame, actions: DataFrame) -> DataFrame:
    """Whole rows after decisions: `actions` has (_k1, _k2, _copies) per `row_key` and is already written.

    Rows without an action pass as they are. All repeats of a row with an action are replaced by `_copies` of it
    together, which is none for 0. Rows are tested against a Bloom filter of the actions' keys first: only those that it
    holds move (all of the rows with an action and a few others), and their repeats are combined before they do.
    """
    size = filter_size(actions.count())
    found = stage(filter_rows(actions.select(F.explode(F.array(*filter_positions(size, "_k1", "_k2"))).alias("p"))), "filter")
    k1, k2 = row_key(docs)
    tested = with_maybe(docs.select(whole_row(docs), k1.alias("_k1"), k2.alias("_k2")), found, size, "_k1", "_k2")
    passed = tested.filter("not _maybe").select("_row")
    one = tested.filter("_maybe").groupBy("_k1", "_k2").agg(F.first("_row").alias("_row"), F.count("*").alias("_n")).join(actions, ["_k1", "_k2"], "left")
    copied = one.select("_row", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", "_n").cast("int"))).alias("_copy")).filter("_copy > 0").select("_row")
    return passed.unionByName(copied).select("_row.*")
