"""Exact deduplication by two passes over a Bloom filter of text digests, with built-in functions only.

Pass one counts how often each position of a Bloom filter is hit and keeps, as a bit set, the positions hit at least
twice. Pass two tests every digest against it: a text of which there are two has both positions set, so only rows that
test positive are grouped; all others pass straight through as the only row with their text. A false positive costs a
little shuffling and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filter_positions, filter_rows, filter_size, stage, text_of, whole_row, with_maybe


def normalised(text: Column) -> Column:
    """The text without any of the six ASCII white-space characters."""
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digests(docs: DataFrame, *carried: Column) -> DataFrame:
    """Per row: doc_id, points (code points of the text as it is), text_sha256 of the normalised text, `carried`, uid."""
    text = text_of()
    thin = docs.select("doc_id", F.length(text).cast("long").alias("points"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"), *carried)
    return stage(thin.withColumn("uid", F.monotonically_increasing_id()), "digests")


def repeat_filter(thin: DataFrame, size: int) -> DataFrame:
    """A filter of the positions that at least two rows hit."""
    hit = thin.select(F.array_distinct(F.array(*filter_positions(size, "text_sha256"))).alias("p")).select(F.explode("p").alias("p"))
    return filter_rows(hit.groupBy("p").count().filter("count > 1"))


def possible_repeats(thin: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """`rows` (thin itself, or others with text_sha256) with _maybe: whether the filter of thin holds the row's digest."""
    size = filter_size(thin.count())
    return with_maybe(thin if rows is None else rows, stage(repeat_filter(thin, size), "filter"), size, "text_sha256")


def _best(names: list[str]) -> Column:
    """Most code points, then the smallest doc_id (null last), then any one of repeated rows."""
    return F.min_by(F.struct(*names), F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "uid"))


def groups(thin: DataFrame) -> DataFrame:
    """thin with keep_id, group_size and kept for every row.

    Null texts are empty texts and equal to them. Of repeated rows one stays. Rows with a null doc_id stay only where
    all rows of the group have none. No rows give no rows.
    """
    tested = stage(possible_repeats(thin), "tested")
    maybe = tested.filter("_maybe").drop("_maybe")
    # Written, so that the join below has two plain inputs and a text with very many copies can be split.
    facts = stage(maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), _best(["doc_id", "uid"]).alias("best")), "repeats")
    judged = maybe.join(facts, "text_sha256").select(*thin.columns, F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"))
    alone = tested.filter("not _maybe").select(*thin.columns, F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    return alone.unionByName(judged)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, all their columns, with one row for each text: that with the most code points, then the
    smallest doc_id (null last), then any one of repeated rows.

    Null and empty texts are one text. No rows give no rows. Rows whose digest the filter does not hold pass straight
    through; of the others, each task sends the best row that it has for a text.
    """
    text = text_of()
    keyed = docs.select(whole_row(docs), F.col("doc_id").alias("doc_id"), F.length(text).cast("long").alias("points"), F.sha2(normalised(text).cast("binary"), 256).alias("text_sha256"))
    tested = possible_repeats(stage(keyed.select("text_sha256"), "digests"), keyed)
    first = F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id")
    best = tested.filter("_maybe").groupBy("text_sha256").agg(F.min_by("_row", first).alias("_row"))
    return tested.filter("not _maybe").select("_row").unionByName(best.select("_row")).select("_row.*")
