"""Document fingerprints: threshold-scaled sketches of word shingles, with built-in functions only.

A sketch keeps every distinct shingle hash in the lowest FRACTION of the hash range; where there is none it keeps the
least hash, so that no text with words has an empty one. How many hashes a sketch has follows the number of distinct
shingles, so the part of one text that another, far longer one contains can be told from their sketches. The sketch of
all shingles of several texts follows from their sketches (`merged`): the union, without those of short texts that were
only kept for want of others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running, text_of

SHINGLE_WORDS = 5
FRACTION = 1 / 4
# Ids are cut at quantiles and evenly between them. The ranges are sorted one by one; their first ids are broadcast,
# at most QUANTILES * MOST_PARTS of them.
QUANTILES = 512
MOST_PARTS = 128
ROWS_IN_RANGE = 400


def with_sketch(df: DataFrame, text: str, name: str, words: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """df with `name`: the ascending distinct 32-bit hashes kept of a text column that has no nulls.

    A text with fewer words than a shingle is one shingle; one without words keeps none.
    """
    parts = F.filter(F.split(F.col(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    shingle = F.transform(F.sequence(F.lit(1), F.greatest(F.size("_words") - (words - 1), F.lit(1))), lambda i: F.shiftright(F.xxhash64(F.slice("_words", i, words)), 32).cast("int"))
    limit = _limit(fraction)
    # Where any hash is below the limit, the least one is.
    kept = F.array_append(F.filter("_shingles", lambda h: h < limit), F.array_min("_shingles"))
    df = df.withColumn("_words", F.transform(parts, lambda w: F.xxhash64(w))).withColumn("_shingles", shingle)
    none = F.array().cast("array<int>")
    return df.withColumn(name, F.when(F.size("_words") == 0, none).otherwise(F.array_sort(F.array_distinct(kept)))).drop("_words", "_shingles")


def likeness(a: str, b: str) -> Column:
    """The estimated part of their joint shingles that both texts have; 1 for two texts without words."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def containment(a: str, b: str) -> Column:
    """The estimated part of a's shingles that b has; 1 where a has none."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merged(sketches: Column | str, fraction: float = FRACTION) -> Column:
    """An aggregate: the sketch of all shingles of a group's texts, as long as no more texts are in a group than one row can hold."""
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_set(sketches))))
    below = F.filter(union, lambda h: h < _limit(fraction))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(union, 1, 1))


def _limit(fraction: float) -> int:
    return int(-(2**31) + fraction * 2**32)


def written(sketch: str) -> Column:
    """Eight hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def _range_of(docs: DataFrame) -> Column:
    """A range number for each doc_id that ascends with it, null first, with about ROWS_IN_RANGE rows each where ids are dense."""
    marks = docs.agg(F.percentile_approx("doc_id", [i / QUANTILES for i in range(QUANTILES + 1)], 10_000).alias("at"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    if marks.low is None:
        return F.lit(-1).cast("long")
    bounds = sorted({marks.low, *marks["at"], marks.high + 1})
    parts = min(MOST_PARTS, max(1, marks.n // (QUANTILES * ROWS_IN_RANGE)))
    at = F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("doc_id"))).cast("long")
    low, high = (F.element_at(F.lit(bounds), (at + i).cast("int")) for i in (0, 1))
    within = F.least(F.floor((F.col("doc_id") - low).cast("double") / (high - low) * parts), F.lit(parts - 1))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(at * parts + within).cast("long")


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs (doc_id and `carried`) with next: a struct of the `carried` columns of the row that follows by doc_id; the first follows the last.

    Rows of one doc_id are ordered by the carried columns; a null doc_id comes first. Every range of ids is sorted on
    its own and also gets a copy of the first row of the range after it, so texts are shuffled once and no range meets
    another.
    """
    ranged = docs.withColumn("_range", _range_of(docs))
    firsts = ranged.groupBy("_range").agg(F.min("doc_id").alias("_first"))
    numbered = running(firsts, [F.col("_range")], {"_n": F.lit(1)})
    after = numbered.select((F.col("_n") - 1).alias("_n"), F.col("_range").alias("_of"), "_first")
    last = numbered.agg(F.max("_n")).first()[0] or 0
    before = numbered.select("_n", F.col("_range").alias("_before"))
    tails = after.withColumn("_n", F.when(F.col("_n") == 0, last).otherwise(F.col("_n"))).join(before, "_n").select(F.col("_of").alias("_range"), F.col("_first"), "_before")
    # At most QUANTILES * MOST_PARTS + 1 rows, so it may be broadcast.
    found = ranged.join(F.broadcast(tails), (ranged._range == tails._range) & ranged.doc_id.eqNullSafe(tails._first), "left").select(ranged["*"], "_before")
    own = F.struct(F.col("_range").alias("_at"), F.lit(False).alias("_tail"))
    copy = F.struct(F.col("_before").alias("_at"), F.lit(True).alias("_tail"))
    dealt = found.select("doc_id", *carried, F.explode(F.when(F.col("_before").isNotNull(), F.array(own, copy)).otherwise(F.array(own))).alias("_p"))
    dealt = dealt.select("doc_id", *carried, "_p._at", "_p._tail")
    order = Window.partitionBy("_at").orderBy("_tail", "doc_id", *carried)
    return dealt.withColumn("next", F.lead(F.struct(*carried)).over(order)).filter("not _tail").drop("_at", "_tail")


def fingerprints(docs: DataFrame, *, words: int = SHINGLE_WORDS, fraction: float = FRACTION) -> DataFrame:
    """Per row: doc_id, text (null: empty), sketch, and next.text and next.sketch of the document after it. Repeated rows follow each other; a single row follows itself."""
    return with_next(with_sketch(docs.select("doc_id", text_of().alias("text")), "text", "sketch", words, fraction), ["text", "sketch"])
